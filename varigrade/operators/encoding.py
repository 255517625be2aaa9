"""Categories to numbers: one-hot columns and vectors, rare-level pruning, codes and vocabularies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from varigrade.session import materialize


def dense_index(df: DataFrame, order: Sequence, name: str = "id") -> DataFrame:
    """Number all rows 0..n-1 in the given order without gathering them in one task.

    A range-partitioned sort numbers each partition; the row counts of the partitions (one row each) give the
    offsets. The sorted rows are written once, so both steps see the same partitions after a lost executor.
    """
    ordered = materialize(df.orderBy(*order).withColumn("_rid", F.monotonically_increasing_id()))
    # monotonically_increasing_id keeps the partition number above bit 33 and the row number below it
    numbered = ordered.select("*", F.shiftright("_rid", 33).alias("_part")).withColumn(
        "_row", F.col("_rid").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (numbered.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_row")).drop("_rid", "_part", "_row", "_offset"))


def build_vocab(df: DataFrame, column: str, value: str = "value", index: str = "id") -> DataFrame:
    """(value, id): the distinct non-null values numbered from 0 in sorted order."""
    levels = df.select(F.col(column).alias(value)).filter(F.col(value).isNotNull()).distinct()
    return dense_index(levels, [value], index)


def encode_with_vocab(df: DataFrame, column: str, vocabulary: DataFrame, output: str, default: int = 0,
                      value: str = "value", index: str = "id") -> DataFrame:
    """Add the id of ``column``; values outside the vocabulary take ``default``."""
    ids = vocabulary.select(F.col(value).alias("_value"), F.col(index).alias("_id"))
    return (df.join(ids, F.col(column) == F.col("_value"), "left")
            .withColumn(output, F.coalesce("_id", F.lit(default))).drop("_value", "_id"))


def category_codes(df: DataFrame, column: str, output: str) -> tuple[DataFrame, DataFrame]:
    """(df with codes, lookup): sorted labels numbered from 0, a missing label is -1."""
    lookup = build_vocab(df, column)
    return encode_with_vocab(df, column, lookup, output, default=-1), lookup


def prune_rare_categories(df: DataFrame, column: str, min_rows: int = 10, output: str | None = None) -> DataFrame:
    """Blank out levels seen in fewer than ``min_rows`` rows; every row stays."""
    kept = (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_kept"))
            .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows).select("_kept"))
    joined = df.join(kept, F.col(column) == F.col("_kept"), "left")
    return joined.withColumn(output or column, F.col("_kept")).drop("_kept")


def levels_of(df: DataFrame, column: str) -> list:
    """Sorted distinct values, as many as the columns to be made of them."""
    return sorted(row[0] for row in df.select(column).filter(F.col(column).isNotNull()).distinct().collect())


def one_hot(df: DataFrame, columns: Sequence[str], drop_first: bool = False,
            levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Replace each column by 0/1 columns ``<column>_<level>`` in level order; a missing value is all zero.

    ``levels`` names the levels of a column beforehand, so that its values aren't looked up (a value outside them is
    all zero). The table gets a column per level; columns with very many levels belong in ``one_hot_vectors``.
    """
    wide = [c for c in df.columns if c not in columns]
    flags = []
    for column in columns:
        known = levels[column] if levels and column in levels else levels_of(df, column)
        for level in known[1 if drop_first else 0:]:
            flags.append(F.coalesce((F.col(column) == level).cast("int"), F.lit(0)).alias(f"{column}_{level}"))
    return df.select(*wide, *flags)


def one_hot_drop_first(df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    return one_hot(df, columns, drop_first=True, levels=levels)


def one_hot_vectors(columns: Sequence[str], suffix: str = "_hot") -> Pipeline:
    """Sparse form for models: levels in alphabetical order, a missing or unseen level is the zero vector."""
    codes = [f"{c}_code" for c in columns]
    return Pipeline(stages=[
        StringIndexer(inputCols=list(columns), outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCols=codes, outputCols=[f"{c}{suffix}" for c in columns], dropLast=True,
                      handleInvalid="error"),
    ])
