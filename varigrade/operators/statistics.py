"""Standardising, class weights, correlations and explained variance."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def scale_columns(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str],
                  sample: bool = False) -> list[DataFrame]:
    """Centre and scale ``columns`` of all tables by the mean and deviation of ``train``.

    Population deviation by default, sample deviation on request. A constant column is only centred. One row of
    statistics comes to the driver.
    """
    deviation = F.stddev_samp if sample else F.stddev_pop
    row = train.agg(*[f(c).alias(f"{c}|{k}") for c in columns for k, f in (("m", F.avg), ("s", deviation))]).first()

    def scaled(column: str) -> Column:
        spread = row[f"{column}|s"] or 1.0
        return (F.col(column) - F.lit(row[f"{column}|m"])) / F.lit(spread)

    return [df.withColumns({c: scaled(c) for c in columns}) for df in (train, *others)]


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation."""
    return scale_columns(df, [], columns)[0]


def zscore_target(train: DataFrame, validation: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Z-score of the target by the mean and sample deviation of the training part."""
    scaled_train, scaled_validation = scale_columns(train, [validation], [target], sample=True)
    return scaled_train, scaled_validation


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """(class, balanced): n / (k * n_c) per class of the training part; rows without a label are not counted."""
    counts = train.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()  # one row
    return counts.select("class", (F.lit(whole.n) / (whole.k * F.col("n"))).alias("balanced"))


def class_weights_balanced(df: DataFrame, label: str, output: str = "class_weight",
                           weight: Column | None = None) -> DataFrame:
    """Add the balanced class weight of each row, times its own ``weight`` when given.

    The weights are joined back, however many classes there are; a row without a label gets a null weight.
    """
    balanced = class_weights(df, label).select(F.col("class").alias("_class"), F.col("balanced").alias("_balanced"))
    joined = df.join(balanced, F.col(label) == F.col("_class"), "left")
    value = F.col("_balanced") if weight is None else F.col("_balanced") * weight
    return joined.withColumn(output, value).drop("_class", "_balanced")


def correlation_matrix(df: DataFrame, columns: Sequence[str], label: str = "a", other: str = "b") -> DataFrame:
    """(a, b, r) for all ordered pairs of complete numeric columns; r is null where a column is constant.

    The columns are summed up into one small matrix across the tasks (Spark ML), not pair by pair. The matrix goes back
    as one row per column, and the executors take the rows apart into pairs.
    """
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(df).select("_x")
    matrix = Correlation.corr(vectors, "_x").first()[0].toArray()
    held = pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), len(columns)).cast(pa.list_(pa.float64()))
    lines = df.sparkSession.createDataFrame(pa.table({label: list(columns), "_row": held}))
    names = df.sparkSession.createDataFrame(pa.table({"_at": pa.array(range(len(columns)), pa.int32()), other: list(columns)}))
    pairs = lines.select(label, F.posexplode("_row").alias("_place", "_r")).join(names, F.col("_place") == F.col("_at"))
    return pairs.select(label, other, F.when(~F.isnan("_r"), F.col("_r")).alias("r"))


def corr_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r): absolute correlations below 1 of all pairs, highest first."""
    pairs = correlation_matrix(df, columns).filter(F.col("a") != F.col("b"))
    return pairs.withColumn("r", F.abs("r")).filter("r < 1.0").orderBy(F.desc("r"), "a", "b")


def topk_corr_features(pairs: DataFrame, pairs_kept: int = 40, features_kept: int = 20) -> DataFrame:
    """(feature, r): first names of the strongest pairs, by their best correlation."""
    top = pairs.orderBy(F.desc("r"), "a", "b").limit(pairs_kept)
    best = top.groupBy(F.col("a").alias("feature")).agg(F.max("r").alias("r"))
    return best.orderBy(F.desc("r"), "feature").limit(features_kept)


def corr_submatrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Signed correlations among chosen features, the diagonal included."""
    return correlation_matrix(df, features)


def cumulative_variance(ratios: DataFrame, share: float = 0.95) -> DataFrame:
    """(component, ratio, cumulative, reached) over one row per component; ``reached`` flags the first to reach ``share``."""
    upto = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ratios.withColumn("cumulative", F.sum("ratio").over(upto))
    return summed.withColumn("reached", (F.col("cumulative") >= share)
                             & (F.col("cumulative") - F.col("ratio") < share))
