"""Column-set operators: renames, drops, fills and row filters. None of them shuffles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varigrade.functions.scores import UNCERTAIN_GRADE, grade_code, sanitize_sentinel


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename; names that are absent are ignored."""
    return df.withColumnsRenamed(dict(names))


def project_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{name}`") for name in columns])


def drop_if_exists(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Of several columns with one name, keep the first."""
    first = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    numbered = df.toDF(*[str(i) for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"`{i}`").alias(name) for name, i in sorted(first.items(), key=lambda x: x[1])])


def select_by_dtype(df: DataFrame, numeric: bool = True) -> DataFrame:
    """Keep the numeric columns, or the others."""
    kept = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) == numeric]
    return project_columns(df, kept)


def array_to_columns(df: DataFrame, array: str, prefix: str, width: int) -> DataFrame:
    """Spread a fixed-width array over ``prefix_0 .. prefix_{width-1}``; a longer array stops the job."""
    fits = F.when(F.size(array) > width, F.raise_error(F.lit(f"{array} has more than {width} elements"))).otherwise(F.col(array))
    spread = [F.get(fits, F.lit(i)).alias(f"{prefix}_{i}") for i in range(width)]
    return df.select(*[c for c in df.columns if c != array], *spread)


def struct_to_columns(df: DataFrame, struct: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != struct], f"{struct}.*")


def unpivot_columns(df: DataFrame, ids: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """All columns but ``ids`` as (name, value) rows."""
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], name, value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every float and double column, so comparisons and averages skip it."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[
        F.nullif(F.col(f"`{c}`"), F.lit(float("nan")).cast(df.schema[c].dataType)).alias(c)
        if c in floats else F.col(f"`{c}`")
        for c in df.columns
    ])


def filter_phenotyped(df: DataFrame, require_quality: bool = True) -> DataFrame:
    """Rows with a measured value on a coding mutation with known alleles.

    With ``require_quality`` the phenotype must also carry a quality and the mutation must not be a minor one.
    """
    keep = (F.col("log2mic").isNotNull() & F.col("codes_protein")
            & F.col("ref").isNotNull() & F.col("alt").isNotNull())
    if require_quality:
        keep = keep & F.col("phenotype_quality").isNotNull() & ~F.col("is_minor")
    return df.filter(keep)


def filter_positive(df: DataFrame, column: str = "ppv") -> DataFrame:
    """Rows whose value is above zero; null and NaN are rejected."""
    value = F.col(column)
    return df.filter((value > 0) & ~F.isnan(value))


def encode_grade(df: DataFrame, grade: str = "grade", code: str = "resistant") -> DataFrame:
    """Replace the grade by its ordinal code; uncertain and unknown grades leave the table."""
    known = df.filter(F.col(grade) != UNCERTAIN_GRADE)
    return known.withColumn(code, grade_code(F.col(grade))).filter(F.col(code).isNotNull()).drop(grade)


def sanitize_numeric(df: DataFrame, sentinel: float = -1) -> DataFrame:
    """``sanitize_sentinel`` on every float and double column, plain null filling on the other numbers."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    cleaned = df.select(*[
        sanitize_sentinel(F.col(f"`{c}`"), float(sentinel)).alias(c) if c in floats else F.col(f"`{c}`")
        for c in df.columns
    ])
    return cleaned.na.fill(sentinel)


def fill_constants(df: DataFrame, constants: Mapping[str, object], default: float | None = 0) -> DataFrame:
    """Fill named columns with their constant, then every other numeric null with ``default``."""
    filled = df.na.fill({k: v for k, v in constants.items() if k in df.columns})
    return filled if default is None else filled.na.fill(default)


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def null_counts(df: DataFrame) -> DataFrame:
    """One row: the number of missing values per column, in a single pass."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_missing) of the columns that have missing values."""
    wide = null_counts(df)
    return wide.unpivot([], wide.columns, "column", "n_missing").filter("n_missing > 0")


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop every column with at least one missing value (one row of counts comes to the driver).

    Columns that can't hold a null by their type, such as one-hot flags, are kept without being counted.
    """
    doubtful = [f.name for f in df.schema.fields if f.nullable]
    counts = null_counts(project_columns(df, doubtful)).first().asDict() if doubtful else {}
    return project_columns(df, [c for c in df.columns if not counts.get(c)])


def membership(column: Column, values: Sequence[object]) -> Column:
    """True for members; a missing value is no member."""
    return F.coalesce(column.isin(list(values)), F.lit(False))


def isin_split(df: DataFrame, column: str, held_out: Sequence[object]) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows outside and inside the held-out values."""
    inside = membership(F.col(column), held_out)
    return df.filter(~inside), df.filter(inside)
