"""Leakage-free splits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from varigrade.operators.encoding import dense_index

RANK_BLOCK = 1 << 16


def level_loads(sizes: Iterable[tuple[int, int]], folds: int) -> list[tuple[int, int, int, int]]:
    """Greedy balancing (largest group to the lightest fold) on a histogram of group sizes.

    ``sizes`` holds (group size, number of groups). Groups of one size are interchangeable, so each size
    needs only the number that every fold takes: fold ``f`` takes its ``j``-th one when its load reaches
    ``load + j * size``, and the smallest such levels (lower fold first on a tie) win. Returns rows
    (size, first, last, fold) over the index of the groups within their size.
    """
    loads = [0] * folds
    ranges = []
    for size, groups in sorted(sizes, reverse=True):
        def below(level: int) -> list[int]:
            return [max(0, -(-(level - load) // size)) for load in loads]

        low, high = min(loads), max(loads) + size * groups + 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(below(middle)) <= groups else (low, middle)
        taken = below(low)
        spare = groups - sum(taken)
        for fold, load in enumerate(loads):
            if spare and load + taken[fold] * size == low:
                taken[fold] += 1
                spare -= 1
        first = 0
        for fold, count in enumerate(taken):
            if count:
                ranges.append((size, first, first + count, fold))
            first += count
            loads[fold] += count * size
    return ranges


def assign_group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(group, n_rows, fold) with groups spread over ``folds`` so that the row counts are balanced.

    Only the histogram of group sizes reaches the driver: N rows have at most sqrt(2N) different sizes. Groups meet their
    fold by size and block of ``RANK_BLOCK`` ranks, so the many groups of one size are spread over tasks.
    """
    spark = df.sparkSession
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    block = F.expr(f"_rank div {RANK_BLOCK}")
    ranked = dense_index(counts, [F.desc("n_rows"), group], "_rank").withColumn("_block", block)
    histogram = ranked.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n"), F.min("_rank").alias("first")).collect()
    starts = {row.n_rows: row["first"] for row in histogram}
    plan = spark.createDataFrame(
        [(size, starts[size] + first, starts[size] + last, fold)
         for size, first, last, fold in level_loads([(r.n_rows, r.n) for r in histogram], folds)],
        "n_rows bigint, _first bigint, _last bigint, fold int")
    blocks = F.explode(F.expr(f"sequence(_first div {RANK_BLOCK}, (_last - 1) div {RANK_BLOCK})")).alias("_block")
    inside = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last"))
    return ranked.join(plan.select("*", blocks), ["n_rows", "_block"]).filter(inside).select(group, "n_rows", "fold")


def group_kfold(df: DataFrame, group: str, folds: int = 5, missing: str | None = None,
                fold: str = "fold") -> DataFrame:
    """Add a fold number; all rows of a group share it. A null group is the group ``missing`` when given."""
    if missing is not None:
        df = df.withColumn(group, F.coalesce(F.col(group), F.lit(missing)))
    assigned = assign_group_folds(df, group, folds).select(
        F.col(group).alias("_group"), F.col("fold").alias(fold))
    return df.join(assigned, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def in_test_share(key: Column, seed: int = 42, share: float = 0.2) -> Column:
    """True for about ``share`` of the keys, fixed by the key and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.substr(digest, F.lit(1), F.lit(8)) < F.lit(f"{int(share * 2**32):08x}")


def random_split(df: DataFrame, key: str, seed: int = 42, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the row key, so a recomputed partition splits the same way."""
    test = in_test_share(F.col(key), seed, share)
    return df.filter(~test), df.filter(test)


def fold_unseen_groups(df: DataFrame, group: str, fold: str = "fold", sample: int = 10) -> DataFrame:
    """(fold, n_unseen, sample): distinct groups of each fold and the first few in sorted order."""
    groups = df.select(fold, group).distinct()
    totals = groups.groupBy(fold).agg(F.count(group).alias("n_unseen"))
    return totals.join(first_per_key(groups, fold, group, sample), fold, "left")


def first_per_key(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """(key, sample): the first ``size`` values in sorted order.

    Spark limits each map task to ``size`` rows per key before the shuffle (window group limit).
    """
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(value)))
    return ranked.filter(F.col("_r") <= size).groupBy(key).agg(
        F.sort_array(F.collect_list(value)).alias("sample"))
