"""Aggregations. Where a group could be hot, rows are reduced to (key, value) before they meet by key, so
the second shuffle carries at most the distinct values of a group, never its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

MIC_KEYS = ("gene", "mutation", "gene_position", "ref", "alt", "drug", "drug_name")


def _aggregate_frequencies(frequency: DataFrame, keys: Sequence[str], median: str, *others: Column) -> DataFrame:
    """Exact interpolated median of ``_v`` (each counted ``_n`` times) per key, beside ``others``.

    The median is read off the running frequency, which sorts and spills, where a per-group value map would
    have to fit in memory.
    """
    group = Window.partitionBy(*keys)
    ranked = (frequency
              .withColumn("_upto", F.sum("_n").over(
                  group.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .withColumn("_all", F.sum("_n").over(group)))

    def value_at(rank: Column) -> Column:
        covers = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(covers, F.col("_v")))

    lower, upper = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    return ranked.groupBy(*keys).agg(((value_at(lower) + value_at(upper)) / 2).alias(median), *others)


def mean_median_count(df: DataFrame, keys: Sequence[str], value: str, mean: str, median: str,
                      count: str) -> DataFrame:
    """Mean, exact interpolated median and row count per key; rows without a value are not counted.

    Rows collapse to (key, value, frequency) before the shuffle on the key.
    """
    frequency = (df.filter(F.col(value).isNotNull())
                 .groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    return _aggregate_frequencies(
        frequency, keys, median,
        (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias(mean), F.sum("_n").alias(count))


def agg_variant_mic(measurements: DataFrame, min_count: int = 5, keys: Sequence[str] = MIC_KEYS) -> DataFrame:
    """Measurement summary per variant and drug, for groups of at least ``min_count`` rows."""
    summary = mean_median_count(measurements, keys, "log2mic", "mean_log2mic", "median_log2mic", "count")
    return summary.filter(F.col("count") >= min_count)


def agg_variant_fallback(mic: DataFrame) -> DataFrame:
    """Per variant over its drugs: mean of means, median of medians, sum of counts (all unweighted)."""
    frequency = (mic.filter(F.col("variant_norm").isNotNull())
                 .groupBy("variant_norm", F.col("median_log2mic").alias("_v"))
                 .agg(F.count("median_log2mic").alias("_n"), F.sum("mean_log2mic").alias("_sum"),
                      F.count("mean_log2mic").alias("_means"), F.sum("count").alias("_count")))
    return _aggregate_frequencies(
        frequency, ["variant_norm"], "median_log2mic_variant",
        F.try_divide(F.sum("_sum"), F.sum("_means")).alias("mean_log2mic_variant"),
        F.sum("_count").alias("count_variant"))


def mic_fallback(df: DataFrame) -> DataFrame:
    """Exact measurement, else the variant's, else 0; with flags that say which was there."""
    return df.withColumns({
        "has_exact_mic": F.col("mean_log2mic").isNotNull().cast("int"),
        "has_variant_mic": F.col("mean_log2mic_variant").isNotNull().cast("int"),
        "mean_log2mic_final": F.coalesce("mean_log2mic", "mean_log2mic_variant", F.lit(0.0)),
        "mic_count_final": F.coalesce("count", "count_variant", F.lit(0)),
    })


def distinct_values(df: DataFrame, column: str, value: str = "value") -> DataFrame:
    return df.select(F.col(column).alias(value)).distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each non-missing value, most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column)


def n_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-missing values per column, one row per column.

    Each (column, value) pair is reduced to one row before counting, so no task holds a whole column.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("p")).select("p.*").distinct()
    return pairs.groupBy("column").agg(F.count("value").alias("n_unique"))


def order_summary(df: DataFrame, *descending: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in descending])


def contingency_metrics(df: DataFrame, mutation: Sequence[str], present: str = "present",
                        resistant: str = "resistant") -> DataFrame:
    """2x2 table per mutation (a, b present; c, d absent) with sensitivity, specificity, PPV and odds ratio."""
    there, sick = F.col(present), F.col(resistant)
    cells = df.groupBy(*mutation).agg(
        F.count_if(there & sick).alias("a"), F.count_if(there & ~sick).alias("b"),
        F.count_if(~there & sick).alias("c"), F.count_if(~there & ~sick).alias("d"))
    return with_contingency_rates(cells)


def with_contingency_rates(cells: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    return cells.withColumns({
        "sensitivity": F.try_divide(a, a + c),
        "specificity": F.try_divide(d, b + d),
        "ppv": F.try_divide(a, a + b),
        "odds_ratio": F.try_divide(F.try_divide(a, b), F.try_divide(c, d)),
    })


def mutation_contingency(carriers: DataFrame, samples: DataFrame) -> DataFrame:
    """2x2 metrics per (mutation, drug) from carrier rows and one row per tested sample.

    ``carriers``: sample, mutation. ``samples``: sample, drug, resistant. The absent cells are the drug's
    totals minus the present ones, so no sample-by-mutation grid is built.
    """
    totals = samples.groupBy("drug").agg(
        F.count_if("resistant").alias("_r"), F.count_if(~F.col("resistant")).alias("_s"))
    seen = carriers.distinct().join(samples, "sample").groupBy("mutation", "drug").agg(
        F.count_if("resistant").alias("a"), F.count_if(~F.col("resistant")).alias("b"))
    cells = seen.join(totals, "drug").select(
        "mutation", "drug", "a", "b", (F.col("_r") - F.col("a")).alias("c"), (F.col("_s") - F.col("b")).alias("d"))
    return with_contingency_rates(cells)


def solo_filter(df: DataFrame, catalogue: DataFrame, keys: Sequence[str], sample: str = "sample") -> DataFrame:
    """(sample, keys) of the catalogued mutations that are the only catalogued one of their sample.

    Repeated rows of one mutation count once and mutations outside the catalogue don't count.
    """
    listed = df.join(catalogue.select(*keys).distinct(), list(keys), "left_semi").select(sample, *keys).distinct()
    alone = listed.groupBy(sample).count().filter("count = 1").select(sample)
    return listed.join(alone, sample, "left_semi")
