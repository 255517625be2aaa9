"""Edge rows of keys, numbers, joins and aggregates."""

import math
import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from varigrade.functions.keys import normalize_key, stringify_strip
from varigrade.functions.scores import ppv_bin
from varigrade.operators import aggregates, columns, coordinates, encoding, joins


def test_normalize_key(spark):
    raw = [None, "", "\t A b\n", "ÄÉ x", "nan", " Gene 1 ", "a\tb"]
    df = spark.createDataFrame([(r,) for r in raw], "s string")
    got = [r[0] for r in df.select(normalize_key(F.col("s"))).collect()]
    assert got == [None if r is None else r.strip().replace(" ", "").lower() for r in raw]
    assert df.select(stringify_strip(F.col("s"), "nan")).collect()[0][0] == "nan"


def test_bins_and_sentinels(spark):
    values = [None, math.nan, 0.0, 0.19, 0.2, 0.6, 0.8, 1.0, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(ppv_bin(F.col("v"))).collect()] == [0, 0, 0, 0, 1, 2, 3, 3, 3, 0]
    assert [r[0] for r in columns.filter_positive(df, "v").collect()] == [0.19, 0.2, 0.6, 0.8, 1.0, math.inf]
    assert [r[0] for r in columns.sanitize_numeric(df).collect()] == [-1, -1, 0.0, 0.19, 0.2, 0.6, 0.8, 1.0, -1, -1]
    assert columns.nan_to_null(df).filter("v is null").count() == 2


def test_column_sets(spark):
    df = spark.createDataFrame([(1, "x", 2.0, None)], "a int, b string, c double, d int")
    twice = df.select("a", "b", F.col("c").alias("a"))
    assert columns.dedupe_columns(twice).columns == ["a", "b"] and columns.dedupe_columns(twice).first()[0] == 1
    assert columns.select_by_dtype(df).columns == ["a", "c", "d"]
    assert columns.drop_null_columns(df).columns == ["a", "b", "c"]
    assert columns.null_profile(df).collect() == [("d", 1)]
    assert columns.rename_columns(df, {"a": "z", "nope": "y"}).columns == ["z", "b", "c", "d"]


def test_only_null_safe_join_matches_nulls(spark):
    left = spark.createDataFrame([("v", None), (None, "d"), ("v", "d"), ("w", "d")], "variant_norm string, drug_norm string")
    right = spark.createDataFrame([("v", None, 1.0), ("v", "d", 2.0), ("v", "d", 3.0)],
                                  "variant_norm string, drug_norm string, mean_log2mic double")
    rows = sorted(joins.join_mic_exact(left, right).collect(), key=str)
    assert sorted((str(r.variant_norm), str(r.drug_norm), str(r.mean_log2mic)) for r in rows) == [
        ("None", "d", "None"), ("v", "None", "1.0"), ("v", "d", "2.0"), ("v", "d", "3.0"), ("w", "d", "None")]
    by_variant = joins.join_mic_variant(left, right.select("variant_norm", "mean_log2mic"))
    assert by_variant.filter("variant_norm is null and mean_log2mic is not null").count() == 0
    assert by_variant.count() == 8


def test_median_against_brute_force(spark):
    draw = random.Random(7)
    rows = [(draw.choice("ab") if draw.random() < 0.6 else "hot", draw.choice([None, *[x / 2 for x in range(9)]]))
            for _ in range(3000)]
    df = spark.createDataFrame([("one", 2.5), ("none", None), *rows], "k string, v double")
    got = {r.k: (r.mean, r.median, r.n) for r in aggregates.mean_median_count(df, ["k"], "v", "mean", "median", "n").collect()}
    groups = {}
    for key, value in [("one", 2.5), *rows]:
        if value is not None:
            groups.setdefault(key, []).append(value)
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key] == (pytest.approx(st.mean(values)), st.median(values), len(values))


def test_fallback_is_unweighted(spark):
    mic = spark.createDataFrame(
        [("v", 1.0, 1.0, 10), ("v", 3.0, 5.0, 1), ("v", 5.0, 5.0, 1), (None, 9.0, 9.0, 1)],
        "variant_norm string, mean_log2mic double, median_log2mic double, count bigint")
    row = aggregates.agg_variant_fallback(mic).collect()
    assert len(row) == 1
    assert (row[0].mean_log2mic_variant, row[0].median_log2mic_variant, row[0].count_variant) == (3.0, 5.0, 12)


def test_contingency(spark):
    samples = spark.createDataFrame([(i, "d", i < 4) for i in range(10)], "sample int, drug string, resistant boolean")
    carriers = spark.createDataFrame([(0, "m"), (1, "m"), (1, "m"), (7, "m"), (9, "n")], "sample int, mutation string")
    rows = {r.mutation: r for r in aggregates.mutation_contingency(carriers, samples).collect()}
    m = rows["m"]
    assert (m.a, m.b, m.c, m.d) == (2, 1, 2, 5)
    assert (m.sensitivity, m.specificity) == (0.5, 5 / 6) and m.ppv == pytest.approx(2 / 3) and m.odds_ratio == 5.0
    assert rows["n"].odds_ratio == 0.0
    grid = carriers.distinct().filter("mutation = 'm'").join(samples, "sample", "right").select(
        F.lit("m").alias("mutation"), F.col("mutation").isNotNull().alias("present"), "resistant")
    whole = aggregates.contingency_metrics(grid, ["mutation"]).first()
    assert (whole.a, whole.b, whole.c, whole.d) == (2, 1, 2, 5)


def test_solo(spark):
    """Repeated rows count once, mutations outside the catalogue don't count."""
    df = spark.createDataFrame([(1, "a", None), (2, "a", 1), (2, "b", 1), (3, "a", 1), (3, "a", 1), (4, "a", 1),
                                (4, "z", 1), (5, "z", 1), (6, None, 1)], "sample int, mutation string, x int")
    catalogue = spark.createDataFrame([("a",), ("b",), ("a",)], "mutation string")
    got = aggregates.solo_filter(df, catalogue, ["mutation"]).collect()
    assert sorted((r.sample, r.mutation) for r in got) == [(1, "a"), (3, "a"), (4, "a")]


def test_long_arrays_are_not_cut(spark):
    from varigrade.operators.columns import array_to_columns

    df = spark.createDataFrame([([1, 2],), (None,), ([3],)], "v array<int>")
    assert [tuple(r) for r in array_to_columns(df, "v", "v", 2).collect()] == [(1, 2), (None, None), (3, None)]
    with pytest.raises(Exception, match="more than 1 elements"):
        array_to_columns(df, "v", "v", 1).collect()


def test_rows_without_descriptors_get_zeros(spark):
    from varigrade.operators.models import columns_to_vector

    df = spark.createDataFrame([(1.0, [2.0, 3.0]), (4.0, None)], "x double, embedding array<double>")
    rows = columns_to_vector(df).select("features").collect()
    assert [r.features.toArray().tolist() for r in rows] == [[1.0, 2.0, 3.0], [4.0, 0.0, 0.0]]


def test_dense_index_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 16).select(F.format_string("k%05d", F.col("id")).alias("value"))
    vocab = {r.value: r.id for r in encoding.build_vocab(df.union(df), "value").collect()}
    assert vocab == {f"k{i:05d}": i for i in range(5000)}


def test_vocab_defaults_and_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "x string")
    coded, lookup = encoding.category_codes(df, "x", "code")
    assert {r.x: r.code for r in coded.collect()} == {"a": 0, "b": 1, "c": 2, None: -1}
    part = lookup.filter("value <> 'c'")
    assert {r.x: r.id for r in encoding.encode_with_vocab(df, "x", part, "id").collect()}["c"] == 0
    assert [r.value for r in joins.anti_unseen_vocab(df, part, "x").collect()] == ["c"]


def test_one_hot_levels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    wide = encoding.one_hot(df, ["x"])
    assert wide.columns == ["x_a", "x_b"] and [tuple(r) for r in wide.collect()] == [(0, 1), (1, 0), (0, 0)]
    assert encoding.one_hot_drop_first(df, ["x"]).columns == ["x_b"]
    named = encoding.one_hot(df, ["x"], levels={"x": ["b", "z"]})
    assert named.columns == ["x_b", "x_z"] and [tuple(r) for r in named.collect()] == [(1, 0), (0, 0), (0, 0)]
    many = spark.range(6000).select(F.format_string("v%04d", "id").alias("x"))
    assert len(encoding.levels_of(many, "x")) == 6000


def test_coordinates_before_the_gene_and_missing(spark):
    loci = spark.createDataFrame([("Gene1", 100, 199), ("Gene1", 100, 199), ("GENE2", 1, 9)],
                                 "name string, start_pos bigint, stop_pos bigint")
    df = spark.createDataFrame([("Gene1", 96), ("Gene2", 5), ("Gene3", None)], "gene string, position bigint")
    rows = coordinates.attach_gene_coordinates(df, loci).collect()
    assert len(rows) == 4
    before = [r for r in rows if r.gene == "Gene1"][0]
    assert (before.codon_position, before.norm_position, before.distance_to_end) == (0, -0.03, 103)
    assert all(r.norm_position is None for r in rows if r.gene != "Gene1")


def test_mutation_key_modes(spark):
    df = spark.createDataFrame([("b", 12345678901), (None, 5), ("a", None)], "gene string, position bigint")
    assert [r.mutation_key for r in coordinates.mutation_key(df).collect()] == ["gene_b_12345678901", "gene_unknown_5", None]
    assert coordinates.mutation_key(df, compat=True).collect()[1].mutation_key == "gene_a_5"


def test_pruning_keeps_rows(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 9 + [(None,)], "gene string")
    pruned = encoding.prune_rare_categories(df, "gene")
    assert pruned.count() == 20 and pruned.filter("gene = 'a'").count() == 10 and pruned.filter("gene is null").count() == 10


def test_only_columns_that_may_hold_nulls_are_counted(spark, monkeypatch):
    """a flag per level can't be null, so a table with thousands of flags counts its other columns only."""
    from varigrade.operators import columns, encoding

    df = spark.createDataFrame([("a", 1, None), ("b", 2, 3.0), (None, 4, 5.0)], "gene string, n int, gappy double")
    counted, count = [], columns.null_counts
    monkeypatch.setattr(columns, "null_counts", lambda given: counted.extend(given.columns) or count(given))
    flags = encoding.one_hot(df, ["gene"])
    assert columns.drop_null_columns(flags).columns == ["n", "gene_a", "gene_b"] and counted == ["n", "gappy"]
    assert columns.drop_null_columns(flags.select("gene_a")).collect() == [(1,), (0,), (0,)]
