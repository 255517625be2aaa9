"""Queries fit on all their rows, with all epochs and components."""

from unittest.mock import MagicMock
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from test_boosting import SETTINGS, encoded, scores_of
from test_boosting import table as boosted_rows  # noqa: F401
from test_components import dense, table

from varigrade.operators import boosting, components, forests, models, networks
from varigrade.plans import evaluation, queries_models
from varigrade.plans.catalog import QUERIES
from varigrade.session import materialize


class Asked(Exception):
    pass


@pytest.fixture
def asked(monkeypatch):
    """What a query gives to a fit; neither features nor fits are made."""
    def call(module, name, query):
        def stop(*given, **named):
            raise Asked(given, named)

        for made in ("_features", "_grouped", "_vectors"):
            monkeypatch.setattr(queries_models, made, lambda *given: (MagicMock(), None))
        monkeypatch.setattr(evaluation, "boosting_table", lambda rows: rows)
        monkeypatch.setattr(module, name, stop)
        with pytest.raises(Asked) as found:
            QUERIES[query](None, "")
        return found.value.args

    return call


def test_boost_classify_fits_all_rows(asked):
    given, named = asked(boosting, "fit_boosters", "boost_classify")
    assert named["sample_rows"] is None and given[1] == boosting.SETTINGS


def test_passes_over_many_rows_grow_the_trees_of_few_rows(boosted_rows, monkeypatch):  # noqa: F811
    def fit():
        return boosting.fit_boosters(boosted_rows, SETTINGS, "label", "weight", ["mutation"], folds=2)

    few = fit()
    for name, value in (("ALONE", 0), ("KEEP", 2), ("CHECKPOINT", 4), ("BLOCK", 50), ("DIRECT", 1)):
        monkeypatch.setattr(boosting, name, value)
    monkeypatch.setattr(boosting, "_grow_apart", None)
    many, bins = fit(), encoded(few, boosted_rows)[0]
    for number in range(2 * len(SETTINGS)):
        assert scores_of(many, bins, number) == pytest.approx(scores_of(few, bins, number), abs=1e-4)


def test_mlp_supports_trains_to_its_end(asked):
    _, named = asked(evaluation, "network_cv", "mlp_supports")
    assert named.get("training", networks.Training()) == networks.Training()


@pytest.mark.parametrize("direct", [4096, 0])
def test_all_components(spark, monkeypatch, direct):
    monkeypatch.setattr(components, "DIRECT_WIDTH", direct)
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(400, 90)) * (rng.random((400, 90)) < 0.3)).astype(np.float32).astype(np.float64)
    x[:, 7] = 1.0
    found = components.fit_components(table(spark, x))
    assert len(found.values) == 89 and found.ratios == pytest.approx(dense(x)[0], abs=1e-8)


def test_pca_explained_gives_all_components(asked):
    given, named = asked(components, "fit_components", "pca_explained")
    assert len(given) == 1 and not named


@pytest.mark.parametrize("module", [networks, boosting])
def test_packed_blocks_lie_in_small_row_groups(spark, monkeypatch, module):
    """A task reads a row group at once, whatever the number of blocks in its part."""
    files = []

    def kept(df, **how):
        out = materialize(df, **how)
        files.extend(out.inputFiles())
        return out

    monkeypatch.setattr(module, "materialize", kept)
    monkeypatch.setattr(module, "BLOCK", 1000)
    numbers = F.transform(F.sequence(F.lit(1), F.lit(600)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(100_003)).cast("double"))
    rows = spark.range(0, 12_000, 1, 1).select("id", numbers.alias("x"), F.lit(1.0).alias("weight"),
                                               (F.col("id") % 2).cast("int").alias("fold"))
    if module is networks:
        vectors = rows.select(array_to_vector("x").alias("x"))
        module.blocks_of(vectors, "x", (), F.lit(0.0), F.lit(1.0), F.lit(0), F.lit(False), 1)
    else:
        wide = rows.select("x", "weight", "fold", (F.col("id") % 2).cast("int").alias("label"))
        module.fit_boosters(wide, [boosting.Setting("a", rounds=1, depth=1)], "label", "weight", [], folds=2, classes=2)
    groups = [pq.ParquetFile(urlparse(f).path).metadata for f in files]
    sizes = [m.row_group(k).total_byte_size for m in groups for k in range(m.num_row_groups)]
    assert sum(sizes) > 13e6 and max(sizes) < 12e6


def test_sums_of_passes_are_added_up_by_slices(spark, monkeypatch):
    monkeypatch.setattr(networks, "SLICE", 7)
    parts = spark.sparkContext.parallelize(range(50), 50)
    one = np.random.default_rng(1).normal(size=(3, 9))
    assert networks._summed(parts.map(lambda k: one * k)) == pytest.approx(one * 1225)
    assert networks._summed(parts.map(lambda k: one * k if k == 3 else np.zeros((0, 0)))).tolist() == (one * 3).tolist()
    assert networks._summed(parts.map(lambda k: np.zeros((0, 0)))).shape == (0, 0)


@pytest.mark.parametrize("query", ["rf_classify", "rf_regress_grouped", "rf_supports", "rf_regress"])
def test_forest_queries_fit_all_rows(spark, asked, monkeypatch, query):
    monkeypatch.setattr(models, "columns_to_vector", MagicMock())
    monkeypatch.setattr(evaluation, "grouped_rows", MagicMock())
    given, named = asked(evaluation, "forest_split" if query == "rf_regress" else "forest_cv", query)
    assert given[-1] in ("ppv", "ppv_bin") and "sample_rows" not in named and named.get("trees", 200) == (10 if query == "rf_supports" else 200)


@pytest.fixture(scope="module")
def forest_rows(spark):
    """A label by two categories and a number that no coarse bins tell apart; some rows twice, some without label or fold."""
    df = spark.range(3000).select(
        F.col("id"), F.concat(F.lit("g"), F.col("id") % 5).alias("gene"), F.concat(F.lit("r"), F.col("id") % 3).alias("ref"),
        (F.floor(F.col("id") / 2) * 0.001).alias("number"), (F.floor(F.col("id") / 7) % 5).cast("int").alias("fold"),
        F.lit(1).alias("has_exact_mic"), F.lit(0).alias("has_variant_mic"), F.concat(F.lit("m"), F.col("id")).alias("mutation_key"))
    kind = (F.col("id") % 5 % 2) * 2 + (F.col("number") > 0.7505).cast("int")
    df = df.withColumns({"ppv_bin": F.when(F.col("id") % 50 != 3, kind).cast("int"), "fold": F.when(F.col("id") != 8, F.col("fold"))})
    df = df.withColumn("ppv", F.col("ppv_bin") * 0.25)
    vectors = models.columns_to_vector(df, (*models.BASELINE_DROP, "fold", "id"))
    return materialize(vectors.repartition(3))


@pytest.mark.parametrize("bins", [256, 2])
@pytest.mark.parametrize("target,classes", [("ppv_bin", 4), ("ppv", 0)])
@pytest.mark.parametrize("spread", [True, False])
def test_forests_on_all_rows(forest_rows, monkeypatch, spread, target, classes, bins):
    if spread:
        for name, value in (("ENTRIES", 0), ("BINS", bins), ("SMALL", 256), ("BLOCK", 300), ("SUMS", 3000), ("ON_THE_WAY", 12_000)):
            monkeypatch.setattr(forests, name, value)
        monkeypatch.setattr(forests, "_broadcast_sums", None)
    elif bins == 2:
        pytest.skip("no bins are made")
    log = evaluation.forest_cv(forest_rows, target, classes=classes, trees=3).toPandas()
    assert len(log) == 2999 and log.mutation.is_unique and log.predicted.notna().all()
    known = log[log.actual.notna()]
    wrong = known[(known.actual - known.predicted).abs() > 0.01]
    assert len(known) == 2999 - 60 and len(wrong) <= 60


def test_a_forest_uses_rows_beyond_any_sample(spark):
    """A single row in 4,000 has the feature that its held-out twin shows."""
    df = spark.range(4001).select(
        F.when(F.col("id") % 4000 == 0, 7.0).otherwise(0.0).alias("number"), F.when(F.col("id") % 4000 == 0, 1.0).otherwise(0.0).alias("ppv"),
        F.col("id").cast("string").alias("mutation_key"), F.when(F.col("id") == 4000, 0).otherwise(1).alias("fold"),
        F.lit(0).alias("has_exact_mic"), F.lit(0).alias("has_variant_mic"))
    rows = models.columns_to_vector(df, (*models.BASELINE_DROP, "fold", "has_exact_mic", "has_variant_mic"))
    log = evaluation.forest_cv(rows, "ppv", folds=1, trees=40)
    assert log.count() == 1 and 0.35 < log.first().predicted < 0.9  # in 63 of 100 bags


def test_split_search_in_slices_of_features(monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 5, (60, 9)).astype(np.float32), rng.normal(size=60)
    whole = forests.best_split(x, forests.totals(y, np.ones(60), 0))
    monkeypatch.setattr(forests, "SEARCHED", 130)
    assert forests.best_split(x, forests.totals(y, np.ones(60), 0)) == whole
