"""Invariants of the fits and of the evaluation loops."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from varigrade.operators import metrics, models
from varigrade.plans import queries_models
from varigrade.plans.catalog import QUERIES
from varigrade.sources import sinks


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select(
        (F.col("id") % 4).cast("int").alias("ppv_bin"), ((F.col("id") % 4) * 0.25).alias("ppv"),
        F.when(F.col("id") % 50 != 0, F.concat(F.lit("g"), F.col("id") % 4)).alias("gene"),
        (F.col("id") % 7).cast("double").alias("noise"), F.lit(1).alias("constant"),
        (F.col("id") % 2).cast("int").alias("has_exact_mic"), F.lit(0).alias("has_variant_mic"),
        F.concat(F.lit("m"), F.col("id") % 40).alias("mutation_key"), ((F.col("id") % 40) % 5).cast("int").alias("fold"))
    return models.columns_to_vector(df, (*models.BASELINE_DROP, "fold")).cache()


def test_vector_layout(rows):
    # noise, constant, two evidence flags, four gene slots
    assert models.vector_width(rows, "features") == 8
    none = rows.filter("gene is null").select(vector_to_array("features").alias("v")).first().v
    assert list(none[4:]) == [0.0, 0.0, 0.0, 0.0]


def test_grouped_cv_predicts_each_row_once_on_unseen_groups(rows):
    log = models.grouped_cv(rows, [models.logreg_classify(iterations=30)], "ppv_bin").cache()
    assert log.count() == 400
    assert log.groupBy("mutation").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert metrics.accuracy(log).first()[0] > 0.95
    direct = log.filter("actual = predicted").count() / 400
    assert metrics.accuracy(log).first()[0] == pytest.approx(direct)


def test_weights(rows):
    learner = models.rf_classify(trees=2, depth=2)
    weighted = learner.prepare(models.labelled(rows, "ppv_bin"))
    spread = weighted.groupBy("label", "has_exact_mic").agg(F.countDistinct("weight").alias("n"), F.first("weight").alias("w"))
    by = {(r.label, r.has_exact_mic): (r.n, r.w) for r in spread.collect()}
    assert all(n == 1 for n, _ in by.values())
    assert by[1.0, 1][1] == 4.0 and by[0.0, 0][1] == 1.0


def test_unknown_text_columns_are_refused(spark):
    df = spark.createDataFrame([("x", 1.0)], "colour string, n double")
    with pytest.raises(ValueError, match="colour"):
        models.columns_to_vector(df, drop=())
    assert models.vector_width(models.columns_to_vector(df, drop=("colour",)), "features") == 1


@pytest.mark.parametrize("learner", [
    models.rf_classify(trees=5, depth=4),
    models.boost_classify(iterations=3, depth=2),
])
def test_classifiers_learn(rows, learner):
    train, test = rows.filter("fold <> 0"), rows.filter("fold = 0")
    log = models.split_eval(train, test, learner, "ppv_bin", group="mutation_key")
    assert log.count() == test.count()
    # a tenth of the test rows has no gene, hence nothing to learn from
    assert metrics.accuracy(log).first()[0] >= 0.9


@pytest.mark.parametrize("learner", [models.rf_regress(trees=5, depth=4), models.gbt_regress(iterations=5, depth=3)])
def test_regressors_learn(rows, learner):
    log = models.split_eval(rows.filter("fold <> 0"), rows.filter("fold = 0"), learner, "ppv", "mutation_key", whole=False)
    assert metrics.mae_r2(log).first().r2 > 0.8


@pytest.mark.parametrize("name, expected", [
    ("gbt_regress", [(500, 5)])])
def test_registered_fits_have_the_full_size(rows, monkeypatch, name, expected):
    class Started(Exception):
        pass

    def caught(*given, **more):
        raise Started(next(x for x in given if isinstance(x, models.Learner) or isinstance(x, list)))

    plain = rows.drop("features")
    monkeypatch.setattr(models, "grouped_cv", caught)
    monkeypatch.setattr(models, "split_eval", caught)
    monkeypatch.setattr(queries_models, "_features", lambda t: (plain, plain, None))
    monkeypatch.setattr(queries_models.evaluation, "grouped_rows", lambda df, *drop: rows)
    with pytest.raises(Started) as found:
        QUERIES[name](rows.sparkSession, "unused")
    learners = found.value.args[0]
    sizes = []
    for learner in learners if isinstance(learners, list) else [learners]:
        made = learner.build(rows)
        made = made.getClassifier() if hasattr(made, "getClassifier") else made
        sizes.append((made.getNumTrees() if hasattr(made, "getNumTrees") else made.getMaxIter(),
                      made.getMaxDepth() if hasattr(made, "getMaxDepth") else None))
    assert sizes == expected


def test_saved_model_predicts_the_same(spark, rows, tmp_path):
    labelled = models.labelled(rows, "ppv_bin")
    model = models.logreg_classify(iterations=10).fit(labelled)
    vocabulary = spark.createDataFrame([("a", 0)], "value string, id bigint")
    sinks.save_model(model, {"gene": vocabulary}, str(tmp_path / "m"))
    loaded, saved = sinks.load_model(spark, str(tmp_path / "m"), ("gene",))
    before = [r.prediction for r in models.predict(model, labelled).select("prediction").collect()]
    after = [r.prediction for r in models.predict(loaded, labelled).select("prediction").collect()]
    assert before == after and saved["gene"].collect() == [("a", 0)]


def test_drug_holdout_scores_only_held_out_drugs(spark):
    df = spark.range(200).select(
        (F.col("id") % 4).cast("int").alias("drug"), (F.floor(F.col("id") / 4) % 2).cast("int").alias("resistant"),
        (F.floor(F.col("id") / 4) % 2).cast("double").alias("x"), F.lit("g").alias("gene"),
        F.lit(0).alias("has_exact_mic"), F.lit(0).alias("has_variant_mic"))
    vectors = models.columns_to_vector(df.drop("gene"), models.BASELINE_DROP).withColumn("gene", F.lit("g"))
    lookup = spark.createDataFrame([("Amikacin", 0), ("Isoniazid", 1), ("Kanamycin", 2), ("Rifampicin", 3)], "value string, id int")
    learner = models.logreg_classify(c=1.0, weighting="balanced", iterations=10)
    log = models.drug_holdout_eval(vectors, lookup, learner)
    assert log.count() == 100 and metrics.accuracy(log).first()[0] == 1.0


def test_components(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"),
                                 (F.col("id") % 3).cast("double").alias("c"))
    vectors = models.columns_to_vector(df, drop=())
    ratios = [r.ratio for r in models.pca_explained(vectors).orderBy("component").collect()]
    assert sum(ratios) == pytest.approx(1) and ratios[0] == pytest.approx(2 / 3, abs=0.01)
    kept = models.VarianceKept(0.95).fit(vectors).transform(vectors)
    assert models.vector_width(kept, "kept") == 2
    centre = models.pca_project(vectors).select(F.avg(vector_to_array("projection")[0])).first()[0]
    assert centre == pytest.approx(0, abs=1e-9)
    assert models.components_for_share([0.5, 0.45, 0.05], 0.95) == 2
