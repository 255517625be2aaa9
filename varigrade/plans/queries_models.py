"""Queries that fit models on whole tables; results are not SQL.

Every model is fitted at the library's sizes on all rows. The README has the times.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from varigrade.operators import boosting, components, metrics, models, networks
from varigrade.plans import evaluation
from varigrade.plans.registry import STAGES, Tables, query
from varigrade.session import materialize
from varigrade.sources import sinks

STAGES["quality_rows"] = """
    SELECT m.*, p.log2mic, d.drug_name FROM mutations m JOIN phenotypes p ON m.uniqueid = p.uniqueid
    LEFT JOIN drug_codes d ON p.drug = d.drug_code
    WHERE p.log2mic IS NOT NULL AND m.codes_protein AND p.phenotype_quality IS NOT NULL AND NOT m.is_minor
        AND m.ref IS NOT NULL AND m.alt IS NOT NULL"""


def _features(t: Tables):
    return evaluation.feature_tables(t.model, t["loci"], t["descriptors"])


def _grouped(t: Tables):
    return evaluation.grouped_rows(_features(t)[1])


def _vectors(t: Tables, *more: str):
    """Feature vectors of the positioned table; written once, since every pass starts from them."""
    return materialize(models.columns_to_vector(_features(t)[1]).select("features", *more), spread=True)


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS v0, p_retailprice AS v1, CAST(coalesce(gappy, 0) AS DOUBLE) AS v2 FROM numbers")
def columns_to_vector(t):
    numbers = t["numbers"].select("p_partkey", "p_size", "p_retailprice", "gappy")
    vectors = models.columns_to_vector(numbers, drop=("p_partkey",))
    array = vectors.select("p_partkey", vector_to_array("features").alias("v"))
    return array.select("p_partkey", *[F.col("v")[i].alias(f"v{i}") for i in range(3)])


@query()
def eda_matrix(t):
    return evaluation.eda_matrix(_features(t)[1])


@query()
def pca_explained(t):
    rows = _vectors(t)
    return components.explained(rows, components.fit_components(rows))


@query()
def pca_project(t):
    rows = _vectors(t)
    points = components.fit_components(rows, components=10).project(rows)
    return points.select(F.get("projection", F.lit(0)).alias("x"), F.get("projection", F.lit(1)).alias("y"))


@query()
def pca_keep_variance(t):
    rows = _vectors(t)
    return components.components_for(rows, 0.95).project(rows, output="kept")


@query("SELECT resistant, count(*) AS n FROM clean_rows GROUP BY resistant")
def pca_supports(t):
    """Points of the plane view by grade: every row of the feature table has one."""
    rows = _vectors(t, "resistant")
    points = components.fit_components(rows, components=2).project(rows)
    return points.filter(F.size("projection") == 2).groupBy("resistant").agg(F.count("*").alias("n"))


@query()
def rf_regress(t):
    clean = _features(t)[0]
    rows = models.columns_to_vector(clean).withColumn("row", F.xxhash64(*clean.columns))
    log = evaluation.forest_split(rows, "row", "ppv")
    return metrics.mae_r2(log, ["model"])


@query()
def rf_regress_grouped(t):
    rows = evaluation.grouped_rows(_features(t)[1], models.HOLDOUT_REGRESSION_DROP)
    return metrics.mae_r2(evaluation.forest_cv(rows, "ppv"), ["model", "fold"])


@query()
def rf_classify(t):
    return metrics.scores(evaluation.forest_cv(_grouped(t), "ppv_bin", classes=4), ["model", "fold"])


@query("""SELECT CASE WHEN ppv >= 0.8 THEN 3 WHEN ppv >= 0.6 THEN 2 WHEN ppv >= 0.2 THEN 1 ELSE 0 END AS actual,
    count(*) AS n FROM clean_rows GROUP BY ALL""")
def rf_supports(t):
    log = evaluation.forest_cv(_grouped(t), "ppv_bin", classes=4, trees=10)
    return log.groupBy("actual").agg(F.count("predicted").alias("n"))


@query()
def logreg_classify(t):
    log = models.grouped_cv(_grouped(t), [models.logreg_classify()], "ppv_bin")
    return metrics.classification_report(log, ["fold"])


@query()
def pca_logreg(t):
    clean, _, lookup = _features(t)
    rows = evaluation.holdout_rows(clean)
    codes = [r.id for r in lookup.filter(F.col("value").isin(list(models.HELD_OUT_DRUGS))).collect()]
    train, test = models.isin_split(rows, "drug", codes)
    return metrics.confusion_matrix_norm(models.pca_logreg(train, test))


@query()
def mlp_classify(t):
    log, _ = evaluation.network_cv(_grouped(t), "ppv_bin", classes=4)
    return metrics.scores(log, ["model", "fold"])


@query("""SELECT CASE WHEN ppv >= 0.8 THEN 3 WHEN ppv >= 0.6 THEN 2 WHEN ppv >= 0.2 THEN 1 ELSE 0 END AS actual,
    count(*) AS n, count(DISTINCT CASE WHEN position IS NULL THEN 'unknown_mutation'
        ELSE concat('gene_', coalesce(gene, 'unknown'), '_', position) END) AS n_mutations FROM clean_rows GROUP BY ALL""")
def mlp_supports(t):
    log, _ = evaluation.network_cv(_grouped(t), "ppv_bin", classes=4)
    return log.groupBy("actual").agg(F.count("predicted").alias("n"), F.countDistinct("mutation").alias("n_mutations"))


@query()
def nn_regress(t):
    log, _ = evaluation.network_cv(_grouped(t), "ppv")
    return metrics.mae_r2(log, ["model", "fold"])


@query()
def gbt_regress(t):
    log = models.grouped_cv(_grouped(t), [models.gbt_regress()], "ppv", whole=False)
    return metrics.mae_r2(log, ["model", "fold"])


@query()
def boost_classify(t):
    log = evaluation.boosting_log(evaluation.boosting_table(_features(t)[1]))
    return metrics.model_comparison(log)


@query("""SELECT model, CASE WHEN ppv >= 0.8 THEN 3 WHEN ppv >= 0.6 THEN 2 WHEN ppv >= 0.2 THEN 1 ELSE 0 END AS actual,
    count(*) AS n, count(DISTINCT CASE WHEN position IS NULL THEN 'unknown_mutation'
        ELSE concat('gene_', coalesce(gene, 'unknown'), '_', position) END) AS n_mutations
    FROM clean_rows c LEFT JOIN (SELECT name, stop_pos FROM loci WHERE name IN (SELECT gene FROM clean_rows)) l
        ON lower(c.gene) = lower(l.name), (VALUES ('boosted_stumps'), ('boosted_depth3')) m(model)
    WHERE position IS NOT NULL AND stop_pos IS NOT NULL AND has_descriptor = 1 AND mean_log2mic_final IS NOT NULL
    GROUP BY ALL""")
def boost_supports(t):
    """A few rounds on all rows, fitted by passes over the whole table."""
    few = [replace(s, rounds=3) for s in boosting.SETTINGS[:2]]
    log = evaluation.boosting_log(evaluation.boosting_table(_features(t)[1]), few)
    return log.groupBy("model", "actual").agg(F.count("predicted").alias("n"), F.countDistinct("mutation").alias("n_mutations"))


def _encoded(t: Tables):
    return evaluation.encoded_measurements(t["mutations"], t["phenotypes"], t["drug_codes"])


@query()
def mic_embedding_regress(t):
    return evaluation.measurement_scores(evaluation.fit_measurements(_encoded(t)[0]).log)


@query("""SELECT CASE WHEN substr(md5(concat('42:', uniqueid)), 1, 8) < '33333333' THEN 'validation' ELSE 'train' END AS part,
    count(*) AS n FROM quality_rows GROUP BY ALL""")
def mic_supports(t):
    """Each epoch of a short run stands for every measurement once."""
    few = networks.Training(epochs=2, decay=0.0)
    log = evaluation.fit_measurements(_encoded(t)[0], few).log
    return log.groupBy("part").agg(F.sum("n").alias("n"))


@query()
def resume_training(t):
    """Losses by epoch of a run that is cut after three epochs and goes on from its stored state, vocabularies included."""
    ids, vocabularies = _encoded(t)
    training, store = networks.Training(epochs=8, decay=0.0), sinks.StateStore(t.spark, t.scratch("state"))
    evaluation.fit_measurements(ids, training, store, stop_after=3)
    store.save_vocabularies(vocabularies)
    known = store.load_vocabularies(tuple(evaluation.VOCABULARIES))
    again, _ = evaluation.encoded_measurements(t["mutations"], t["phenotypes"], t["drug_codes"], known)
    return evaluation.fit_measurements(again, training, store).losses


@query("""SELECT m.uniqueid, coalesce(g.id, 0) AS gene_id, coalesce(n.id, 0) AS pos_id,
    CAST(coalesce(nullif(instr('ARNDCQEGHILKMFPSTWYVX', m.ref), 0) - 1, 20) AS INTEGER) AS wt_aa,
    CAST(coalesce(nullif(instr('ARNDCQEGHILKMFPSTWYVX', m.alt), 0) - 1, 20) AS INTEGER) AS mut_aa,
    coalesce(d.id, 0) AS drug_id, CAST(m.log2mic AS FLOAT) AS log2mic
    FROM quality_rows m LEFT JOIN (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS id FROM (SELECT DISTINCT gene FROM quality_rows)) g
        ON m.gene = g.gene
    LEFT JOIN (SELECT amino_acid_number AS a, row_number() OVER (ORDER BY amino_acid_number) - 1 AS id FROM (SELECT DISTINCT amino_acid_number FROM quality_rows)) n
        ON m.amino_acid_number = n.a
    LEFT JOIN (SELECT drug_name, row_number() OVER (ORDER BY drug_name) - 1 AS id FROM (SELECT DISTINCT drug_name FROM quality_rows WHERE drug_name IS NOT NULL)) d
        ON m.drug_name = d.drug_name""")
def encoded_measurements(t):
    return evaluation.encoded_measurements(t["mutations"], t["phenotypes"], t["drug_codes"])[0]


@query()
def grouped_cv(t):
    return models.grouped_cv(_grouped(t), [models.logreg_classify()], "ppv_bin")


@query("""SELECT CASE WHEN ppv >= 0.8 THEN 3 WHEN ppv >= 0.6 THEN 2 WHEN ppv >= 0.2 THEN 1 ELSE 0 END AS actual,
    concat('gene_', coalesce(gene, 'unknown'), '_', position) AS key, count(*) AS n
    FROM clean_rows WHERE position IS NOT NULL GROUP BY ALL
    UNION ALL SELECT CASE WHEN ppv >= 0.8 THEN 3 WHEN ppv >= 0.6 THEN 2 WHEN ppv >= 0.2 THEN 1 ELSE 0 END,
    'unknown_mutation', count(*) FROM clean_rows WHERE position IS NULL GROUP BY ALL""")
def prediction_log(t):
    log = models.grouped_cv(_grouped(t), [models.logreg_classify()], "ppv_bin")
    return log.groupBy("actual", F.col("mutation").alias("key")).agg(F.count("predicted").alias("n"))


@query()
def drug_holdout_eval(t):
    clean, _, lookup = _features(t)
    learner = models.logreg_classify(c=1.0, weighting="balanced")
    return metrics.classification_report(models.drug_holdout_eval(evaluation.holdout_rows(clean), lookup, learner))


@query()
def save_load_model(t):
    rows = models.labelled(_grouped(t), "ppv_bin")
    path = t.scratch("model")
    vocabulary = rows.select(F.col("mutation_key").alias("value")).distinct()
    sinks.save_model(models.logreg_classify().fit(rows), {"mutation": vocabulary}, path)
    model, saved = sinks.load_model(t.spark, path, ("mutation",))
    predicted = models.predict(model, rows).groupBy("mutation_key").agg(F.avg("prediction").alias("mean_prediction"))
    return predicted.join(saved["mutation"].withColumnRenamed("value", "mutation_key"), "mutation_key")
