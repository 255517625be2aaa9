"""Queries over prediction logs and numeric features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrade.functions.scores import evidence_weight
from varigrade.operators import folds, metrics, statistics
from varigrade.plans.registry import STAGES, Tables, query
from varigrade.sources import sinks

_ELEMENTS = [f"e{i}" for i in range(64)]

STAGES["labels_seen"] = """
    SELECT l.fold, l.label, count(*) FILTER (g.actual = l.label) AS support,
        count(*) FILTER (g.predicted = l.label) AS chosen, count(*) FILTER (g.actual = l.label AND g.predicted = l.label) AS hits
    FROM (SELECT DISTINCT fold, actual AS label FROM log UNION SELECT DISTINCT fold, predicted FROM log) l
    JOIN log g ON g.fold = l.fold GROUP BY l.fold, l.label"""
STAGES["label_scores"] = """
    SELECT *, CASE WHEN chosen = 0 THEN 0 ELSE hits / chosen END AS p, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r,
        CASE WHEN support + chosen = 0 THEN 0 ELSE 2 * hits / (support + chosen) END AS f FROM labels_seen"""
STAGES["cells"] = """
    SELECT a.v AS actual, b.v AS predicted, count(g.doc_id) AS n
    FROM (VALUES (0), (1), (2), (3)) AS a(v) CROSS JOIN (VALUES (0), (1), (2), (3)) AS b(v)
    LEFT JOIN log g ON g.actual = a.v AND g.predicted = b.v GROUP BY a.v, b.v"""
STAGES["model_recalls"] = """
    SELECT model, fold, actual, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END) AS recall, count(*) AS n,
        count(*) FILTER (actual = predicted) AS hits FROM models_log GROUP BY model, fold, actual"""
STAGES["model_folds"] = """
    SELECT model, fold, sum(hits) / sum(n) AS accuracy, avg(recall) AS balanced FROM model_recalls GROUP BY model, fold"""
STAGES["long_elements"] = """
    SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"""
STAGES["element_pairs"] = """
    SELECT concat('e', p.i) AS a, concat('e', q.i) AS b, abs(corr(p.x, q.x)) AS r
    FROM long_elements p JOIN long_elements q ON p.vec_id = q.vec_id AND p.i <> q.i GROUP BY p.i, q.i"""
STAGES["top_features"] = """
    SELECT a AS feature FROM (SELECT * FROM element_pairs ORDER BY r DESC, a, b LIMIT 40) GROUP BY a
    ORDER BY max(r) DESC, a LIMIT 20"""
STAGES["ratios"] = """
    SELECT i AS component, v / sum(v) OVER () AS ratio FROM (SELECT i, var_pop(x) AS v FROM long_elements GROUP BY i)"""


def elements(t: Tables) -> DataFrame:
    return t["embeddings"].select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_ELEMENTS)])


def model_log(t: Tables) -> DataFrame:
    """The prediction log of two models."""
    log = t["predictions"]
    shifted = log.withColumn("predicted", (F.col("predicted") + 1) % 4)
    return metrics.union_folds([log.withColumn("model", F.lit("a")), shifted.withColumn("model", F.lit("b"))])


# prediction logs

@query("SELECT *, actual = predicted AS correct FROM log")
def flag_correct(t):
    return metrics.flag_correct(t["predictions"])


@query("SELECT * FROM models_log")
def union_folds(t):
    return model_log(t)


@query("SELECT * FROM cells")
def confusion_matrix(t):
    return metrics.confusion_matrix(t["predictions"])


@query("""SELECT actual, CAST(sum(n) FILTER (predicted = 0) AS BIGINT) AS predicted_0,
    CAST(sum(n) FILTER (predicted = 1) AS BIGINT) AS predicted_1,
    CAST(sum(n) FILTER (predicted = 2) AS BIGINT) AS predicted_2,
    CAST(sum(n) FILTER (predicted = 3) AS BIGINT) AS predicted_3 FROM cells GROUP BY actual""")
def confusion_pivot(t):
    return metrics.confusion_pivot(t["predictions"])


@query("SELECT actual, predicted, coalesce(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 0.0) AS share FROM cells")
def confusion_matrix_norm(t):
    return metrics.confusion_matrix_norm(t["predictions"])


@query("""SELECT fold, CAST(label AS VARCHAR) AS label, p AS "precision", r AS recall, f AS f1, support FROM label_scores
    UNION ALL SELECT fold, 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support),
        CAST(sum(support) AS BIGINT) FROM label_scores GROUP BY fold
    UNION ALL SELECT fold, 'macro avg', avg(p), avg(r), avg(f), CAST(sum(support) AS BIGINT) FROM label_scores GROUP BY fold
    UNION ALL SELECT fold, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
        sum(f * support) / sum(support), CAST(sum(support) AS BIGINT) FROM label_scores GROUP BY fold""")
def classification_report(t):
    return metrics.classification_report(t["predictions"], ["fold"])


@query("SELECT fold, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0 END) AS accuracy FROM log GROUP BY fold")
def accuracy(t):
    return metrics.accuracy(t["predictions"], ["fold"])


@query("SELECT fold, avg(r) AS balanced_accuracy FROM label_scores WHERE support > 0 GROUP BY fold")
def balanced_accuracy(t):
    return metrics.balanced_accuracy(t["predictions"], ["fold"])


@query("""SELECT f.model, f.accuracy, f.balanced_accuracy, p.pooled_accuracy, p.pooled_balanced_accuracy FROM (
        SELECT model, avg(accuracy) AS accuracy, avg(balanced) AS balanced_accuracy FROM model_folds GROUP BY model) f
    JOIN (SELECT model, sum(hits) / sum(n) AS pooled_accuracy, avg(hits / n) AS pooled_balanced_accuracy FROM (
        SELECT model, actual, sum(hits) AS hits, sum(n) AS n FROM model_recalls GROUP BY model, actual) GROUP BY model) p
    ON f.model = p.model ORDER BY f.accuracy DESC""")
def fold_summary(t):
    return metrics.fold_summary(model_log(t))


@query("""SELECT model, avg(accuracy) AS accuracy, avg(balanced) AS balanced_accuracy FROM model_folds GROUP BY model
    ORDER BY accuracy DESC""")
def model_comparison(t):
    return metrics.model_comparison(model_log(t))


@query("""SELECT event_type, round(avg(abs(actual - predicted)), 6) AS mae,
    round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 6) AS r2 FROM regression GROUP BY event_type""")
def mae_r2(t):
    scored = metrics.mae_r2(t["regression"], ["event_type"])
    return scored.select("event_type", F.round("mae", 6).alias("mae"), F.round("r2", 6).alias("r2"))


@query()
def sink_text_report(t):
    path = t.scratch("report")
    sinks.sink_text_report(metrics.report_lines(t["predictions"]), path)
    return t.spark.read.text(path)


# weights and scaling

@query("""SELECT variant, grade, (SELECT count(*) FROM merged WHERE grade IS NOT NULL)
        / ((SELECT count(DISTINCT grade) FROM merged) * count(*) OVER (PARTITION BY grade))
        * (3 * has_exact_mic + 1 + 2 * has_variant_mic) AS class_weight FROM merged WHERE grade IS NOT NULL""")
def class_weights_balanced(t):
    rows = t.merged.filter("grade is not null").select("variant", "grade", "has_exact_mic", "has_variant_mic")
    weight = evidence_weight(F.col("has_exact_mic"), F.col("has_variant_mic"))
    return statistics.class_weights_balanced(rows, "grade", weight=weight).drop("has_exact_mic", "has_variant_mic")


@query("""SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size,
    round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice,
    0.0::DOUBLE AS constant FROM numbers""")
def standardize(t):
    names = ["p_size", "p_retailprice", "constant"]
    scaled = statistics.standardize(t["numbers"].select("p_partkey", *names), names)
    return scaled.select("p_partkey", *[F.round(c, 6).alias(c) for c in names])


@query("""SELECT l_orderkey, l_linenumber, is_test,
    round((l_quantity - avg(l_quantity) FILTER (NOT is_test) OVER ()) / stddev_samp(l_quantity) FILTER (NOT is_test) OVER (), 6)
    AS l_quantity FROM (
        SELECT *, substr(md5(concat('42:', l_orderkey)), 1, 8) < '33333333' AS is_test FROM lineitem)""")
def zscore_target(t):
    rows = t["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity")
    train, test = statistics.zscore_target(*folds.random_split(rows, "l_orderkey"), "l_quantity")
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    return both.withColumn("l_quantity", F.round("l_quantity", 6))


# correlation and variance

@query("SELECT a, b, round(r, 6) AS r FROM element_pairs WHERE r < 1")
def corr_pairs(t):
    return statistics.corr_pairs(elements(t), _ELEMENTS).withColumn("r", F.round("r", 6))


@query("""SELECT a AS feature, round(max(r), 6) AS r FROM (SELECT * FROM element_pairs ORDER BY r DESC, a, b LIMIT 40)
    GROUP BY a ORDER BY max(r) DESC, a LIMIT 20""")
def topk_corr_features(t):
    top = statistics.topk_corr_features(statistics.corr_pairs(elements(t), _ELEMENTS))
    return top.withColumn("r", F.round("r", 6))


@query("""SELECT concat('e', p.i) AS a, concat('e', q.i) AS b, round(corr(p.x, q.x), 6) AS r
    FROM long_elements p JOIN long_elements q ON p.vec_id = q.vec_id
    WHERE concat('e', p.i) IN (SELECT feature FROM top_features) AND concat('e', q.i) IN (SELECT feature FROM top_features)
    GROUP BY p.i, q.i""")
def corr_submatrix(t):
    rows = elements(t)
    top = statistics.topk_corr_features(statistics.corr_pairs(rows, _ELEMENTS))
    names = [row.feature for row in top.collect()]  # at most ``features_kept``
    return statistics.corr_submatrix(rows, names).withColumn("r", F.round("r", 6))


@query("""SELECT CAST(component AS INTEGER) AS component, round(ratio, 6) AS ratio, round(upto, 6) AS cumulative,
    upto >= 0.95 AND upto - ratio < 0.95 AS reached
    FROM (SELECT *, sum(ratio) OVER (ORDER BY component) AS upto FROM ratios)""")
def cumulative_variance(t):
    long = t["embeddings"].select(F.posexplode("embedding").alias("component", "x"))
    spread = long.groupBy("component").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    total = spread.agg(F.sum("v")).scalar()
    summed = statistics.cumulative_variance(spread.select("component", (F.col("v") / total).alias("ratio")))
    return summed.select("component", F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"),
                         "reached")
