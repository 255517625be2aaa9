"""Metrics over a prediction log (fold, group, actual, predicted). All accept ``by`` columns (model, fold),
so one job scores every model and fold. Every metric starts from the counts per (by, actual, predicted).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = (0, 1, 2, 3)


def flag_correct(log: DataFrame) -> DataFrame:
    return log.withColumn("correct", F.col("actual") == F.col("predicted"))


def union_folds(logs: Sequence[DataFrame]) -> DataFrame:
    """Stack prediction logs by column name."""
    return reduce(DataFrame.unionByName, logs)


def outcome_counts(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return log.groupBy(*by, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(log: DataFrame, labels: Sequence[int] = LABELS, by: Sequence[str] = ()) -> DataFrame:
    """Counts over the full label grid, zero where a pair never occurs; labels off the grid are left out."""
    cell = F.struct("actual", "predicted")
    on_grid = log.filter(F.col("actual").isin(list(labels)) & F.col("predicted").isin(list(labels)))
    counts = outcome_counts(on_grid, by).groupBy(*by).agg(F.map_from_entries(F.collect_list(
        F.struct(cell.alias("key"), F.col("n").alias("value")))).alias("_cells"))
    kind = log.schema["actual"].dataType
    grid = F.explode(F.array(*[
        F.struct(F.lit(a).cast(kind).alias("actual"), F.lit(p).cast(kind).alias("predicted"))
        for a in labels for p in labels])).alias("_cell")
    return counts.select(*by, "_cells", grid).select(
        *by, "_cell.actual", "_cell.predicted",
        F.coalesce(F.try_element_at("_cells", F.col("_cell")), F.lit(0)).alias("n"))


def confusion_matrix_norm(log: DataFrame, labels: Sequence[int] = LABELS, by: Sequence[str] = ()) -> DataFrame:
    """Confusion shares per actual label; a label that never occurs has zero shares."""
    cells = confusion_matrix(log, labels, by)
    totals = cells.groupBy(*by, "actual").agg(F.sum("n").alias("_total"))
    return cells.join(totals, [*by, "actual"]).select(
        *by, "actual", "predicted",
        F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("_total").cast("double")), F.lit(0.0)).alias("share"))


def confusion_pivot(log: DataFrame, labels: Sequence[int] = LABELS, by: Sequence[str] = ()) -> DataFrame:
    """The confusion matrix with one ``predicted_<label>`` column per label."""
    wide = [F.sum(F.when(F.col("predicted") == p, F.col("n"))).alias(f"predicted_{p}") for p in labels]
    return confusion_matrix(log, labels, by).groupBy(*by, "actual").agg(*wide)


def class_scores(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per label seen as actual or predicted: precision, recall, F1 (0 when undefined) and support."""
    return _scores_of_counts(outcome_counts(log, by), by)


def _scores_of_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), zero.alias("chosen"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), F.col("n").alias("chosen"), zero.alias("hits")),
    )).alias("_side")
    totals = counts.select(*by, sides).select(*by, "_side.*").groupBy(*by, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "chosen", "hits")])

    def ratio(part, whole):
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    hits, support, chosen = F.col("hits"), F.col("support"), F.col("chosen")
    return totals.withColumns({
        "precision": ratio(hits, chosen), "recall": ratio(hits, support),
        "f1": ratio(2 * hits, support + chosen),
    })


def classification_report(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``class_scores`` rows followed by accuracy, macro and weighted averages, keyed by ``label`` text."""
    scores = class_scores(log, by)
    names = ("precision", "recall", "f1")
    rows = scores.select(*by, F.col("label").cast("string").alias("label"), *names, "support")
    support = F.col("support")
    accuracy = (F.sum("hits") / F.sum(support))
    sums = scores.groupBy(*by).agg(
        *[accuracy.alias(f"accuracy_{m}") for m in names],
        *[F.avg(m).alias(f"macro avg_{m}") for m in names],
        *[(F.sum(F.col(m) * support) / F.sum(support)).alias(f"weighted avg_{m}") for m in names],
        F.sum(support).alias("support"))
    kinds = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("label"), *[F.col(f"{kind}_{m}").alias(m) for m in names])
        for kind in ("accuracy", "macro avg", "weighted avg")])).alias("_s")
    return rows.unionByName(sums.select(*by, kinds, "support").select(*by, "_s.*", "support"))


def accuracy(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of correct rows."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)))
    return outcome_counts(log, by).groupBy(*by).agg((hit / F.sum("n")).alias("accuracy"))


def balanced_accuracy(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the labels that occur as actual."""
    return class_scores(log, by).filter("support > 0").groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def scores(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and balanced accuracy side by side."""
    return _both_accuracies(outcome_counts(log, by), by)


def _both_accuracies(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return _scores_of_counts(counts, by).groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))


def fold_summary(log: DataFrame, model: str = "model", fold: str = "fold") -> DataFrame:
    """Per model, best first: mean over the folds of both accuracies, and the same pooled over all rows.

    The log is counted once; each count stands for its fold and for the pool.
    """
    parts = F.explode(F.array(
        F.struct(F.lit(False).alias("pooled"), F.col(fold).alias("part")),
        F.struct(F.lit(True).alias("pooled"), F.lit(None).alias("part")))).alias("_p")
    counts = outcome_counts(log, [model, fold]).select(model, "actual", "predicted", "n", parts).select(
        model, "actual", "predicted", "n", "_p.*")
    found = _both_accuracies(counts, [model, "pooled", "part"])
    measures = ("accuracy", "balanced_accuracy")
    return found.groupBy(model).agg(
        *[F.avg(F.when(~F.col("pooled"), F.col(m))).alias(m) for m in measures],
        *[F.max(F.when(F.col("pooled"), F.col(m))).alias(f"pooled_{m}") for m in measures],
    ).orderBy(F.desc("accuracy"), model)


def model_comparison(log: DataFrame, model: str = "model", fold: str = "fold") -> DataFrame:
    """(model, accuracy, balanced_accuracy) averaged over folds, best first."""
    return scores(log, [model, fold]).groupBy(model).agg(
        *[F.avg(m).alias(m) for m in ("accuracy", "balanced_accuracy")]).orderBy(F.desc("accuracy"), model)


def mae_r2(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error and 1 - SSE/SST; R2 is null for a constant target."""
    actual, predicted = F.col("actual"), F.col("predicted")
    return log.groupBy(*by).agg(
        F.avg(F.abs(actual - predicted)).alias("mae"),
        (1 - F.try_divide(F.sum((actual - predicted) ** 2), F.var_pop(actual) * F.count(actual))).alias("r2"))


def report_lines(log: DataFrame, group: str = "mutation") -> DataFrame:
    """Text report as rows (fold, ord, line): unseen groups, class table and balanced accuracy per fold."""
    from varigrade.operators.folds import fold_unseen_groups

    heads = fold_unseen_groups(log, group).select("fold", F.posexplode(F.concat(
        F.array(F.format_string("=== Fold %d ===", "fold"),
                F.format_string("Number of unseen mutations: %d", "n_unseen"), F.lit("Sample mutations:")),
        "sample")).alias("ord", "line"))
    table = classification_report(log, ["fold"])
    body = table.select(
        "fold", (F.lit(1000) + F.row_number().over(_report_order())).alias("ord"),
        F.format_string("%14s %9.2f %9.2f %9.2f %9d", "label", "precision", "recall", "f1", "support").alias("line"))
    head = body.select("fold", F.lit(1000).alias("ord"), F.format_string(
        "%14s %9s %9s %9s %9s", *[F.lit(t) for t in ("", "precision", "recall", "f1-score", "support")]
    ).alias("line")).distinct()
    tail = balanced_accuracy(log, ["fold"]).select(
        "fold", F.lit(2000).alias("ord"), F.format_string("Balanced Accuracy: %.3f", "balanced_accuracy").alias("line"))
    return reduce(DataFrame.unionByName, [heads, head, body, tail])


def _report_order():
    from pyspark.sql import Window

    return Window.partitionBy("fold").orderBy(
        F.col("label").isin("accuracy", "macro avg", "weighted avg"), "label")
