"""Boosting by passes and by task against a plain booster that looks at every split row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varigrade.operators import boosting, metrics

SETTINGS = (boosting.Setting("a", rounds=9, depth=1, step=0.5), boosting.Setting("b", rounds=6, depth=3))
COLUMNS = "x double, y int, z double, colour string, v array<float>, label int, weight double, fold int, mutation string"


def rows_of(n, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        x, y, colour = float(rng.integers(0, 9)), int(rng.integers(0, 4)), str(rng.choice(["red", "green", "blue"]))
        label = int((x > 4) + 2 * (colour == "red")) if rng.random() < 0.8 else int(rng.integers(0, 4))
        out.append((None if k % 17 == 0 else x, y, float("nan") if k % 29 == 0 else float(k % 3),
                    None if k % 13 == 0 else colour, None if k % 19 == 0 else [float(y), float(k % 2)], label,
                    float(rng.integers(1, 4)), k % 2, f"m{k % 20}"))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(300), COLUMNS).repartition(3).cache()


def plain(bins, label, weight, setting, encoder, classes=4):
    """Trees as nested tuples; every split of every node is tried on the rows themselves."""
    scores, trees = np.zeros((len(label), classes)), []

    def sums(rows, p):
        w = weight[rows]
        g = ((p[rows] - np.eye(classes)[label[rows]]) * w[:, None]).sum(axis=0)
        return g, (w * (1 - (p[rows] ** 2).sum(axis=1)) / classes).sum()

    def leaf(rows, p):
        g, h = sums(rows, p)
        return -setting.step * g / (h + setting.l2)

    def grow(rows, p, depth):
        def score(part):
            g, h = sums(part, p)
            return (g ** 2).sum() / (h + setting.l2)

        best = (1e-9, None)
        for column in range(bins.shape[1]) if depth else ():
            for at in range(int(bins[:, column].max()) + 1):
                left = bins[rows, column] == at if column >= encoder.n_numbers else bins[rows, column] <= at
                a, b = rows[left], rows[~left]
                if min(sums(a, p)[1], sums(b, p)[1]) < setting.min_curvature:
                    continue
                gain = score(a) + score(b) - score(rows)
                if gain > best[0] + 1e-9:
                    best = (gain, (a, b))
        if best[1] is None:
            yield rows, leaf(rows, p)
            return
        for part in best[1]:
            yield from grow(part, p, depth - 1)

    for _ in range(setting.rounds):
        p = boosting.softmax(scores)
        fresh = scores.copy()
        for rows, value in grow(np.arange(len(label)), p, setting.depth):
            fresh[rows] += value
        scores = fresh
        trees.append(scores)
    return scores


def encoded(fitted, table):
    flat = fitted.bins.select(table, "label", "weight", "fold").toArrow()
    bins = fitted.bins.encode([c.combine_chunks() for c in flat.columns[: fitted.bins.width]])
    return bins, *(flat.column(c).to_numpy() for c in ("label", "weight", "fold"))


def scores_of(fitted, bins, fit):
    return sum(t[fit].leaves(bins).astype(float) for t in fitted.trees if t[fit] is not None)


@pytest.mark.parametrize("sample", [None, 10_000])
def test_trees_equal_a_plain_booster(table, monkeypatch, sample):
    monkeypatch.setattr(boosting, "KEEP", 2)
    monkeypatch.setattr(boosting, "CHECKPOINT", 4)
    monkeypatch.setattr(boosting, "BLOCK", 50)
    fitted = boosting.fit_boosters(table, SETTINGS, "label", "weight", ["mutation"], folds=2, sample_rows=sample)
    assert len(fitted.trees) == 9 and fitted.trees[8][2] is None
    bins, label, weight, fold = encoded(fitted, table)
    for number, setting in enumerate(SETTINGS):
        for f in (0, 1):
            mine = fold != f
            expected = plain(bins[mine], label[mine], weight[mine], setting, fitted.bins)
            assert scores_of(fitted, bins[mine], number * 2 + f) == pytest.approx(expected, abs=1e-4)


def test_many_tasks_are_added_up_in_between(table, monkeypatch):
    whole = boosting.fit_boosters(table, SETTINGS[1:], "label", "weight", ["mutation"], folds=2)
    monkeypatch.setattr(boosting, "DIRECT", 1)
    split = boosting.fit_boosters(table.repartition(9), SETTINGS[1:], "label", "weight", ["mutation"], folds=2)
    bins = encoded(whole, table)[0]
    assert scores_of(split, bins, 1) == pytest.approx(scores_of(whole, bins, 1), abs=1e-4)


def test_log_has_every_row_once_per_setting_and_learns(table):
    fitted = boosting.fit_boosters(table, SETTINGS, "label", "weight", ["mutation"], folds=2)
    log = fitted.prediction_log(table, "label", "mutation").cache()
    assert log.groupBy("model").count().collect() and log.count() == 2 * table.count()
    by = {r.model: r.accuracy for r in metrics.model_comparison(log).collect()}
    assert by["b"] > 0.65
    bins, label, _, fold = encoded(fitted, table)
    expected = sum(int(scores_of(fitted, bins[fold == f], 2 + f).argmax(axis=1)[k] == v)
                   for f in (0, 1) for k, v in enumerate(label[fold == f]))
    assert log.filter("model = 'b' and actual = predicted").count() == expected


def test_bins_of_missing_unseen_and_frequent_values(spark, table):
    bins = boosting.fit_bins(table, ["label", "weight", "fold", "mutation"], levels=2)
    assert bins.width == 6 and [len(v) for v in bins.levels] == [2]
    odd = spark.createDataFrame([(None, None, None, None, None, 0, 1.0, 0, "m"), (1e9, 7, -1.0, "pink", [9.0, 9.0], 0, 1.0, 0, "m")], COLUMNS)
    flat = bins.select(odd).toArrow()
    got = bins.encode([c.combine_chunks() for c in flat.columns])
    assert got[0].tolist() == [0] * 6
    assert got[1, -1] == 3 and got[1, 0] == len(bins.edges[0]) + 1 and got[1, 2] == 1


def test_rows_without_label_and_empty_tables(spark, table):
    none = table.withColumn("label", F.lit(None).cast("int"))
    for empty in (none, table.limit(0)):
        fitted = boosting.fit_boosters(empty, SETTINGS[:1], "label", "weight", ["mutation"], folds=2, sample_rows=100)
        assert fitted.prediction_log(empty, "label", "mutation").count() == empty.count()
