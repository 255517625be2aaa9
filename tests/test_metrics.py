"""Metrics against values worked out by hand."""

import pytest

from varigrade.operators import metrics, statistics


@pytest.fixture(scope="module")
def log(spark):
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 3), (2, 2)]
    return spark.createDataFrame([(0, "m", a, p) for a, p in pairs], "fold int, mutation string, actual int, predicted int")


def test_report(log):
    rows = {r.label: r for r in metrics.classification_report(log).collect()}
    assert set(rows) == {"0", "1", "2", "3", "accuracy", "macro avg", "weighted avg"}
    assert (rows["0"].precision, rows["0"].recall, rows["0"].support) == (1.0, pytest.approx(2 / 3), 3)
    assert (rows["3"].precision, rows["3"].recall, rows["3"].f1, rows["3"].support) == (0.0, 0.0, 0.0, 0)
    assert rows["accuracy"].f1 == pytest.approx(4 / 6)
    assert rows["macro avg"].recall == pytest.approx((2 / 3 + 0.5 + 1 + 0) / 4)
    assert rows["weighted avg"].recall == pytest.approx(4 / 6)


def test_accuracies(log):
    assert metrics.accuracy(log).first()[0] == pytest.approx(4 / 6)
    assert metrics.balanced_accuracy(log).first()[0] == pytest.approx((2 / 3 + 0.5 + 1) / 3)
    assert metrics.scores(log).first() == (pytest.approx(4 / 6), pytest.approx((2 / 3 + 0.5 + 1) / 3))


def test_confusion(log):
    cells = {(r.actual, r.predicted): r.n for r in metrics.confusion_matrix(log).collect()}
    assert len(cells) == 16 and cells[0, 1] == 1 and cells[3, 3] == 0 and sum(cells.values()) == 6
    shares = {(r.actual, r.predicted): r.share for r in metrics.confusion_matrix_norm(log).collect()}
    assert shares[0, 0] == pytest.approx(2 / 3) and shares[3, 0] == 0.0
    small = metrics.confusion_matrix(log, labels=(0, 1)).collect()
    assert sum(r.n for r in small) == 4


def test_constant_target(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "actual double, predicted double")
    assert metrics.mae_r2(df).first() == (0.5, None)


def test_report_text(spark, log, tmp_path):
    from varigrade.sources.sinks import sink_text_report

    path = str(tmp_path / "report")
    sink_text_report(metrics.report_lines(log), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[:4] == ["=== Fold 0 ===", "Number of unseen mutations: 1", "Sample mutations:", "m"]
    assert lines[-1] == "Balanced Accuracy: 0.722" and len(lines) == 13


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",), (None,)], "y string")
    assert dict(statistics.class_weights(df, "y").collect()) == {"a": 4 / 6, "b": 2.0}
    weighted = statistics.class_weights_balanced(df, "y").collect()
    assert sorted((r.y or "", r.class_weight) for r in weighted) == [("", None), *[("a", 4 / 6)] * 3, ("b", 2.0)]
    many = statistics.class_weights_balanced(spark.range(3000), "id")  # as many classes as rows
    assert many.filter("class_weight = 1").count() == 3000


def test_scaling_uses_the_training_part(spark):
    train = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, c double")
    rows = statistics.standardize(train, ["x", "c"]).collect()
    assert sum(r.x for r in rows) == pytest.approx(0) and sum(r.x ** 2 for r in rows) == pytest.approx(3)
    assert [r.c for r in rows] == [0.0, 0.0, 0.0]
    _, other = statistics.zscore_target(train, spark.createDataFrame([(10.0,)], "x double"), "x")
    assert other.first().x == pytest.approx((10 - 7 / 3) / 1.5275252316519465)


def test_correlation_with_constant_column(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.1, 3.0), (3.0, 5.9, 3.0)], "a double, b double, c double")
    pairs = statistics.corr_pairs(df, ["a", "b", "c"]).collect()
    assert [(r.a, r.b) for r in pairs] == [("a", "b"), ("b", "a")] and 0.99 < pairs[0].r < 1
