"""Components of sparse features against a dense decomposition."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varigrade.operators import components, networks

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT())])


def table(spark, x):
    rows = [(k, None if row is None else Vectors.sparse(len(row), np.flatnonzero(row), row[np.flatnonzero(row)]))
            for k, row in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def dense(x):
    z = x - x.mean(axis=0)
    spread = z.std(axis=0)
    z = z[:, spread > 0] / spread[spread > 0]
    values = np.linalg.eigvalsh(z.T @ z / len(z))[::-1]
    return values / values.sum(), z


@pytest.mark.parametrize("width,wanted", [(12, 12), (120, 20), (400, 6)])
def test_ratios_equal_the_dense_form(spark, width, wanted):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(700, width)) * (rng.random((700, width)) < 0.2)
    x[:, 1] = x[:, 0] * 2 + 0.1 * x[:, 1]
    x[:, 2] = 5.0
    x = x.astype(np.float32).astype(np.float64)
    df = table(spark, x)
    found = components.fit_components(df, components=wanted)
    ratios, z = dense(x)
    expected = ratios[: len(found.values)]
    assert len(found.values) == min(wanted, width - 1)
    assert found.ratios == pytest.approx(expected, abs=1e-6, rel=1e-6)
    if wanted == width:
        assert sum(r.ratio for r in components.explained(df, found).collect()) == pytest.approx(1)
    points = {r.id: r.projection for r in found.project(df).collect()}
    made = np.array([points[k] for k in range(len(x))])
    assert made.mean(axis=0) == pytest.approx(np.zeros(len(found.values)), abs=1e-6)
    assert (made ** 2).mean(axis=0) == pytest.approx(found.values, rel=1e-4)


def test_the_fewest_components_with_a_share(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(300, 40)), 2, axis=1).astype(np.float32).astype(np.float64)
    found = components.components_for(table(spark, x), 0.9)
    ratios, _ = dense(x)
    assert len(found.values) == int(np.argmax(np.cumsum(ratios) >= 0.9)) + 1


def test_awkward_tables(spark):
    assert components.fit_components(table(spark, np.zeros((0, 3)))).values.size == 0
    alike = table(spark, np.ones((5, 3)))
    assert components.fit_components(alike).values.size == 0
    some = [np.array([1.0, 0.0]), None, np.array([0.0, 3.0]), np.array([2.0, 1.0])]
    found = components.fit_components(table(spark, some), components=5)
    assert len(found.values) == 2 and found.ratios.sum() == pytest.approx(1)
    points = {r.id: r.projection for r in found.project(table(spark, some)).collect()}
    assert set(points) == {0, 2, 3} and len(points[0]) == 2

@pytest.mark.parametrize("direct", [True, False])
def test_one_pass_gives_all_products(spark, monkeypatch, direct):
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 150, 3000)
    x = np.zeros((3000, 300))
    x[np.arange(3000), kinds] = 1  # rarely filled, never together
    x[np.arange(3000), 150 + kinds // 2 * 2 % 140] = 2  # rarely filled, together with those
    x[:, 290:] = rng.normal(size=(3000, 10)) + 5
    x = x.astype(np.float32).astype(np.float64)

    def no_pass(*given):
        raise AssertionError("a pass over the rows for a block of directions")

    with monkeypatch.context() as patch:
        patch.setattr(components, "products", no_pass)
        if not direct:
            patch.setattr(components, "DIRECT_WIDTH", 0)
        found = components.fit_components(table(spark, x), components=20)
        kept = components.components_for(table(spark, x), 0.9)
    ratios, _ = dense(x)
    assert found.ratios == pytest.approx(ratios[:20], abs=1e-8)
    assert len(kept.values) == int(np.argmax(np.cumsum(ratios) >= 0.9)) + 1
    monkeypatch.setattr(components, "gram", lambda *given: None)
    plain = components.fit_components(table(spark, x), components=20)
    assert plain.ratios == pytest.approx(found.ratios, abs=1e-8)
    monkeypatch.undo()
    scale = networks.Scale(x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0))
    blocks = networks.blocks_of(table(spark, x), "features", (), F.lit(0.0), F.lit(1.0), F.lit(-1), F.lit(False), 1)
    z = (x - scale.mean) / scale.deviation
    made = components.gram(blocks, scale, len(x))
    assert made.dense() == pytest.approx(z.T @ z, abs=1e-6)
    assert made @ np.eye(300)[:, :40] == pytest.approx((z.T @ z)[:, :40], abs=1e-6)
    monkeypatch.setattr(components, "TABLE", 10)
    assert components.gram(blocks, scale, len(x)) is None
