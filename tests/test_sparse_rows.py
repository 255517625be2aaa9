"""Sparse products against dense ones, and fits on vectors too wide to be filled in."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varigrade.operators import forests, networks


def sparse(x):
    row, slots = np.nonzero(x)
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))])
    return networks.SparseRows.of(starts, slots, x[row, slots], x.shape[1])


@pytest.mark.parametrize("share", [0.0, 0.01, 0.3, 1.0])
def test_products_equal_dense_ones(share):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 30)) * (rng.random((200, 30)) < share)
    x[:, 3] = 2.0
    made, mine = sparse(x), np.flatnonzero(rng.random(200) < 0.5)
    for held, full in ((made, x), (made.take(mine), x[mine]), (made.take(mine[:0]), x[:0])):
        weights, slopes = rng.normal(size=(30, 4)), rng.normal(size=(len(full), 4))
        assert held @ weights == pytest.approx(full @ weights)
        assert held.T @ slopes == pytest.approx(full.T @ slopes)
        assert held.sums() == pytest.approx(full.sum(axis=0)) and held.sums(2) == pytest.approx((full ** 2).sum(axis=0))
        assert held.squares(weights[:, 0]) == pytest.approx(((full - weights[:, 0]) ** 2).sum(axis=0))
        assert (held.dense() == full).all()


WIDE = 20_000_000


@pytest.fixture(scope="module")
def wide(spark):
    """Vectors that would take 160 MB each if they were filled in."""
    kinds = T.StructType([T.StructField("features", VectorUDT()), T.StructField("y", T.DoubleType()), T.StructField("f", T.IntegerType())])
    rows = [(Vectors.sparse(WIDE, [k % 3, 10 + k % 4, WIDE - 1], [1.0, 2.0, float(k % 5)]), float(k % 3), k % 2) for k in range(240)]
    return spark.createDataFrame(rows, kinds).repartition(2)


def test_columns_of_a_vector_take_its_filled_slots(wide):
    got = wide.select(*networks.sparse_columns("features"), networks.sparse_width("features").alias("n")).first()
    assert len(got._slots) == 3 and got._slots[2] == WIDE - 1 and got.n == WIDE
    plan = wide.select(*networks.sparse_columns("features"))._jdf.queryExecution().toString()
    assert "UDF" not in plan
    mixed = [(Vectors.dense([0.0, 2.0]),), (None,), (Vectors.sparse(2, [1], [3.0]),), (Vectors.dense([]),)]
    df = wide.sparkSession.createDataFrame(mixed, T.StructType([T.StructField("v", VectorUDT())]))
    found = [(r._slots, r._values, r.n) for r in df.select(*networks.sparse_columns("v"), networks.sparse_width("v").alias("n")).collect()]
    assert found == [([0, 1], [0.0, 2.0], 2), (None, None, None), ([1], [3.0], 2), ([], [], 0)]


def test_a_forest_on_vectors_too_wide_to_fill_in(wide):
    forest = forests.fit_forests(wide, "features", "y", F.lit(1.0), F.col("f"), [0, 1], 200, classes=3, trees=4, subset="all")
    log = forest.predictions(wide, "features", F.col("f"), {"actual": F.col("y")}, "actual double")
    assert log.count() == 240 and log.filter("actual = predicted").count() == 240
