"""Nearest neighbours against brute force on rows that a sample's radius doesn't suit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varigrade.llm import ann


def uneven(kind):
    """Vectors whose queries lie otherwise than most rows do."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    if kind == "clusters":  # most rows have very near copies, the queries have none
        x = np.repeat(rng.normal(size=(100, 32)) * 5, 30, axis=0) + rng.normal(size=(3000, 32)) * 1e-4
        x[::100] = rng.normal(size=(30, 32)) * 5
    elif kind == "lengths":
        x *= 10.0 ** rng.uniform(-3, 3, (3000, 1))
    elif kind == "same":
        x[:2950] = x[0]
    elif kind == "narrow":
        x = x[:, :3]
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("kind", ["clusters", "lengths", "same", "narrow"])
def test_finds_what_brute_force_finds(spark, kind, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 1000)
    x = uneven(kind)
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, sample_rows=2000).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    for q in range(0, len(x), 100):
        distance = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        distance[q] = np.inf
        assert found[q] == [(distance[k], k) for k in np.lexsort((np.arange(len(x)), distance))[:10]]
