"""Connected components of an edge table, by alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrade.llm.common import Stages


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest id around each vertex: the larger neighbours, or the vertex and smaller ones.

    The smallest id per vertex is a combinable aggregate and is joined back, so a vertex with very many neighbours is
    never gathered in one place.
    """
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = around.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(low, around.u == low.k)
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, stages: Stages | None = None) -> DataFrame:
    """(u, v) edges of any direction to (vertex, label): the smallest id of each vertex's component.

    Self-loops, repeats and nulls are ignored. Each step is a written table, so a lost executor costs one step. Only the last
    one stays, for whoever owns ``stages`` to empty.
    """
    stages = stages or Stages(edges.sparkSession)
    state = stages.write(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
                        .filter("u <> v").distinct())
    seen = None
    while True:
        before, state = state, stages.write(_star(_star(state, large=True), large=False))
        stages.drop(before)
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("vertex"), F.col("v").alias("label")).union(
        state.select(F.col("v").alias("vertex"), F.col("v").alias("label")).distinct())
