"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

A rotation fitted on a bounded sample (principal axes, then alternating rotation and rounding) turns each vector into a
code of up to 64 signs. Codes are cut into 8-bit substrings, each with its own inverted table. Codes within a Hamming
radius r of a query agree with it in some substring up to r // substrings bits, so probing all table buckets that near
finds every one of them; those within r are ranked by their original vectors in double precision.

The radius is the smallest that holds ``goal`` of the true neighbours of the sample; it only says where the search begins. A
shard that has too few codes within the radius widens it until it has enough, or all its vectors. The rotation keeps distances,
so a vector whose code differs from the query's in some signs is at least as far away as the query's own coordinates of those
signs are from zero. Every vector that this bound doesn't put beyond the k-th found is measured too, so no nearer one is missed,
however the rows are spread and whatever the sample holds.

All vectors are indexed, in hash shards of about ``SHARD`` rows. Queries go to every shard in blocks of about ``BLOCK``, and
each shard returns its k nearest per query, which are merged. No task holds more than one shard and one block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varigrade.llm.common import bounded_sample
from varigrade.session import materialize

SHARD, BLOCK = 16384, 4096
SAMPLE = 20_000
GOAL = 0.97
_COUNT = np.array([bin(v).count("1") for v in range(256)], np.uint8)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1) if rows else np.zeros((0, 1))


class Coder:
    """Learned codes: signs of the centred vector on rotated principal axes."""

    def __init__(self, sample: np.ndarray, bits: int = 64, rounds: int = 30, seed: int = 7):
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        bits = min(bits, sample.shape[1])
        _, axes = np.linalg.eigh(centred.T @ centred)  # width x width, whatever the sample
        axes = axes[:, ::-1].T
        projected = centred @ axes[:bits].T
        turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
        for _ in range(rounds):
            signs = np.where(projected @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(projected.T @ signs)
            turn = left @ right
        self.weights = axes[:bits].T @ turn
        self.substrings = -(-bits // 8)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.mean) @ self.weights

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, substrings) bytes."""
        return np.packbits(self.project(vectors) >= 0, axis=1)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """(substrings, 256): what each byte adds to the least squared distance of a vector with that byte in its code.

        Rounding may turn the sign of a coordinate near zero, so each coordinate counts a little less.
        """
        place = self.project(query[None, :])[0]
        slack = 1e-9 * (np.abs(query).sum() + np.abs(self.mean).sum())
        parts = np.zeros(8 * self.substrings)
        parts[: len(place)] = np.minimum(np.maximum(np.abs(place) - slack, 0), 1e150) ** 2
        own = np.packbits(place >= 0)
        differs = np.unpackbits(np.arange(256, dtype=np.uint8)[None, :] ^ own[:, None], axis=1).reshape(self.substrings, 256, 8)
        return (differs * parts.reshape(self.substrings, 1, 8)).sum(axis=2)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return _COUNT[codes ^ code].sum(axis=1, dtype=np.int32)


class Index:
    """One shard: an inverted table per substring."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.rows, self.ids, self.vectors, self.codes = rows, ids, vectors, codes
        self.order = [np.argsort(codes[:, t], kind="stable") for t in range(codes.shape[1])]
        self.bounds = [np.searchsorted(codes[o, t], np.arange(257)) for t, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of every code within ``radius``."""
        near = radius // len(self.order)
        seen = np.zeros(len(self.ids), bool)
        values = np.arange(256, dtype=np.uint8)
        for t, order in enumerate(self.order):
            for value in np.flatnonzero(_COUNT[values ^ code[t]] <= near):
                seen[order[self.bounds[t][value]: self.bounds[t][value + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[hamming(self.codes[rows], code) <= radius]

    def not_beyond(self, bounds: np.ndarray, most: float) -> np.ndarray:
        """Rows whose code allows a squared distance of ``most``."""
        least = np.zeros(len(self.ids))
        for t in range(self.codes.shape[1]):
            least += bounds[t][self.codes[:, t]]
        return np.flatnonzero(least * (1 - 1e-9) <= most)

    def search(self, query: np.ndarray, code: np.ndarray, own: int, k: int, radius: int, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(rows, ids, distances) of the ``k`` nearest but the row ``own``; equal distances by id, then by row."""
        while True:
            rows = self.within(code, radius)
            rows = rows[self.rows[rows] != own]
            if len(rows) >= k or radius >= 8 * len(self.order):
                break
            radius += len(self.order)
        distance = np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))
        if len(rows) >= k:
            left = self.not_beyond(bounds, np.partition(distance, k - 1)[k - 1] ** 2 * (1 + 1e-9))
            left = left[self.rows[left] != own]
            more = left[~np.isin(left, rows, assume_unique=True)]
            rows = np.concatenate([rows, more])
            distance = np.concatenate([distance, np.sqrt(((self.vectors[more] - query) ** 2).sum(axis=1))])
        if len(rows) > k:
            kept = distance <= np.partition(distance, k - 1)[k - 1]
            rows, distance = rows[kept], distance[kept]
        best = np.lexsort((self.rows[rows], self.ids[rows], distance))[:k]
        return self.rows[rows[best]], self.ids[rows[best]], distance[best]


def calibrated_radius(coder: Coder, sample: np.ndarray, k: int, goal: float, queries: int = 300) -> int:
    """The radius that holds ``goal`` of the sample's true neighbours."""
    codes, gaps = coder.codes(sample), []
    for q in range(min(queries, len(sample))):
        distance = ((sample - sample[q]) ** 2).sum(axis=1)
        distance[q] = np.inf
        near = np.argsort(distance)[: min(k, len(sample) - 1)]
        gaps.append(hamming(codes[near], codes[q]))
    found = np.sort(np.concatenate(gaps)) if gaps else np.zeros(0, int)
    return int(found[min(len(found) - 1, math.ceil(goal * len(found)))]) if len(found) else 0


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, embedding) of rows with an id and a finite vector that isn't all zero, of the commonest width."""
    kept = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding")
                          ).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
                                   & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
                                   & F.exists("embedding", lambda x: x != 0))
    widths = kept.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).first()
    return kept.filter(F.size("embedding") == (widths.width if widths else 0))


def nearest(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", column: str = "embedding",
            sample_rows: int = SAMPLE, goal: float = GOAL) -> DataFrame:
    """The ``k`` nearest found of each query row: query_id, rank, vec_id, score (Euclidean distance, in double precision).

    ``is_query`` is a column over ``vec_id``. Every usable row but the query's own is a candidate; equal distances go by
    id. Rows with null, zero, non-finite or odd-width vectors, or without id, take no part. Repeated rows of one id are
    candidates and queries each, so such a query id has a list for each of its rows. No usable rows, no result.
    """
    ready = materialize(usable(vectors, key, column).withColumn("row", F.monotonically_increasing_id()))
    total = ready.count()
    spark = vectors.sparkSession
    out = "query_row long, query_id long, row long, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], out).withColumn("rank", F.lit(1)).select("query_id", "rank", "vec_id", "score")
    sample = matrix(bounded_sample(ready, "vec_id", sample_rows).toArrow().column("embedding"))
    coder = Coder(sample)
    radius = calibrated_radius(coder, sample, k, goal)
    shards = -(-total // SHARD)
    queries = ready.filter(is_query)
    blocks = max(1, -(-queries.count() // BLOCK))
    shard, block = F.pmod(F.xxhash64("vec_id", "row"), shards), F.pmod(F.xxhash64("vec_id", "row"), blocks)
    left = ready.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                        "row", "vec_id", "embedding")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("to_shard"),
                           block.alias("of_block"), F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"),
                           F.col("embedding").alias("query"))

    def search(held: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if held.num_rows and asked.num_rows:
            points = matrix(held.column("embedding"))
            index = Index(held.column("row").to_numpy(), held.column("vec_id").to_numpy(), points, coder.codes(points))
            wanted = matrix(asked.column("query"))
            for row, name, query, code in zip(asked.column("query_row").to_pylist(), asked.column("query_id").to_pylist(), wanted,
                                              coder.codes(wanted)):
                near = index.search(query, code, row, k, radius, coder.bounds(query))
                found.append((np.full(len(near[0]), row), np.full(len(near[0]), name), *near))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, int)] * 4 + [np.zeros(0)]
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)],
                        names=["query_row", "query_id", "row", "vec_id", "score"])

    best = left.groupBy("shard", "block").cogroup(right.groupBy("to_shard", "of_block")).applyInArrow(search, out)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id", "row"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
