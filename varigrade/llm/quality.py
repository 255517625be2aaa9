"""Text quality by ordinal cumulative-link regression on graded ratings.

Words and word pairs are hashed into one weight vector, beside hashed marks of a text's shape (repetition, case,
punctuation, line lengths). All grades share these weights; ordered thresholds separate them:
P(grade <= j) = sigmoid(threshold_j - weights . text). That gives an expected grade, and the chance of a grade or better for
selection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrade.llm.common import bounded_sample, slices
from varigrade.llm.shingles import mix, word_hashes

BITS = 18
#: Rated documents that the model is fitted on at most.
TRAIN_DOCS = 8_000
_MASK = np.uint64((1 << BITS) - 1)


def _shape(text: str, words: np.ndarray) -> list[tuple[int, float]]:
    """Coarse levels of what the look of a text tells, hashed beside the words."""
    size = max(1, len(text))
    lines = text.split("\n")
    letters = sum(map(str.isalpha, text)) / size
    upper = sum(map(str.isupper, text)) / size
    distinct = len(np.unique(words)) / max(1, len(words))
    levels = (
        round(8 * distinct), round(10 * letters), round(10 * upper), round(8 * len(set(lines)) / len(lines)),
        min(8, int(np.log2(1 + len(words)))), min(8, round(size / max(1, len(words)) / 2)),
        min(8, round(200 * sum(text.count(c) for c in "|#$%*!<>{}[]\\=") / size)),
    )
    return [(kind * 64 + level, 1.0) for kind, level in enumerate(levels)]


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed places, values) of each whole text; values have unit length over words, and fixed size for shape marks."""
    for text, words in zip(texts.to_pylist(), word_hashes(texts)):
        pairs = mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
        places, counts = np.unique(np.concatenate([words, pairs]) & _MASK, return_counts=True)
        values = np.log1p(counts)
        values /= max(1e-9, np.sqrt((values ** 2).sum()))
        marks = _shape(text or "", words)
        yield (np.concatenate([places.astype(np.int64), (1 << BITS) + np.array([m for m, _ in marks])]),
               np.concatenate([values, np.full(len(marks), 0.5)]))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Ordinal:
    """Grades 0..grades-1 from sparse rows."""

    def __init__(self, grades: int):
        self.weights = np.zeros((1 << BITS) + 512)
        self.cuts = np.linspace(-1, 1, grades - 1)

    def below(self, z: np.ndarray) -> np.ndarray:
        """P(grade <= j) for j from -1 to grades - 1: (rows, grades + 1)."""
        inner = sigmoid(self.cuts[None, :] - z[:, None])
        return np.hstack([np.zeros((len(z), 1)), inner, np.ones((len(z), 1))])

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = 12, batch: int = 128,
            rate: float = 0.3, shrink: float = 1e-5, seed: int = 3) -> None:
        """AdaGrad on shuffled batches; thresholds are kept in order by fitting the first and the logs of the gaps."""
        rng = np.random.default_rng(seed)
        shares = np.array([(grades <= j).mean() for j in range(len(self.cuts))])
        self.cuts = np.log(np.clip(shares, 1e-3, 1 - 1e-3) / (1 - np.clip(shares, 1e-3, 1 - 1e-3)))
        self.cuts = np.maximum.accumulate(self.cuts + 1e-3 * np.arange(len(self.cuts)))
        form = np.concatenate([self.cuts[:1], np.log(np.maximum(np.diff(self.cuts), 1e-3))])
        past, past_form = np.full(len(self.weights), 1e-4), np.full(len(form), 1e-2)
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                at = np.concatenate([rows[i][0] for i in some])
                value = np.concatenate([rows[i][1] for i in some])
                sizes = np.array([len(rows[i][0]) for i in some])
                owner = np.repeat(np.arange(len(some)), sizes)
                z = np.bincount(owner, value * self.weights[at], len(some))
                table, y = self.below(z), grades[some]
                here = np.arange(len(some))
                low, high = table[here, y], table[here, y + 1]
                chance = np.maximum(high - low, 1e-9)
                slope_low, slope_high = low * (1 - low), high * (1 - high)
                to_z = (slope_high - slope_low) / chance / len(some)
                cut_slope = np.zeros(len(self.cuts) + 2)
                np.add.at(cut_slope, y + 1, -slope_high / chance / len(some))
                np.add.at(cut_slope, y, slope_low / chance / len(some))
                cut_slope = cut_slope[1:-1]
                to_form = np.concatenate([[cut_slope.sum()], np.cumsum(cut_slope[::-1])[::-1][1:] * np.exp(form[1:])])
                past_form += to_form ** 2
                form -= 0.1 * to_form / np.sqrt(past_form)
                self.cuts = np.cumsum(np.concatenate([form[:1], np.exp(form[1:])]))
                touched, back = np.unique(at, return_inverse=True)
                slope = np.bincount(back, value * to_z[owner]) + shrink * self.weights[touched]
                past[touched] += slope ** 2
                self.weights[touched] -= rate * slope / np.sqrt(past[touched])

    def chances(self, row: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """P(grade >= j) for j from 1 on."""
        z = np.array([row[1] @ self.weights[row[0]]])
        return 1 - self.below(z)[0, 1:-1]


def train(docs: DataFrame, ratings: DataFrame, usable: Column, grades: int, key: str = "doc_id", text: str = "text",
          rows: int = TRAIN_DOCS) -> Ordinal | None:
    """Fit on at most ``rows`` rated documents; ``ratings`` has (key, grade), ``usable`` is a column over the id.

    Null or out-of-range grades are no ratings. None if nothing is rated.
    """
    rated = ratings.select(F.col(key).alias("_id"), F.col("grade").cast("int").alias("grade")).withColumnRenamed("_id", key)
    rated = bounded_sample(rated.filter(F.col(key).isNotNull() & F.col("grade").between(0, grades - 1) & usable), key, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("places", pa.list_(pa.int32())),
                            ("values", pa.list_(pa.float32()))])
        for batch in slices(batches, 128):
            found = list(features(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p.astype(np.int32) for p, _ in found], pa.list_(pa.int32())),
                 pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], schema=schema)

    sample = docs.select(F.col(key).alias("_doc"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(rated), F.col("_doc") == F.col(key)).select(F.col(key).cast("long").alias("doc_id"), "grade", "text")
    got = sample.mapInArrow(run, "doc_id long, grade int, places array<int>, values array<float>").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    places, values = (got.column(c).combine_chunks() for c in ("places", "values"))
    table = [(np.asarray(p.values, np.int64), np.asarray(v.values, np.float64)) for p, v in zip(places, values)]
    model = Ordinal(grades)
    model.fit(table, got.column("grade").to_numpy().astype(np.int64))
    return model


def grade_documents(docs: DataFrame, model: Ordinal | None, accept: int, threshold: float = 0.5, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail, keep) of every row; tail is P(grade >= ``accept``), keep is tail >= threshold.

    A null or empty text is judged by its shape marks alone. Without a model every text gets null figures and is kept. Repeated
    rows each give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail", pa.float64()),
                            ("keep", pa.bool_())])
        for batch in slices(batches, 128):
            if shared.value is None:
                found = [(None, None, True)] * batch.num_rows
            else:
                chances = [shared.value.chances(row) for row in features(batch.column(1))]
                found = [(float(c.sum()), float(c[accept - 1]), bool(c[accept - 1] >= threshold)) for c in chances]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))],
                                             schema=schema)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id long, expected_grade double, tail double, keep boolean")
