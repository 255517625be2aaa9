"""Language identification by a byte convolutional network, trained and applied with numpy.

A text is lower-cased and cut into windows of ``WINDOW`` UTF-8 bytes, all of them to its end. Filters of several widths
slide over byte embeddings; each filter's largest response in the window feeds a softmax over the languages. A
text's prediction is the mean of its windows' log-probabilities. Because the input is a byte, embedding and filter multiply
into one table per filter place, and a convolution becomes table look-ups and additions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrade.llm.common import bounded_sample, slices

WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 8
#: Labelled documents that the network is fitted on at most, and windows of each.
TRAIN_DOCS, TRAIN_WINDOWS = 3000, 2
_LETTER = re.compile(r"[^\W\d_]")
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def windows(text: str) -> np.ndarray:
    """(windows, WINDOW) bytes of the whole text; the last is filled with spaces."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    count = max(1, -(-len(raw) // WINDOW))
    out = np.full(count * WINDOW, 0x20, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(count, WINDOW)


class Network:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = [rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)).astype(np.float32)
                        for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.zeros((len(WIDTHS) * FILTERS, len(languages)), np.float32)
        self.prior = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.out, self.prior]

    def responses(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """(windows, places, filters) for each width."""
        for f in self.filters:
            tables, places = self.embedding @ f, data.shape[1] - len(f) + 1
            total = np.take(tables[0], data[:, :places], axis=0)
            for k in range(1, len(f)):
                total += np.take(tables[k], data[:, k: k + places], axis=0)
            yield total

    def compiled(self) -> None:
        """Tables over byte pairs: a filter of width w needs w // 2 of them and one byte table if w is odd."""
        self.plan = []
        for f in self.filters:
            single = [np.ascontiguousarray(self.embedding @ part) for part in f]
            steps = [(k, (single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, -1), True)
                     for k in range(0, len(f) - 1, 2)]
            self.plan.append((len(f), steps + ([(len(f) - 1, single[-1], False)] if len(f) % 2 else [])))

    def log_probabilities(self, data: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(data), 32):
            one = np.ascontiguousarray(data[at: at + 32].T, np.intp)  # places first, so a maximum runs over whole rows
            two = one[:-1] * 256 + one[1:]
            pooled = []
            for width, steps in self.plan:
                places, total = len(one) - width + 1, None
                for k, table, pair in steps:
                    found = np.take(table, (two if pair else one)[k: k + places], axis=0, mode="clip")
                    total = found if total is None else np.add(total, found, out=total)
                pooled.append(total.max(axis=0))
            parts.append(np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.prior)
        scores = np.concatenate(parts).astype(np.float64)
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        count, rows = len(data), np.arange(len(data))
        tops, pooled = [], []
        for r in self.responses(data):
            top = r.argmax(axis=1)
            tops.append(top)
            pooled.append(np.take_along_axis(r, top[:, None, :], axis=1)[:, 0])
        pooled = np.concatenate(pooled, axis=1) + self.bias
        active = np.maximum(pooled, 0)
        scores = active @ self.out + self.prior
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[rows, labels] -= 1
        p /= count
        back = (p @ self.out.T) * (pooled > 0)
        to_embedding = np.zeros_like(self.embedding)
        to_filters = []
        for g, (f, top) in enumerate(zip(self.filters, tops)):
            own = back[:, g * FILTERS: (g + 1) * FILTERS]
            grad = np.zeros_like(f)
            for k in range(len(f)):
                seen = data[rows[:, None], top + k]
                grad[k] = np.einsum("nf,nfe->ef", own, self.embedding[seen])
                np.add.at(to_embedding, seen.ravel(), (own[:, :, None] * f[k].T[None]).reshape(-1, EMBEDDING))
            to_filters.append(grad)
        return [to_embedding, *to_filters, back.sum(axis=0), active.T @ p, p.sum(axis=0)]

    def fit(self, data: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3,
            seed: int = 5) -> None:
        """Adam on shuffled batches."""
        rng, step = np.random.default_rng(seed), 0
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(data)), max(1, len(data) // batch)):
                step += 1
                for p, g, m, v in zip(self.parameters(), self.gradients(data[rows], labels[rows]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not _LETTER.search(text):
            return "und", 0.0
        mean = self.log_probabilities(windows(text)).mean(axis=0)
        chance = np.exp(mean - mean.max())
        best = int(chance.argmax())
        return self.languages[best], float(chance[best] / chance.sum())


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          docs: int = TRAIN_DOCS) -> Network | None:
    """A network fitted on at most ``docs`` labelled rows, spread over each text; None without labelled text."""
    chosen = labelled.select(F.col(key), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("data", pa.binary())])
        for batch in slices(batches, 64):
            out = []
            for body, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if _LETTER.search(body):
                    all_windows = windows(body)
                    for k in range(min(TRAIN_WINDOWS, len(all_windows))):
                        out.append((label, all_windows[k * len(all_windows) // TRAIN_WINDOWS].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)

    # ids first: the texts of the sample alone are read on
    ids = bounded_sample(chosen.select(key), key, docs).select(F.col(key).alias("_chosen")).distinct()
    rows = chosen.join(F.broadcast(ids), chosen[key] == F.col("_chosen")).select(key, "text", "lang").mapInArrow(
        cut, "lang string, data binary").toArrow()
    if not rows.num_rows:
        return None
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    data = np.frombuffer(b"".join(rows.column("data").to_pylist()), np.uint8).reshape(-1, WINDOW).astype(np.intp)
    labels = np.array([languages.index(n) for n in names])
    order = np.lexsort((*data.T[:8], labels))  # one order, however Spark returned the rows
    network = Network(languages)
    network.fit(data[order], labels[order])
    return network


def identify(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; ``und`` with score 0 for null texts, texts without letters, or no network.

    Repeated rows each give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value:
            shared.value.compiled()
        for batch in slices(batches, 128):
            found = [shared.value.predict(t) if shared.value else ("und", 0.0) for t in batch.column(1).to_pylist()]
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())], schema=_OUT)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def held_out_identification(docs: DataFrame, held_out: Column, key: str = "doc_id") -> DataFrame:
    """Learn from rows that aren't ``held_out`` (a column over the id) and predict every row."""
    network = train(docs.filter(~F.coalesce(held_out, F.lit(True))), key)
    return identify(docs, network, key).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
