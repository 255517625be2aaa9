"""Toxicity scores from a learned lexicon, misspellings of its terms, and the words around each hit.

* Terms are learned from labelled texts: words, and word beginnings that many toxic words share, whose document rate is far
  higher in toxic texts.
* The terms form a trie. Levenshtein automata of all terms run over it together: the state after some letters of a word is the
  set of (trie node, edits) still within a term's edit bound. States are made once and kept, so a word costs one
  look-up per letter and most words die after a few. Long terms and beginnings allow two edits, short ones none. Words
  under a beginning stay terms of their own.
* A near word is ordinary, and no hit, if it turns up in clean labelled texts or if every letter sequence that it has and
  the term lacks is one of theirs. The term keeps its edits.
* A window around each hit tells quotation (quote marks or words of reporting) from abuse. Hits count by kind (exact or
  misspelled, abuse or quotation) in a logistic score, fitted around prior weights so that kinds the labels never show keep them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrade.llm.common import bounded_sample, keep_rows, slices

#: Labelled documents that the model is fitted on at most.
TRAIN_DOCS = 12_000
CONTEXT = 6
SHORTEST_STEM, LONGEST_STEM = 4, 9
#: Letters of a sequence that tells ordinary words from misspellings.
GRAM = 5
#: A term's rate in toxic texts over its rate in clean ones; the different toxic texts it must occur in, and their share.
LEAST_RATIO, LEAST_DOCS, LEAST_SHARE = 25.0, 4, 0.005
#: A word remembers its verdict until so many are held; bounds a worker's memory.
REMEMBERED = 1_000_000
REPORTING = frozenset("""said says say quote quoted quotes quoting reported reports report wrote writes called calling
    term word words phrase cited citing according slur comment commented""".split())
_QUOTES = "\"“”„«»‘’`"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Weights before any label is seen: bias, then log2(1 + hits) that are exact abuse, misspelled abuse, exact and
#: misspelled quotation. One misspelled hit of abuse alone passes 0.7. The bias hardly moves: texts without any
#: hit say nothing about what a hit weighs.
PRIOR = np.array([-3.0, 5.0, 4.3, 1.0, 0.5])
PRIOR_SPREAD = np.array([0.02, 1.5, 1.0, 1.0, 1.0])


def edits_for(term: str) -> int:
    """Edits that a misspelling of a word or a beginning may have."""
    if len(term) < 5:
        return 0
    return 2 if len(term) >= 9 else 1


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie, as a deterministic machine built as words ask."""

    def __init__(self, terms: dict[str, tuple[int, bool]]):
        """``terms``: the edits allowed for each term, and whether any ending may follow."""
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.stem: list[bool] = [False]
        self.allowed = [0]  # the most edits of any term below
        self.terms = terms
        for term, (edits, stem) in sorted(terms.items()):
            node = 0
            self.allowed[0] = max(self.allowed[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.stem.append(False)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits)
            self.ends[node], self.stem[node] = term, stem
        self.letters = {c for kids in self.children for c in kids}
        self.sets: list[frozenset] = [frozenset()]
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.next: list[dict[str, int]] = [{}]
        self.verdict: list[tuple[str, int] | None] = [None]
        self.start = self._state({(0, 0)})

    def _state(self, held: set[tuple[int, int]]) -> int:
        """The number of a set of (node, edits), after leaving out letters of the terms."""
        waiting = list(held)
        while waiting:
            node, edits = waiting.pop()
            for kid in self.children[node].values():
                if edits + 1 <= self.allowed[kid] and (kid, edits + 1) not in held:
                    held.add((kid, edits + 1))
                    waiting.append((kid, edits + 1))
        best = {}
        for node, edits in held:
            best[node] = min(edits, best.get(node, edits))
        key = frozenset(best.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            full = [(e, self.ends[n]) for n, e in key if self.ends[n] and e <= self.terms[self.ends[n]][0]]
            self.verdict.append((min(full)[1], min(full)[0]) if full else None)
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        held = set()
        for node, edits in self.sets[state]:
            if self.stem[node] and edits <= self.terms[self.ends[node]][0]:
                held.add((node, edits))
            for c, kid in self.children[node].items():
                cost = edits + (c != letter)
                if cost <= self.allowed[kid]:
                    held.add((kid, cost))
            if edits + 1 <= self.allowed[node]:
                held.add((node, edits + 1))
        return self._state(held) if held else 0

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, the first by letters among equals, and the edits."""
        state = self.start
        for c in word:
            c = c if c in self.letters else "\0"
            after = self.next[state].get(c)
            if after is None:
                after = self.next[state][c] = self._step(state, c)
            state = after
            if not state:
                return None
        return self.verdict[state]


def quoted(words: list[str], at: int) -> bool:
    """Whether the window around a hit reads as quotation."""
    window = words[max(0, at - CONTEXT): at + CONTEXT + 1]
    if any(_EDGE.sub("", w) in REPORTING for w in window):
        return True
    if any(c in _QUOTES for c in words[at]):
        return True
    before = sum(w[0] in _QUOTES for w in words[max(0, at - CONTEXT): at])
    after = sum(w[-1] in _QUOTES or w[-2:-1] in _QUOTES for w in words[at + 1: at + CONTEXT + 1] if w)
    return bool(before and after)


def grams(word: str) -> set[int]:
    """Hashes of the letter sequences of a word with its bounds."""
    word = f"^{word}$"
    return {zlib.crc32(word[k: k + GRAM].encode("utf-8", "replace")) for k in range(max(1, len(word) - GRAM + 1))}


class Ordinary:
    """Whether a word near a term is no misspelling of it."""

    def __init__(self, terms: dict[str, tuple[int, bool]], benign: frozenset = frozenset(), known: np.ndarray | None = None):
        """``benign``: near words of clean texts; ``known``: the sorted letter sequences of all words of clean texts."""
        self.terms, self.benign = terms, benign
        self.known = np.zeros(0, np.int64) if known is None else known

    def __call__(self, term: str, word: str) -> bool:
        if word in self.benign:
            return True
        new = grams(word)
        if self.terms[term][1]:  # an ending says nothing about the beginning
            new = grams(word[: len(term)]) - {zlib.crc32(f"^{word[: len(term)]}$"[-GRAM:].encode("utf-8", "replace"))}
        new = np.array(sorted(new - grams(term)), np.int64)
        if not len(new) or not len(self.known):
            return False
        at = np.minimum(np.searchsorted(self.known, new), len(self.known) - 1)
        return bool((self.known[at] == new).all())


class Finder:
    """Hits of whole texts; remembers words that are no hits. Words that are ``ordinary`` are met by exact terms only."""

    def __init__(self, terms: dict[str, tuple[int, bool]], ordinary: Ordinary | None = None):
        self.automaton, self.ordinary = Automaton(terms), ordinary
        self.clean: set[str] = set()
        self.known: dict[str, tuple[str, int]] = {}

    def hits(self, text: str) -> list[tuple[str, str, int, bool]]:
        """(term, word, edits, quotation) of each hit, in order."""
        words = text.lower().split()
        fresh = set(words)
        fresh -= self.clean
        found = False
        for w in fresh:
            if w in self.known:
                found = True
                continue
            core = _EDGE.sub("", w)
            hit = self.automaton.match(core) if core else None
            if hit and not (hit[1] and self.ordinary and self.ordinary(hit[0], core)):
                self.known[w], found = hit, True
            else:
                self.clean.add(w)
        if len(self.clean) > REMEMBERED:
            self.clean.clear()
        if not found:
            return []
        return [(self.known[w][0], _EDGE.sub("", w), self.known[w][1], quoted(words, k))
                for k, w in enumerate(words) if w in self.known]


def features(hits: list[tuple[str, str, int, bool]]) -> np.ndarray:
    """1, then log2(1 + hits) of each kind."""
    counts = np.zeros(4)
    for _, _, edits, quotation in hits:
        counts[2 * quotation + (edits > 0)] += 1
    return np.concatenate([[1.0], np.log2(1 + counts)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_weights(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, with a Gaussian prior."""
    weights, precision = PRIOR.copy(), np.diag(1 / PRIOR_SPREAD ** 2)

    def loss(w: np.ndarray) -> float:
        z, off = rows @ w, w - PRIOR
        return float(np.logaddexp(0, z).sum() - labels @ z + off @ precision @ off / 2)

    for _ in range(50):
        p = sigmoid(rows @ weights)
        slope = rows.T @ (labels - p) - precision @ (weights - PRIOR)
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + precision
        step = np.linalg.solve(bend, slope)
        while np.abs(step).max() > 1e-9 and loss(weights + step) > loss(weights):
            step = step / 2
        weights = weights + step
        if np.abs(step).max() <= 1e-9:
            break
    return weights


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts hold each word and each word beginning.

    Near copies of one text would make all its words look like terms. Toxic texts so count by their smallest word-pair
    hash, which near copies mostly share.
    """
    schema = pa.schema([("term", pa.string()), ("whole", pa.bool_()), ("toxic", pa.int64()), ("clean", pa.int64()),
                        ("keys", pa.list_(pa.int64()))])
    clean: Counter = Counter()
    toxic: dict[tuple, list[int]] = {}
    for batch in slices(batches):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            listed = (text or "").lower().split()
            words = {_EDGE.sub("", w) for w in set(listed)} - {""}
            held = {(w, True) for w in words}
            held |= {(w[:n], False) for w in words for n in range(SHORTEST_STEM, min(LONGEST_STEM, len(w)) + 1)}
            if label:
                key = min((zlib.crc32(" ".join(pair).encode()) for pair in zip(listed, listed[1:])), default=0)
                for item in held:
                    toxic.setdefault(item, []).append(key)
            else:
                clean.update(held)
    keys = list(toxic.keys() | clean.keys())
    for at in range(0, len(keys), 65536):
        some = keys[at: at + 65536]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in some], pa.string()), pa.array([k[1] for k in some]),
             pa.array([len(toxic.get(k, ())) for k in some], pa.int64()), pa.array([clean[k] for k in some], pa.int64()),
             pa.array([toxic.get(k, []) for k in some], pa.list_(pa.int64()))], schema=schema)


def learn_terms(sample: DataFrame) -> dict[str, bool]:
    """Terms from (text, toxic) rows; true for a beginning that any ending may follow."""
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic:
        return {}
    ratio = ((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) / ((F.col("clean") + 0.5) / F.lit(clean + 1.0))
    counted = sample.select("text", "toxic").mapInArrow(
        _term_counts, "term string, whole boolean, toxic long, clean long, keys array<long>").groupBy(
        "term", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
                             F.size(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("texts"))
    least = max(LEAST_DOCS, round(LEAST_SHARE * toxic))
    # bounded by the bounded sample
    strong = counted.filter((F.col("texts") >= least) & (ratio >= LEAST_RATIO)).collect()
    whole = {r.term: r.texts for r in strong if r.whole}
    stems = {r.term: r.texts for r in strong if not r.whole}
    chosen: dict[str, bool] = {}
    for stem in sorted(stems, key=lambda s: (len(s), s)):
        most = max((n for w, n in whole.items() if w.startswith(stem)), default=0)
        if stems[stem] < 1.5 * least or stems[stem] < 1.5 * most or any(stem.startswith(s) for s in chosen):
            continue
        while longer := [s for s in stems if s[:-1] == stem and stems[s] >= 0.95 * stems[stem]]:
            stem = longer[0]
        chosen[stem] = True
    return {w: False for w in whole} | chosen


def _clean_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letter sequences of all words of clean texts."""
    words: set[str] = set()
    found: set[int] = set()
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            fresh = {_EDGE.sub("", w) for w in (text or "").lower().split()} - words - {""}
            found.update(*map(grams, fresh))
            words |= fresh
            if len(words) > REMEMBERED:
                words.clear()
    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["gram"])


class Model:
    """Terms with their edits, what looks like a misspelling but isn't, and the weights."""

    def __init__(self, terms: dict[str, tuple[int, bool]], ordinary: Ordinary, weights: np.ndarray):
        self.terms, self.ordinary, self.weights = terms, ordinary, weights

    def score(self, hits: list[tuple[str, str, int, bool]]) -> float:
        kept = [h for h in hits if not (h[2] and self.ordinary(h[0], h[1]))]
        return float(sigmoid(features(kept) @ self.weights))


def train(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text",
          rows: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``rows`` labelled documents; ``usable`` is a column over the id. Without labels the prior stays."""
    rated = labels.select(F.col(key).alias("_id"), F.col("toxic").cast("int").alias("toxic")).withColumnRenamed("_id", key)
    rated = bounded_sample(rated.filter(F.col(key).isNotNull() & F.col("toxic").isin(0, 1) & usable), key, rows)
    sample = docs.select(F.col(key).alias("_doc"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(rated), F.col("_doc") == F.col(key)).select("text", "toxic").persist()
    try:
        learned = learn_terms(sample)
        terms = {t: (edits_for(t), stem) for t, stem in learned.items()}

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(terms)
            schema = pa.schema([("toxic", pa.int32()), ("term", pa.string()), ("word", pa.string()),
                                ("edits", pa.int32()), ("quotation", pa.bool_()), ("doc", pa.int64())])
            doc = 0
            for batch in slices(batches):
                out = []
                for body, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    doc += 1
                    out += [(label, *h, doc) for h in finder.hits(body or "")] or [(label, None, None, 0, False, doc)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)],
                                                     schema=schema)

        found = sample.mapInArrow(collect, "toxic int, term string, word string, edits int, quotation boolean, doc long"
                                  ).withColumn("part", F.spark_partition_id()).toArrow().to_pylist()
        # bounded by the bounded sample
        known = sample.filter("toxic = 0").select("text").mapInArrow(_clean_grams, "gram long").distinct().toArrow()
    finally:
        sample.unpersist()
    benign = frozenset(r["word"] for r in found if r["term"] and r["edits"] and not r["toxic"])
    ordinary = Ordinary(terms, benign, np.sort(known.column(0).to_numpy()))
    by_doc: dict[tuple, list] = {}
    for r in found:
        hits = by_doc.setdefault((r["part"], r["doc"], r["toxic"]), [])
        if r["term"] and not (r["edits"] and ordinary(r["term"], r["word"])):
            hits.append((r["term"], r["word"], r["edits"], r["quotation"]))
    if not by_doc:
        return Model(terms, ordinary, PRIOR)
    kinds = Counter((*features(h), k[2]) for k, h in by_doc.items())
    table = np.array([k for k, n in sorted(kinds.items()) for _ in range(n)])
    return Model(terms, ordinary, fit_weights(table[:, :-1], table[:, -1]))


def score_toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, hits) of every row. Null and empty texts have no hits and get the score of the bias alone.

    Repeated rows each give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("hits", pa.int64())])
        finder = Finder(shared.value.terms, shared.value.ordinary)
        for batch in slices(batches):
            hits = [finder.hits(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shared.value.score(h) for h in hits], pa.float64()),
                 pa.array([len(h) for h in hits], pa.int64())], schema=schema)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id long, score double, hits long")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, with all their columns; null and empty texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(columns: list[pa.Array], finder: Finder) -> list[bool]:
        return [shared.value.score(finder.hits(t)) < threshold if t else True for t in columns[0].to_pylist()]

    return keep_rows(docs, judge, [text], lambda: Finder(shared.value.terms, shared.value.ordinary))
