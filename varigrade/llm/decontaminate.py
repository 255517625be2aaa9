"""Benchmark passages in documents, found by pigeonhole edit matching.

Every window of ``PASSAGE`` words of a test item is a passage, so quoting that many words of it in a row is found wherever
they begin; a shorter item is one passage. A passage of m characters may differ by ``k = rate * m`` edits. An item is cut
into pieces of which every passage holds k + 1 at least: k edits can't touch all of them, so every occurrence holds one
unchanged. An Aho-Corasick automaton finds all pieces in one walk over each text, and each hit is verified around its place
with Myers' bit-parallel distance. Items under ``SHORTEST`` words must occur as they are, between word bounds.

Texts are compared in lower case with runs of white space and punctuation as one space. The benchmark is a stated set of
test items; its automaton is built from at most ``MOST_CHARS`` characters at a time, and a larger benchmark takes further
walks over the documents. The documents are never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrade.llm.common import keep_rows, slices

PASSAGE, SHORTEST, RATE = 16, 8, 0.06
#: Characters of items in one automaton; bounds what is sent to the executors.
MOST_CHARS = 2_000_000
_GAP = re.compile(r"[\W_]+")
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()),
                    ("edits", pa.int32()), ("allowed", pa.int32())])
FOUND = "doc_id long, item_id long, begin long, end long, edits int, allowed int"


def normalize(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def windows(text: str, words: int = PASSAGE) -> list[tuple[int, int]]:
    """(begin, end) of every window of ``words`` words in a normalized text; all of a shorter one, none of an empty one."""
    if not text:
        return []
    begins = [0, *(k + 1 for k, c in enumerate(text) if c == " ")]
    ends = [*(k - 1 for k in begins[1:]), len(text)]
    last = max(1, len(begins) - words + 1)
    return [(begins[k], ends[min(k + words, len(begins)) - 1]) for k in range(last)]


def passages(text: str | None, words: int = PASSAGE) -> list[str]:
    """The different word windows of an item; a shorter item is one."""
    found = normalize(text)
    return list(dict.fromkeys(found[a:b] for a, b in windows(found, words)))


def pieces(size: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(begin, end) of equal pieces of an item; every span (begin, end, edits) holds ``edits + 1`` whole ones at least."""
    if len(spans) == 1:
        edits = spans[0][2]
        cuts = [size * k // (edits + 1) for k in range(edits + 2)]
        return list(zip(cuts, cuts[1:]))
    width = max(1, min((b - a + 1) // (edits + 2) for a, b, edits in spans))
    return [(at, at + width) for at in range(0, size - width + 1, width)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(fewest edits, end) of the best match of the whole pattern anywhere in the text; the first end among equals."""
    size = len(pattern)
    mask, top = (1 << size) - 1, 1 << (size - 1)
    places: dict[str, int] = {}
    for k, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << k
    up, down, score = mask, 0, size
    best, end = size, 0
    for k, c in enumerate(text):
        equal = places.get(c, 0)
        across = (((equal & up) + up) ^ up) | equal | down
        plus, minus = (down | ~(across | up)) & mask, up & across
        score += bool(plus & top) - bool(minus & top)
        plus = plus << 1 & mask  # a match may begin at any place of the text
        minus = minus << 1 & mask
        vertical = equal | down
        up, down = (minus | ~(vertical | plus)) & mask, plus & vertical
        if score < best:
            best, end = score, k + 1
    return best, end


class Matcher:
    """All pieces of all items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        #: (item, normalized text, [(begin, end, edits) of its passages]); no passages: met as it is.
        self.units: list[tuple[int, str, list[tuple[int, int, int]]]] = []
        self.around: dict[tuple[int, int], tuple] = {}
        self.automaton = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for ident, body in items:
            text = normalize(body)
            if not text:
                continue
            spans = []
            if text.count(" ") + 1 >= SHORTEST:
                seen: dict[str, tuple[int, int, int]] = {}
                for a, b in windows(text):
                    seen.setdefault(text[a:b], (a, b, max(1, int((b - a) * rate))))
                spans = list(seen.values())
            for a, b in pieces(len(text), spans) if spans else [(0, len(text))]:
                if a < b:
                    held.setdefault(text[a:b], []).append((len(self.units), a))
            self.units.append((ident, text, spans))
        for piece, owners in held.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if held:
            self.automaton.make_automaton()

    def _around(self, unit: int, at: int, size: int) -> tuple[list[tuple[int, int, int]], int, str | None, str | None]:
        """The passages that hold a piece, their most edits, and what is left and right of it.

        The larger side of the piece in any of them holds all of the left or all of the right text; none where no passage
        reaches so far.
        """
        _, body, spans = self.units[unit]
        held = []
        for k in range(bisect_left(spans, at + size, key=itemgetter(1)), len(spans)):
            if spans[k][0] > at:
                break
            held.append(spans[k])
        side = max(0, min((b - a - size for a, b, _ in held), default=0)) // 2
        left, right = body[max(0, at - side): at], body[at + size: at + size + side]
        self.around[unit, at] = found = (held, max((e for *_, e in held), default=0),
                                         left if len(left) == side else None, right if len(right) == side else None)
        return found

    @staticmethod
    def _near(around: tuple, text: str, first: int, last: int) -> bool:
        """Whether the left or the right text lies beside the piece within the edits; no passage matches otherwise."""
        _, edits, left, right = around
        if right is not None and text.startswith(right, last):
            return True
        if left is not None and text.endswith(left, 0, first):
            return True
        return (right is not None and myers(right, text[max(0, last - 2 * edits): last + len(right) + 4 * edits])[0] <= edits
                or left is not None
                and myers(left, text[max(0, first - len(left) - 2 * edits): first + 4 * edits])[0] <= edits)

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, begin, end, edits, allowed) in the normalized text, overlapping windows of one passage once."""
        if not self.units:
            return
        places: dict[tuple[int, int, int, int], list[tuple[int, int]]] = {}
        for last, (size, owners) in self.automaton.iter(text):
            first = last + 1 - size
            for unit, at in owners:
                ident, body, spans = self.units[unit]
                if not spans:
                    if (not first or text[first - 1] == " ") and (last + 1 == len(text) or text[last + 1] == " "):
                        yield ident, first, last + 1, 0, 0
                    continue
                around = self.around.get((unit, at)) or self._around(unit, at, size)
                if not self._near(around, text, first, last + 1):
                    continue
                for a, b, edits in around[0]:
                    low = first - (at - a) - edits
                    places.setdefault((unit, a, b, edits), []).append((max(0, low), min(len(text), low + b - a + 2 * edits)))
        for (unit, a, b, edits), found in places.items():
            item, passage = self.units[unit][0], self.units[unit][1][a:b]
            checked = -1
            for low, high in sorted(set(found)):
                if high <= checked:
                    continue
                exact = text.find(passage, low, high)
                if exact >= 0:
                    checked = high
                    yield item, exact, exact + len(passage), 0, edits
                    continue
                best, end = myers(passage, text[low:high])
                if best <= edits:
                    checked = high
                    back, length = myers(passage[::-1], text[low: low + end][::-1])
                    yield item, low + end - length, low + end, best, edits


def _chunks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The stated test items, at most about ``MOST_CHARS`` characters at a time; at least one chunk."""
    chunk: list[tuple[int, str]] = []
    size, given = 0, False
    for ident, body in benchmark.select(F.col(item).cast("long"), F.col(text).cast("string")).toLocalIterator():
        chunk.append((ident, body))
        size += len(body or "")
        if size >= MOST_CHARS:
            yield chunk
            chunk, size, given = [], 0, True
    if chunk or not given:
        yield chunk


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, key: str = "doc_id",
                       text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document, item and place: doc_id, item_id, begin, end (in the normalized text), edits, allowed.

    Null or empty texts and items match nothing. Repeated documents give their rows again, equal
    items each give a row. Either table may be empty.
    """
    source = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))

    def walk(items: list[tuple[int, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in slices(batches):
                rows = [(ident, *m) for ident, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                        if body for m in sorted(matcher.matches(normalize(body)))]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)

        return source.mapInArrow(run, FOUND)

    return reduce(DataFrame.union, map(walk, _chunks(benchmark, item, item_text)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", item: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no test item is found; null and empty texts stay."""

    def without(kept: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def judge(columns: list[pa.Array], matcher: Matcher) -> list[bool]:
            return [next(matcher.matches(normalize(t)), None) is None if t else True for t in columns[0].to_pylist()]

        return keep_rows(kept, judge, [text], lambda: Matcher(shared.value, rate))

    return reduce(without, _chunks(benchmark, item, item_text), docs)
