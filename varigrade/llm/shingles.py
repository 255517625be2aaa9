"""Word n-gram sets of texts as 64-bit hashes, computed on whole Arrow text buffers with numpy.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r, after lower-casing A-Z. All steps work on bytes, so any
UTF-8 text is handled, and a text is read to its end whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from varigrade.llm.common import utf8_views

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_VALUES[_SPACE] = 0
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        size = max(size, CHUNK + 1024)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _words_of(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of ``raw``; a word also begins wherever ``first`` is true."""
    forward, back = _power_tables(len(raw) + 1)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    total = np.cumsum(_VALUES[raw] * forward[: len(raw)], dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix((total[stops] - before) * back[starts]), starts


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end at white space."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw):
            gap = np.flatnonzero(_SPACE[raw[end: end + CHUNK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(raw), end + CHUNK)
        yield raw[at:end]
        at = end


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    raw, starts, ends = utf8_views(texts)
    row, count = 0, len(starts)
    while row < count:
        if ends[row] - starts[row] > CHUNK:
            whole = raw[starts[row]: ends[row]]
            yield np.concatenate([_words_of(p, np.zeros(len(p), bool))[0] for p in _pieces(whole)])
            row += 1
            continue
        last = row + 1
        while last < count and ends[last] - starts[row] <= CHUNK and ends[last] >= starts[last]:
            last += 1
        part = raw[starts[row]: ends[last - 1]]
        first = np.zeros(len(part) + 1, bool)
        first[starts[row:last] - starts[row]] = True
        hashes, at = _words_of(part, first[:-1])
        low = np.searchsorted(at, starts[row:last] - starts[row])
        high = np.searchsorted(at, ends[row:last] - starts[row])
        for a, b in zip(low, high):
            yield hashes[a:b]
        row = last


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word runs; all words as one run if there are fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    run = min(width, len(words))
    total = np.full(len(words) - run + 1, np.uint64(run))
    with np.errstate(over="ignore"):
        for k in range(run):
            total = total * _BASE + words[k: len(words) - run + 1 + k]
    return np.unique(mix(total))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for words in word_hashes(texts):
        yield shingle_set(words, width)
