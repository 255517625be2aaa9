"""Byte-pair encoding with word ends, and its decoding, as a tokenizer file describes them.

A word's symbols form a doubly linked list. A priority queue holds every neighbouring pair that has a merge, by rank and
then by place; a popped entry whose symbols have changed since is stale and skipped. Decoding looks ids up in the
vocabulary and puts the strings together with the separator the file's decoder asks for (a space where it has none).

Text is prepared as the file says: special tokens are cut out first, the rest is composed (NFC), lower-cased by code point
and taken apart by the file's pattern; white space between matches is dropped. Words are mapped to byte symbols.

A worker remembers the words it has met in two generations of at most ``REMEMBERED`` bytes each, so its memory is bounded
however many words a corpus has. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from varigrade.llm.common import slices

VOCABULARY = "word_bpe_49k.json"
#: Bytes of remembered words per generation and worker.
REMEMBERED = 64 << 20
#: Longer words are encoded each time they occur: remembering them would push out thousands of others.
LONGEST_REMEMBERED = 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b in set(printable) else chr(256 + rest.index(b)) for b in range(256)]


class WordBPE:
    """Encoder and decoder of one tokenizer file of the kind described above; any other kind is refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        known = (model["type"] == "BPE" and steps == ["NFC", "Replace", "Lowercase"] and split["type"] == "Split"
                 and split["invert"] and split["behavior"] == "Removed" and level["type"] == "ByteLevel"
                 and not level["use_regex"] and not level["add_prefix_space"] and not spec["post_processor"]
                 and not spec["decoder"] and not model["ignore_merges"] and not model["byte_fallback"]
                 and not model["continuing_subword_prefix"] and not spec["truncation"] and not spec["padding"])
        if not known:
            raise ValueError(f"not a word-end BPE file: {path}")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.rare = re.compile("[^\x00-\u02ff\u2010-\u205e\u20a0-\u20bf]")
        self.library = Tokenizer.from_file(path)  # prepares rare text; ids never come from it
        self.inner = byte_symbols()
        #: left symbol << bits | right symbol -> rank; and the symbol a rank makes
        self.bits = len(self.vocabulary).bit_length()
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            self.ranks[self.vocabulary[left] << self.bits | self.vocabulary[right]] = rank
            self.made.append(self.vocabulary[left + right])
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.held = 0

    def symbols(self, word: str) -> list[int]:
        text = [self.inner[b] for b in word.encode()]
        text[-1] += self.suffix
        return [self.vocabulary[s] for s in text]

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges in order of rank, ties from the left, until none is left.

        A queue entry is rank * size + place of the left symbol. -1 marks a symbol merged into its left neighbour.
        """
        size, bits, rank_of, made = len(symbols), self.bits, self.ranks.get, self.made
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        queue = []
        for at in range(size - 1):
            rank = rank_of(symbols[at] << bits | symbols[at + 1])
            if rank is not None:
                queue.append(rank * size + at)
        heapq.heapify(queue)
        while queue:
            rank, at = divmod(heapq.heappop(queue), size)
            left, right = symbols[at], after[at]
            if left < 0 or right == size or rank_of(left << bits | symbols[right]) != rank:
                continue  # stale: one of the two symbols is gone or has changed
            merged = made[rank]
            symbols[at], symbols[right] = merged, -1
            after[at] = following = after[right]
            if following < size:
                before[following] = at
                rank = rank_of(merged << bits | symbols[following])
                if rank is not None:
                    heapq.heappush(queue, rank * size + at)
            previous = before[at]
            if previous >= 0:
                rank = rank_of(symbols[previous] << bits | merged)
                if rank is not None:
                    heapq.heappush(queue, rank * size + previous)
        return [s for s in symbols if s >= 0]

    def encode_word(self, word: str) -> list[int]:
        return self.merge(self.symbols(word))

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary strings of all ids, with a space between them; unknown ids are left out."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def words(self, text: str) -> list[str]:
        """The words of a text, prepared and split.

        Texts of letters before U+0300, plain punctuation and currency signs are composed already. Others are prepared by
        the library, whose tables differ from Python's in rare marks; so is the split where a code point is too new.
        """
        if text.isascii() or not self.rare.search(text):
            return self.pattern.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        if all(unicodedata.category(c) != "Cn" for c in set(text)):
            return self.pattern.findall(text)
        place = {c: b for b, c in enumerate(self.inner)}
        return [bytes(place[c] for c in word).decode() for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _look_up(self, word: str) -> tuple[bytes, str]:
        found = self.young.get(word) or self.old.get(word)
        if found is None:
            ids = self.encode_word(word)
            found = (struct.pack(f"<{len(ids)}I", *ids), self.decode(ids))
        if len(word) <= LONGEST_REMEMBERED:
            if self.held > REMEMBERED:
                self.old, self.young, self.held = self.young, {}, 0
            if word not in self.young:
                self.held += 120 + sys.getsizeof(word) + sys.getsizeof(found[0]) + sys.getsizeof(found[1])
                self.young[word] = found
        return found

    def pieces(self, text: str) -> Iterator[list[tuple[bytes, str]]]:
        """(ids as bytes, decoded string) of the text's words and special tokens, in runs."""
        at = 0
        for special in self.cut.finditer(text) if "<" in text else ():
            yield self._run(text[at: special.start()])
            number = self.special[special.group()]
            yield [(struct.pack("<I", number), self.strings[number])]
            at = special.end()
        yield self._run(text[at:] if at else text)

    def _run(self, text: str) -> list[tuple[bytes, str]]:
        words = self.words(text)
        found = list(map(self.young.get, words))
        if None in found:
            found = [f or self._look_up(w) for f, w in zip(found, words)]
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """(all ids as little-endian u32, the text they decode to)."""
        runs = [p for run in self.pieces(text) for p in run]
        return b"".join([p[0] for p in runs]), " ".join([p[1] for p in runs])


_coders: dict[str, WordBPE] = {}


def coder(path: str) -> WordBPE:
    """One coder per worker and file, so tasks that share a worker share its memory of words."""
    if path not in _coders:
        _coders[path] = WordBPE(path)
    return _coders[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string) of every whole text; a null or empty text has no ids and decodes to ``''``.

    Repeated rows and rows without a key are encoded like any other; other columns are left behind; an empty table
    gives no rows.
    """
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in slices(batches, 64):
            encoded = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            ids = pa.array([np.frombuffer(e[0], "<u4").astype(np.int32) for e in encoded], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([e[1] for e in encoded], pa.string())],
                                             schema=schema)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, ids array<int>, decoded string").withColumnRenamed("key", key)


def digest_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every whole text, as ``encode_documents`` gives them.

    Digests are taken beside the encoder, so ids and decoded texts never leave a task.
    """
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in slices(batches):
            counts, ids, decoded = [], [], []
            for t in batch.column(1).to_pylist():
                raw, out = bpe.encode(t or "")
                counts.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(out.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                                              pa.array(decoded, pa.string())], schema=schema)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed(
        "key", key)
