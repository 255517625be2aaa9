"""Token ids in packed binary files: every id takes the fewest bits that hold the vocabulary.

File layout, all numbers little-endian:

    blocks   each ``BLOCK`` ids (the last one fewer), bit-packed from the low bit up, padded to a whole byte
    offsets  u64 per block: its first byte
    docs     i64 ids, then u8 flags (1: the id is null), then u64 counts of ids
    tail     u64 block count, u64 document count, u64 id count, u32 bits, u32 block size, 8 bytes magic

Any block can be found by its offset and unpacked by itself with numpy, so a document is read without what precedes it.

Documents are range-partitioned by id and sorted, so the files in partition order hold ascending ids. A task writes to a
name of its own and reports it in the manifest, a Parquet table that Spark commits only with the reports of
successful tasks; files of lost attempts are never read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varigrade.llm.common import slices
from varigrade.session import scratch_path

BLOCK = 1 << 16
MAGIC = b"VGPACK01"
VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text segments and their ids that a Python worker remembers in each of two generations.
REMEMBERED_BYTES = 160 << 20
#: What a remembered segment takes besides its characters and ids: string head, table slots, places.
SEGMENT_BYTES = 180
#: Fresh segments that are encoded as one text.
JOINED = 256
_SEGMENT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+\Z")
_PLAIN_SEGMENT = re.compile(r"\s*\S+|\s+\Z")  # the same where none of the four separators occurs
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_TAIL = np.dtype([("blocks", "<u8"), ("docs", "<u8"), ("ids", "<u8"), ("bits", "<u4"), ("block", "<u4"),
                  ("magic", "S8")])
_MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])


def bits_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-bit numbers, low bit first."""
    if bits in (8, 16, 32):  # the same bytes without going through single bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    single = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(single.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    single = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return single.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """Streams ids into one packed file."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.at = 0
        self.offsets: list[int] = []
        self.names: list[np.ndarray] = []
        self.absent: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, names: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.absent.append(np.asarray(names.is_null(), np.uint8))
        self.names.append(names.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.counts.append(counts.astype("<u8"))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            whole = np.concatenate(self.waiting)
            for k in range(0, len(whole) - BLOCK + 1, BLOCK):
                self._block(whole[k: k + BLOCK])
            self.waiting = [whole[len(whole) // BLOCK * BLOCK:].copy()]
            self.held = len(self.waiting[0])

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.sink.write(data)
        self.at += len(data)
        self.ids += len(ids)

    def close(self) -> tuple[int, int]:
        if self.held:
            self._block(np.concatenate(self.waiting))
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        docs = 0
        for parts, kind in ((self.names, "<i8"), (self.absent, "u1"), (self.counts, "<u8")):
            whole = np.concatenate(parts) if parts else np.zeros(0, kind)
            docs = len(whole)
            self.sink.write(whole.astype(kind).tobytes())
        self.sink.write(np.array([(len(self.offsets), docs, self.ids, self.bits, BLOCK, MAGIC)], _TAIL).tobytes())
        self.sink.close()
        return docs, self.ids


class Reader:
    """Random access to one packed file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = np.frombuffer(source.read_at(_TAIL.itemsize, size - _TAIL.itemsize), _TAIL)[0]
        if tail["magic"] != MAGIC:
            raise ValueError("not a packed token file")
        self.bits, self.block, self.ids, docs = (int(tail[c]) for c in ("bits", "block", "ids", "docs"))
        blocks = int(tail["blocks"])
        at = size - _TAIL.itemsize - 8 * blocks - 17 * docs
        index = source.read_at(8 * blocks + 17 * docs, at)
        self.offsets = np.append(np.frombuffer(index, "<u8", blocks), np.uint64(at))
        self.names = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.absent = np.frombuffer(index, "u1", docs, 8 * (blocks + docs)).astype(bool)
        self.counts = np.frombuffer(index, "<u8", docs, 8 * (blocks + docs) + docs).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self._kept = (-1, np.zeros(0, np.uint32))

    def _one(self, k: int) -> np.ndarray:
        if self._kept[0] != k:
            low, high = int(self.offsets[k]), int(self.offsets[k + 1])
            count = min(self.block, self.ids - k * self.block)
            self._kept = (k, unpack(self.source.read_at(high - low, low), count, self.bits))
        return self._kept[1]

    def pieces(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, a block's share at a time."""
        end = start + count
        while start < end:
            k, inner = divmod(start, self.block)
            take = min(self.block - inner, end - start)
            yield self._one(k)[inner: inner + take]
            start += take

    def ids_of(self, doc: int) -> np.ndarray:
        found = list(self.pieces(int(self.starts[doc]), int(self.counts[doc])))
        return np.concatenate(found) if found else np.zeros(0, np.uint32)


class Remembered(dict):
    """Places of segments by text; an unseen one takes the next place and is listed in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = self.bytes = 0

    def __missing__(self, segment: str) -> int:
        place = self[segment] = len(self)
        self.fresh.append(segment)
        return place

    def keep(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the fresh segments, one after the other."""
        end, places = self.used + len(ids), len(self)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while places > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used: end] = ids
        at = slice(places - len(self.fresh), places)
        self.length[at] = sizes
        self.first[at] = self.used + np.cumsum(sizes) - sizes
        self.used = end
        self.bytes += SEGMENT_BYTES * len(self.fresh) + 2 * sum(map(len, self.fresh)) + 4 * len(ids)
        self.fresh = []

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the segments at these places in a row, their counts)."""
        sizes = self.length[at]
        upto = np.cumsum(sizes)
        source = np.repeat(self.first[at] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)
        return self.flat[source], sizes


class Segments:
    """Ids of texts by way of their segments: white space with the non-space run after it.

    The byte-level pattern never joins text across the start of a white-space run, so segments can be encoded apart from
    each other and remembered. Fresh segments go through the tokenizers library in few long texts; as a token's bytes are
    known, the ids fall to segments by running length. The first segment of a text without white space before it, and white space
    at the end of a text, are texts of their own there; should a token cross a border all the same, each segment is one.

    Segments are remembered in two generations of ``limit`` bytes: a full one becomes the older one, whose ids are
    taken over when they are met again and forgotten when the next one is full. A single batch may exceed the limit.
    """

    def __init__(self, path: str, limit: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        size = self.tokenizer.get_vocab_size()
        self.bits = bits_for(size)
        added = self.tokenizer.get_added_tokens_decoder()
        # a character of a byte-level token stands for one byte
        self.token_bytes = np.array([len(added[i].content.encode()) if i in added
                                     else len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.older, self.newer = self._empty(), self._empty()

    @staticmethod
    def _empty() -> Remembered:
        made = Remembered()
        made[""]  # place 0 is the end-of-document id
        made.keep(np.zeros(1, np.uint32), np.ones(1, np.int64))
        return made

    def _encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, their counts)."""
        texts, held = [], []
        for s in segments:
            if s[0].isspace() and not s[-1].isspace() and not "\x1c" <= s[0] <= "\x1f":
                held.append(s)
                if len(held) < JOINED:
                    continue
            if held:
                texts.append("".join(held))
            if not held or held[-1] is not s:  # might join with its neighbours: no white space first, or last
                texts.append(s)
            held = []
        texts.append("".join(held))
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
        borders = np.cumsum(np.fromiter(map(len, map(str.encode, segments)), np.int64, len(segments)))
        ends = np.cumsum(self.token_bytes[ids])
        upto = np.searchsorted(ends, borders, "right")
        if len(ends) and ends[-1] == borders[-1] and (upto > 0).all() and (ends[upto - 1] == borders).all():
            return ids, np.diff(upto, prepend=0)
        alone = [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        sizes = np.fromiter(map(len, alone), np.int64, len(alone))
        return np.array([i for x in alone for i in x], np.uint32), sizes

    def _learn(self) -> None:
        fresh = self.newer.fresh
        sizes = np.zeros(len(fresh), np.int64)
        known = np.fromiter(map(self.older.get, fresh, repeat(-1)), np.int64, len(fresh))
        again = known >= 0
        old_ids, sizes[again] = self.older.gather(known[again])
        ids, sizes[~again] = self._encode([s for s, k in zip(fresh, again) if not k]) if not again.all() \
            else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        whole, old = np.zeros(len(ids) + len(old_ids), np.uint32), np.repeat(again, sizes)
        whole[old], whole[~old] = old_ids, ids
        self.newer.keep(whole, sizes)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; their counts)."""
        if self.newer.bytes > self.limit:
            self.older, self.newer = self.newer, self._empty()
        parts: list[str] = []
        ends = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                pattern = _SEGMENT if any(c in text for c in _SEPARATORS) else _PLAIN_SEGMENT
                parts += pattern.findall(text)
            parts.append("")
            ends[k] = len(parts)
        at = np.fromiter(map(self.newer.__getitem__, parts), np.int64, len(parts))
        if self.newer.fresh:
            self._learn()
        ids, sizes = self.newer.gather(at)
        upto = np.cumsum(sizes)
        last = upto[ends - 1] if len(ends) else np.zeros(0, np.int64)
        return ids, np.diff(last, prepend=0)


_encoders: dict[str, Segments] = {}


def _encoder(path: str) -> Segments:
    if path not in _encoders:
        _encoders[path] = Segments(path)
    return _encoders[path]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                      folder: str | None = None) -> DataFrame:
    """Encode every document and write packed files; returns the manifest (part, file, docs, ids).

    Rows go in ascending id order, nulls first, equal ids by text; repeated rows are written as often as they occur. A
    null or empty text is the end id alone. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    files, place = _open(folder)
    files.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = _encoder(tokenizer), None
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.pack"
        for batch in slices(batches, 256):
            if not batch.num_rows:
                continue
            if writer is None:
                files, place = _open(name)
                writer = Writer(files.open_output_stream(place), encoder.bits)
            ids, counts = encoder.encode(batch.column(1).to_pylist())
            writer.add(batch.column(0), counts, ids)
        if writer is not None:
            docs_written, ids_written = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([docs_written]),
                                              pa.array([ids_written])], schema=_MANIFEST)

    manifest = scratch_path(spark, "manifest")
    (docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
     .repartitionByRange("key").sortWithinPartitions("key", "text")
     .mapInArrow(run, "part long, file string, docs long, ids long").write.parquet(manifest))
    return spark.read.schema("part long, file string, docs long, ids long").parquet(manifest)


def read_token_files(manifest: DataFrame, with_ids: bool = True, key: str = "doc_id") -> DataFrame:
    """Documents of the files in order: id, start (ids before it in all files), n_tokens, ids_crc32, ids.

    Without ``with_ids`` a document is read a block at a time and only its figures leave the task.
    """
    total = manifest.count()  # one row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("part", "file", "base")
    fields = [(key, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                files, place = _open(uri)
                with files.open_input_file(place) as source:
                    reader = Reader(source)
                    for at in range(0, len(reader.counts), 1024):
                        docs = range(at, min(at + 1024, len(reader.counts)))
                        here = slice(at, docs.stop)
                        crc, ids = np.zeros(len(docs), np.int64), []
                        for k, doc in enumerate(docs):
                            found = 0
                            for piece in reader.pieces(int(reader.starts[doc]), int(reader.counts[doc])):
                                found = zlib.crc32(piece.astype("<u4").tobytes(), found)
                            crc[k] = found
                            if with_ids:
                                ids.append(reader.ids_of(doc).astype(np.int32))
                        columns = [pa.array(reader.names[here], mask=reader.absent[here]),
                                   pa.array(base + reader.starts[here]), pa.array(reader.counts[here]), pa.array(crc)]
                        yield pa.RecordBatch.from_arrays(
                            columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), schema=schema)

    ddl = f"`{key}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return placed.repartitionByRange(max(1, total), "part").mapInArrow(run, ddl)
