"""Near-duplicate classes by an n-gram Jaccard join with rare-first prefix filtering.

A document's n-gram set is that of ``shingles``. Documents with equal sets form a class, known by a digest of the set, so copies
never meet as pairs. Between classes the join is exact:

* n-grams are ordered rare first. Frequencies come from all documents, in a table of ``2**SKETCH_BITS`` hashed counters
  whose size doesn't depend on the corpus. The counters only choose the order; any common order gives the same links.
* Two sets that reach the threshold share an n-gram among the first ``n - ceil(t n) + 1`` of each (prefix filter).
* A shared n-gram makes a candidate only if set sizes (length filter), places in the order (positional filter) and the
  sizes of what follows in four hash ranges (suffix filter) leave room for the needed overlap, were it the first n-gram the
  two share. A linked pair passes at the first it does share, so none is lost.
* Candidates meet by parity sketches first: bit ``i`` of a set's sketch tells whether an odd number of its n-grams hash to
  ``i``. Bits in which two sketches differ are at most the n-grams the sets don't share, so too many of them rule the pair out.
* Each pair left is verified once, on the whole sets.

Only the components are asked for, so a pair is a candidate only while its ends are in different components. In
each opening round a set meets one pivot. The pivot of an n-gram is the set that has it earliest in the order (ties: that
round's hash): with the fewest n-grams of its own ahead it is nearest to all its copies. A group of n near copies so costs
about n verifications, not n squared. The closing round takes every candidate pair still between components, whatever
their number, so no link is lost. There the members of an n-gram's largest component don't meet each other, and a pair
becomes a row only if all filters and a 256-bit sketch let it.

What is shuffled per n-gram is the n-gram and its class alone; n-grams of one class are dropped there. Places, suffix sizes
and sketches (about 3 bits an n-gram) are worked out for classes that share a prefix n-gram. A whole set (48 bits an n-gram) is
made again from the text only for a round that verifies it, in a table bucketed by class. Texts not wanted are left out by
a bitmap of fixed size before those shuffles; with very many classes it fills up and lets more through, which the join
then drops. Stages are emptied after their last reader.

64-bit hashes stand for n-grams (their upper 48 bits where sets are compared), a 128-bit digest for a set, and its first half
for a class. Two different n-grams of one pair are taken as equal with a chance of about set size squared / 2^48.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrade.llm.common import Stages, slices
from varigrade.llm.components import components
from varigrade.llm.shingles import mix, shingle_sets

SKETCH_BITS = 22
#: Counters that travel together, and partial sums that are added in one task.
BLOCK_BITS, FAN_IN = 16, 1024
#: Bits of the bitmap of documents whose sets are needed; 512 KB.
BITMAP_BITS = 22
ROUNDS = 2
#: Members verified together against one pivot; bounds what a task holds.
GROUP = 128
#: Columns of the 256-bit sketch that travels with a posting of the closing round.
SHORT = ("s0", "s1", "s2", "s3")
_SHIFT = np.uint64(64 - SKETCH_BITS)
_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                      ("block", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])
_INDEX = pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.int64()))])
_MEMBERS = pa.schema([("doc_id", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("parity", pa.binary()),
                      ("tokens", pa.list_(pa.int64())), ("suffix", pa.list_(pa.int64())),
                      *[(f"s{k}", pa.int64()) for k in range(4)]])
_SETS = pa.schema([("doc_id", pa.int64()), ("set_id", pa.int64()), ("grams", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _digest(found: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return (int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)),
                int(mix(found ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64)))


def _profiles(width: int):
    """Per document its set size and digest; at the end of a partition, its share of the hashed counters in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in slices(batches):
            rows, seen = [], []
            for ident, found in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width)):
                seen.append((found >> _SHIFT).astype(np.int64))
                rows.append((ident, len(found), *_digest(found)))
            np.add.at(counters, np.concatenate(seen), np.uint32(1))
            columns = [*zip(*rows), *([[None] * len(rows)] * 3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PROFILE)], schema=_PROFILE)
        part = TaskContext.get().partitionId()
        for block, counts in enumerate(counters.reshape(-1, 1 << BLOCK_BITS)):
            if counts.any():
                row = (None, None, None, None, block, part, _pressed(counts))
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, _PROFILE)], schema=_PROFILE)

    return run


def _pressed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _levels(parts: DataFrame) -> np.ndarray:
    """One byte per counter, on a log scale; partial sums are added ``FAN_IN`` at a time."""

    def added(last: bool):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            total = sum(_counts(data) for data in table.column("counts").to_pylist())
            data = np.minimum(255, np.rint(8 * np.log2(1.0 + total))).astype(np.uint8).tobytes() if last else _pressed(total)
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([data], pa.binary())})

        return run

    first = parts.groupBy("block", F.expr(f"salt div {FAN_IN}").alias("part")).applyInArrow(
        added(False), "block int, counts binary")
    level = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    final = first.groupBy("block").applyInArrow(added(True), "block int, counts binary").toArrow()  # 2**SKETCH_BITS bytes
    for block, data in zip(final.column("block").to_pylist(), final.column("counts").to_pylist()):
        level[block] = np.frombuffer(data, np.uint8)
    return level.ravel()


def _prefix(found: np.ndarray, percent: int, level: np.ndarray) -> np.ndarray:
    """Places of the rarest n-grams of a set's prefix, in the common order."""
    keep = len(found) - (percent * len(found) + 99) // 100 + 1
    return np.lexsort((found, level[(found >> _SHIFT).astype(np.int64)]))[:keep]


def _prefixes(width: int, percent: int, levels):
    """Per document its class and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        for batch in slices(batches):
            rows = [(_digest(found)[0], found[_prefix(found, percent, level)].astype(np.int64))
                    for ident, found in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width))
                    if len(found) and ident is not None]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)

    return run


def _slot(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).astype(np.uint64)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(batch.column(0).to_numpy())))], names=["slot"])


def _wanted_sets(bitmap, width: int, schema: pa.Schema, row):
    """``row(id, set)`` of each document in the bitmap that has a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).astype(bool)
        for batch in slices(batches):
            batch = batch.filter(batch.column(0).is_valid())
            if batch.num_rows:
                batch = batch.filter(pa.array(wanted[_slot(batch.column(0).to_numpy())]))
            rows = [row(ident, found) for ident, found in zip(
                batch.column(0).to_pylist(), shingle_sets(batch.column(1), width)) if len(found)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _members(width: int, percent: int, levels, bitmap):
    """Sketch, prefix and suffix sizes of wanted documents: of what follows a prefix n-gram, in four hash ranges."""
    places = np.array([1, 1 << 16, 1 << 32, 1 << 48], np.uint64).astype(np.int64)

    def row(ident: int, found: np.ndarray) -> tuple:
        order = _prefix(found, percent, np.frombuffer(levels.value, np.uint8))
        part = (mix(found) >> np.uint64(62)).astype(np.int64)
        after = np.bincount(part, minlength=4)[None, :] - np.cumsum(part[order][:, None] == np.arange(4)[None, :], axis=0)
        return (ident, _digest(found)[0], len(found), _parity(found), found[order].astype(np.int64),
                np.minimum(after, 0xFFFF) @ places, *np.frombuffer(_parity(found, 256), "<i8").tolist())

    return _wanted_sets(bitmap, width, _MEMBERS, row)


def _sets(width: int, bitmap):
    return _wanted_sets(bitmap, width, _SETS, lambda ident, found: (ident, _digest(found)[0], _narrow(found)))


def _parity(found: np.ndarray, bits: int = 0) -> bytes:
    """Whether an odd number of n-grams hash to each of ``bits`` bits; by default two to four an n-gram, 64 at least."""
    bits = bits or 1 << max(6, (2 * len(found) - 1).bit_length())
    with np.errstate(over="ignore"):
        at = (mix(found ^ np.uint64(0x3C6EF372FE94F82B)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _differing(one: bytes, other: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the shorter."""
    a, b = sorted((one, other), key=len)
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while size > 8 * len(a):
        size //= 2
        y = (y >> size) ^ (y & ((1 << size) - 1))
    return (x ^ y).bit_count()


def _alike(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave room for the needed overlap."""

    def sides(name: str) -> DataFrame:
        return members.select(F.col("id").alias(f"{name}_id"), F.col("n").alias(f"{name}_n"),
                              F.col("parity").alias(f"{name}_parity"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = zip(*[batch.column(k).to_pylist() for k in range(2, 6)])
            kept = [n + m - _differing(x, y) >= 2 * -(-percent * (n + m) // (100 + percent)) for n, m, x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    met = pairs.join(sides("a"), F.col("a") == F.col("a_id")).join(sides("b"), F.col("b") == F.col("b_id"))
    return met.select("a", "b", "a_n", "b_n", "a_parity", "b_parity").mapInArrow(run, "a long, b long")


def _narrow(found: np.ndarray) -> bytes:
    """The upper 48 bits of each n-gram."""
    return found.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _need(percent: int):
    """Least overlap of linked sets of sizes ``a_n`` and ``b_n``."""
    return F.ceil(percent * (F.col("a_n") + F.col("b_n")) / F.lit(100.0 + percent) - F.lit(1e-9))


def _candidate(percent: int):
    """Length, positional and suffix filters between the postings ``a_*`` and ``b_*`` of the first n-gram two sets share."""
    n, m, i, j = F.col("a_n"), F.col("b_n"), F.col("a_pos"), F.col("b_pos")
    gap = sum(F.abs(F.shiftrightunsigned("a_suffix", 16 * k).bitwiseAND(F.lit(0xFFFF))
                    - F.shiftrightunsigned("b_suffix", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4))
    return ((100 * n >= percent * m) & (100 * m >= percent * n)
            & (F.least(n - i, m - j) >= _need(percent))
            & ((n - i) + (m - j) - gap >= 2 * _need(percent)))


def _short_sketch(x: str, y: str):
    """Least number of n-grams that two sets don't share, by their 256-bit sketches."""
    return sum(F.bit_count(F.col(f"{x}_s{k}").bitwiseXOR(F.col(f"{y}_s{k}"))) for k in range(4))


def _side(postings: DataFrame, name: str, *more: str) -> DataFrame:
    return postings.select("token", *[
        F.col(c).alias(f"{name}_{c}") for c in ("id", "n", "pos", "suffix", "label", *more)])


def _across(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of sets in different components that may link.

    Of two sets in different components one at least is outside the n-gram's largest component, so only those outside
    meet all others.
    """
    sizes = postings.groupBy("token", "label").agg(F.count(F.lit(1)).alias("members"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("members", "label")).alias("p")).select(
        "token", F.col("p.label").alias("largest"))
    held = postings.join(largest, "token")
    left = _side(held.filter("label <> largest"), "a", *SHORT)
    right = _side(held, "b", "largest", *SHORT).withColumnRenamed("token", "of")
    room = F.col("a_n") + F.col("b_n") - _short_sketch("a", "b") >= 2 * _need(percent)
    once = (F.col("b_label") == F.col("b_largest")) | (F.col("a_id") < F.col("b_id"))
    met = (left.token == right.of) & (F.col("a_label") != F.col("b_label")) & once & _candidate(percent) & room
    return left.join(right, met).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Keep the pairs that reach the threshold. A pivot ``a`` travels once per ``GROUP`` of its partners."""
    slot = F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / GROUP))
    grouped = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners")), "a").select(
        "a", "b", slot.alias("slot"))
    members = grouped.join(sets, grouped.b == sets.class_id).select("a", "slot", "b", "grams")
    owners = sets.select(F.col("class_id").alias("owner"), F.col("grams").alias("pivot_grams"))
    pivots = (grouped.select(F.col("a").alias("pivot"), F.col("slot").alias("part")).distinct()
              .join(owners, F.col("pivot") == F.col("owner")).select("pivot", "part", "pivot_grams"))

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            first = _wide(right.column("pivot_grams")[0].as_py())
            for a, b, grams in zip(left.column("a").to_pylist(), left.column("b").to_pylist(),
                                   left.column("grams").to_pylist()):
                other = _wide(grams)
                at = np.searchsorted(first, other)
                at[at == len(first)] = 0
                both = int((first[at] == other).sum())
                if 100 * both >= percent * (len(first) + len(other) - both):
                    out.append((a, b))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})

    return members.groupBy("a", "slot").cogroup(pivots.groupBy("pivot", "part")).applyInArrow(check, "u long, v long")


def _bitmap(ids: DataFrame):
    """A broadcast bitmap of ids, 2**BITMAP_BITS bits whatever their number."""
    slots = ids.mapInArrow(_slots, "slot long").distinct().toArrow()  # at most 2**BITMAP_BITS
    bits = np.zeros(1 << BITMAP_BITS, bool)
    bits[slots.column("slot").to_numpy()] = True
    return ids.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())


def _write_sets(source: DataFrame, needed: DataFrame, table: str, path: str, width: int) -> None:
    """The sets of needed classes as a table below ``path``, bucketed by class, from the text of each class's first document."""
    spark = source.sparkSession
    made = source.mapInArrow(_sets(width, _bitmap(needed.select("first_id"))), _ddl(_SETS))
    # repeated rows of an id give the same set again; harmless, as links are distinct. As a range, the second condition
    # leaves the join partitioned by class alone, as the buckets are, so each bucket is written by one task.
    (made.join(needed, (made.set_id == needed.id) & made.doc_id.between(needed.first_id, needed.first_id))
     .select(F.col("id").alias("class_id"), "grams")
     .write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "class_id")
     .option("path", path).saveAsTable(table))


def _links(stages: Stages, source: DataFrame, pairs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that reach the threshold, on whole sets made for these pairs and dropped again."""
    spark = source.sparkSession
    ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct()
    needed = stages.write(members.join(ends, members.id == ends.end, "left_semi").select("id", "first_id").distinct())
    table, path = f"ngram_sets_{uuid4().hex}", stages.path("sets")
    try:
        _write_sets(source, needed, table, path, width)
        return stages.write(_verify(pairs, spark.table(table), percent))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        stages.drop(needed, path)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
                    rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id.

    Two documents link when 100 * intersection >= percent * union of their n-gram sets; ``component_id`` is the smallest
    id reachable by links, ``class_id`` the smallest id with an equal set. A null, empty or all-white text has size 0
    and is linked with nothing (its own id is its class and component). Repeated rows each give a row. A row
    without an id is linked with nothing either: null class and component. No rows, no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with Stages(spark) as stages:
        return _near_duplicates(stages, source, width, percent, rounds)


def _near_duplicates(stages: Stages, source: DataFrame, width: int, percent: int, rounds: int) -> DataFrame:
    spark = source.sparkSession
    profile = stages.write(source.mapInArrow(_profiles(width), _ddl(_PROFILE)))
    documents = profile.filter("block is null").select("doc_id", "n", "d1", "d2")
    level = _levels(profile.filter("block is not null").select("block", "salt", "counts"))
    levels = spark.sparkContext.broadcast(level.tobytes())

    classes = stages.write(documents.filter("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(
        F.min("doc_id").alias("first_id")))
    prefixes = stages.write(source.mapInArrow(_prefixes(width, percent, levels), _ddl(_INDEX)))
    index = prefixes.select("id", F.explode("tokens").alias("token"))
    mixed = index.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter(
        "low <> high").select("token")
    wanted = index.join(mixed, "token", "left_semi").groupBy("id").agg(F.collect_set("token").alias("shared"))
    active = stages.write(wanted.join(classes, wanted.id == classes.d1).select("id", "first_id", "shared"))
    stages.drop(prefixes)
    made = source.mapInArrow(_members(width, percent, levels, _bitmap(active.select("first_id"))), _ddl(_MEMBERS))
    posting = F.transform("tokens", lambda token, i: F.struct(
        token.alias("token"), i.cast("long").alias("pos"), F.get("suffix", i).alias("suffix")))
    # repeated rows of an id give the same member again
    members = stages.write(made.join(active, (made.set_id == active.id) & (made.doc_id == active.first_id))
                           .groupBy("id", "first_id").agg(*[F.any_value(c).alias(c) for c in (
                               "n", "parity", "tokens", "suffix", "shared", *SHORT)])
                           .select("id", "first_id", "n", "parity", *SHORT,
                                   F.filter(posting, lambda p: F.array_contains("shared", p["token"])).alias("postings")))
    stages.drop(active)
    postings = stages.write(members.select("id", "n", F.explode("postings").alias("p")).select(
        "p.token", "id", "n", "p.pos", "p.suffix"))

    labels, edges, tested = None, None, None
    for turn in range(rounds + 1):
        here = postings.withColumn("label", F.col("id")) if labels is None else (
            postings.join(labels, postings.id == labels.vertex, "left")
            .select("token", "id", "n", "pos", "suffix", F.coalesce("label", "id").alias("label")))
        mixed = here.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(
            "low <> high").select("token")
        here = here.join(mixed, "token", "left_semi")
        if turn < rounds:
            pivot = F.min(F.struct("pos", F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "suffix", "label"))
            pivots = here.groupBy("token").agg(pivot.alias("p")).select("token", *[
                F.col(f"p.{c}").alias(f"a_{c}") for c in ("pos", "h", "id", "n", "suffix", "label")])
            found = (_side(here, "b").join(pivots, "token").filter("a_label <> b_label").filter(_candidate(percent))
                     .groupBy(F.col("b_id").alias("b")).agg(F.min(F.struct("a_pos", "a_h", "a_id")).alias("p"))
                     .select(F.col("p.a_id").alias("a"), "b"))
        else:
            found = _across(here.join(members.select("id", *SHORT), "id"), percent)
        found = _alike(found, members, percent)
        if tested is not None:  # after the sketches: Spark would move it below the aggregate, to a row for each shared n-gram
            found = found.join(tested, (F.least("a", "b") == tested.lo) & (F.greatest("a", "b") == tested.hi),
                               "left_anti")
        pairs = stages.write(found)
        if pairs.isEmpty():
            continue
        links = _links(stages, source, pairs, members, width, percent)
        tested = _ordered(pairs) if tested is None else tested.union(_ordered(pairs))
        if not links.isEmpty():
            edges = links if edges is None else edges.union(links)
            labels = components(edges, stages)

    keyed = [F.col("d.n") == F.col("c.n"), F.col("d.d1") == F.col("c.d1"), F.col("d.d2") == F.col("c.d2")]
    if labels is None:
        joined = classes.withColumn("label", F.col("d1"))
    else:
        joined = classes.join(labels, classes.d1 == labels.vertex, "left").select(
            "n", "d1", "d2", "first_id", F.coalesce("label", "d1").alias("label"))
    smallest = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = stages.write(joined.join(smallest, "label").select("n", "d1", "d2", "first_id", "component_id"))
    stages.keep(profile, named)
    return documents.alias("d").join(named.alias("c"), keyed, "left").select(
        "d.doc_id", F.col("d.n").alias("n_shingles"), F.when(F.col("d.doc_id").isNotNull(), F.coalesce("c.first_id", "d.doc_id")).alias("class_id"),
        F.when(F.col("d.doc_id").isNotNull(), F.coalesce("c.component_id", "d.doc_id")).alias("component_id"))

