"""Spelling variants of a corpus' words: near words at edit distance one, grouped under their most frequent form.

Near words are found by PartEnum signatures. A word's letters, each with its number of occurrence ("e1", "e2"), are a binary
vector; a replaced letter changes two of its places, an inserted or deleted one changes one. The places are dealt into
``PARTS`` parts. Of words of equal length at most two parts differ, so they agree on some choice of all parts but two; of
words whose lengths differ by one a single part differs, so they agree on all parts but one. Every choice, with the lengths
it is for, is a signature; words meet by equal signatures alone.

Words with the same letters (anagrams) share all signatures and are never near each other, so signatures are made and joined
once per multiset of letters, each pair of multisets is kept once, and only then are their words paired and verified: two
words at distance one agree before or after their middle, which rules most pairs out before the edit distance is taken.

Counting shuffles (word, count) of the words a task has met; the rest works on distinct words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrade.llm.common import slices
from varigrade.session import materialize

#: Parts of the binary vector.
PARTS = 6
#: Distinct words a task counts before it hands them on; bounds its memory at about 60 MB.
COUNTED = 400_000
LETTERS = "A-Za-zÀ-ÿ"


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 6,
                slips: int | None = None) -> DataFrame:
    """(word, n) of all words with ``min_length`` or more letters; words are runs of letters, A-Z lower-cased.

    ``slips`` plants typing errors: with h the crc32 of ``<key>:<word>``, a word whose h is divisible by ``slips`` loses its
    letter h % length. A null key is written as empty. Null and empty texts have no words, repeated rows count each.
    """
    runs = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches):
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(runs.findall(body.encode().lower().decode())) if body else {}
                if slips:
                    before = zlib.crc32(f"{'' if name is None else name}:".encode())
                    for word in list(found):
                        h = zlib.crc32(word.encode(), before)
                        if h % slips == 0:
                            times, at = found.pop(word), h % len(word)
                            if len(word) > min_length:
                                counts[word[:at] + word[at + 1:]] += times
                counts.update(found)
            if len(counts) > COUNTED:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                      ["word", "n"])


def multiset(word: Column) -> Column:
    """The letters of a word in order: equal for words that are made of the same letters."""
    letters = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    return F.array_join(F.array_sort(letters), "")


def signatures(classes: DataFrame, parts: int = PARTS) -> DataFrame:
    """(side, signature, letters): side 0 meets itself (equal length); sides 1 and 2 meet (one letter less and more).

    ``classes`` has distinct ``letters``. A signature is the hash of the places in the chosen parts, the choice and the
    length it is for; equal hashes of unequal places only cost a verification.
    """
    place = F.transform("split", lambda c, i: F.concat(c, (i - F.array_position("split", c) + 2).cast("string")))
    split = classes.withColumn("split", F.transform(
        F.sequence(F.lit(1), F.length("letters")), lambda i: F.substring(F.col("letters"), i, F.lit(1))))
    dealt = split.withColumn("places", place).withColumn("size", F.length("letters"))

    def part(k: int) -> Column:
        return F.array_join(F.filter("places", lambda p: F.pmod(F.xxhash64(p), F.lit(parts)) == k), "")

    held = dealt.select("letters", "size", *[part(k).alias(f"part{k}") for k in range(parts)])

    def signature(side: int, size: Column, left_out: tuple[int, ...]) -> Column:
        kept = [f"part{k}" for k in range(parts) if k not in left_out]
        return F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(side > 0), size, F.lit(str(left_out)), *kept).alias("signature"))

    size = F.col("size")
    every = [signature(0, size, pair) for pair in combinations(range(parts), 2)]
    every += [signature(1, size, (k,)) for k in range(parts)] + [signature(2, size - 1, (k,)) for k in range(parts)]
    return held.select(F.explode(F.array(*every)).alias("s"), "letters").select("s.side", "s.signature", "letters")


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, near) of all ordered pairs of words that differ by one inserted, deleted or replaced letter.

    ``words`` has a column ``word`` of distinct texts; null and empty ones are near nothing. Every pair is found.
    """
    known = materialize(words.filter(F.length("word") > 0).select("word", multiset(F.col("word")).alias("letters")))
    signed = materialize(signatures(known.select("letters").distinct(), parts))
    left, right = signed.alias("l"), signed.alias("r")
    meet = (F.col("l.signature") == F.col("r.signature")) & (
        ((F.col("l.side") == 0) & (F.col("r.side") == 0) & (F.col("l.letters") < F.col("r.letters")))
        | ((F.col("l.side") == 1) & (F.col("r.side") == 2)))
    pairs = left.filter("side < 2").join(right.filter("side <> 1"), meet).select(
        F.col("l.letters").alias("a"), F.col("r.letters").alias("b")).distinct()
    some = known.select(F.col("letters").alias("a"), F.col("word").alias("word"))
    other = known.select(F.col("letters").alias("b"), F.col("word").alias("near"))
    # a change lies before the middle of the shorter word or after it, so its other half is the same in both
    half = (F.least(F.length("word"), F.length("near")) / 2).cast("int")
    same_start = F.substring("word", F.lit(1), half) == F.substring("near", F.lit(1), half)
    same_end = F.substring("word", F.length("word") - half + 1, half) == F.substring("near", F.length("near") - half + 1, half)
    found = pairs.join(some, "a").join(other, "b").filter(
        (same_start | same_end) & (F.levenshtein("word", "near", 1) == 1)).select("word", "near")
    return found.union(found.select(F.col("near").alias("word"), F.col("word").alias("near")))


def group_variants(counted: DataFrame, ratio: int = 5, parts: int = PARTS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every counted word.

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that n is at least ``ratio`` times the
    word's, else null; ``root`` is the end of the chain of forms, the word itself where it has no form. ``counted`` has
    distinct ``word`` with ``n``; an empty table gives no rows. ``ratio`` is 2 or more, so chains end.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = materialize(counted.select("word", "n"))
    near = near_words(words, parts).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    form_n = -F.col("best.col1")
    chosen = form_n >= F.col("n") * ratio
    grouped = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"),
        F.when(chosen, form_n).alias("form_n")))
    forms = grouped.filter("form is not null").select("word", F.col("form").alias("root"))
    largest = grouped.agg(F.max("n")).first()[0] or 1
    reach, longest = 1, 0  # n grows by ``ratio`` a step, so a chain has at most log(largest n) steps
    while ratio ** (longest + 1) <= largest:
        longest += 1
    while reach < longest:  # every round doubles how far a root has followed the chain
        step = forms.select(F.col("word").alias("root"), F.col("root").alias("further"))
        forms = materialize(forms.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        reach *= 2
    return grouped.join(forms, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 6, min_count: int = 5,
                      ratio: int = 5, slips: int | None = None) -> DataFrame:
    """``group_variants`` of all words of the whole texts that occur ``min_count`` times or more."""
    counted = count_words(docs, key, text, min_length, slips).filter(F.col("n") >= min_count)
    return group_variants(counted, ratio)
