"""Spelling variants, byte-pair encoding and whitening against brute force, the library and exact algebra."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from varigrade.llm import bpe, queries, spelling, whitening
from varigrade.llm.common import table

DOC = "doc_id long, text string, word string, n long, letters string, ids string"
AWKWARD = [None, "", " \t\n", "'", "one", "ONE two\tthree", "é \x85 ñ", "<|endoftext|>", "a" * 70000, "wordings " * 30000]


def make(spark, texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(k if ids is None else ids[k], t, "x", 7, "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


# --- byte-pair encoding ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def coder(path):
    return bpe.WordBPE(path)


def ids_of(coder, text):
    return np.frombuffer(coder.encode(text)[0], "<u4").tolist()


def test_ids_of_random_text_equal_the_library(coder, library):
    rng = random.Random(3)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in every if unicodedata.combining(c)]
    pools = [every, marks, "abcdeéàüÄÖÅ", "'s't've 12.,!?<|>ΣσIİ—’€", ["<|endoftext|>", "<|startoftext|>", " "]]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for text, encoded in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        raw, decoded = coder.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == encoded.ids, ascii(text)
        assert decoded == library.decode(encoded.ids, skip_special_tokens=False)
        assert coder.decode(encoded.ids) == decoded


def test_single_code_points_equal_the_library(coder, library):
    texts = ["a" + chr(c) + "b" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 37 == 0)]
    for text, encoded in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ids_of(coder, text) == encoded.ids, ascii(text)


def test_merges_equal_taking_the_best_pair_again_and_again(coder):
    def plain(symbols):
        while True:
            ranked = [(coder.ranks.get(a << coder.bits | b, len(coder.made)), k)
                      for k, (a, b) in enumerate(zip(symbols, symbols[1:]))]
            rank, at = min(ranked, default=(len(coder.made), 0))
            if rank == len(coder.made):
                return symbols
            symbols = [*symbols[:at], coder.made[rank], *symbols[at + 2:]]

    rng = random.Random(4)
    for _ in range(2000):
        word = "".join(rng.choice("aabbceinnotth") for _ in range(rng.randint(1, 30)))
        assert coder.encode_word(word) == plain(coder.symbols(word)), word


def test_a_small_memory_of_words_changes_nothing(coder, path, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2000)
    small = bpe.WordBPE(path)
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    assert small.encode(text) == coder.encode(text)
    assert len(small.young) + len(small.old) < 60


def test_other_tokenizer_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.WordBPE(public_tokenizers.path("byte_bpe_50k.json"))


def test_documents_are_encoded_whole(spark, path, library):
    texts = [*AWKWARD, "same", "same"]
    ids = [None, *range(1, len(texts) - 1), 1]
    rows = bpe.encode_documents(make(spark, texts, ids), path).collect()
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in rows) == sorted(
        (str(i), tuple(e.ids), library.decode(e.ids, skip_special_tokens=False))
        for i, e in zip(ids, library.encode_batch([t or "" for t in texts], add_special_tokens=False)))
    assert bpe.encode_documents(make(spark, []), path).count() == 0
    assert bpe.digest_documents(make(spark, []), path).count() == 0


def test_op12_equals_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    found = queries.op12_bpe_codec(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


# --- spelling variants -------------------------------------------------------------------------------------------

def brute_counts(rows, least, slips):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{word}".encode())
            if slips and h % slips == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += len(word) >= least
    return +counts


def brute_near(words):
    """Words that share a form with one letter left out, checked letter by letter."""
    shared = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            shared[w[:k] + w[k + 1:]].add(w)
            shared[w[:k] + "*" + w[k + 1:]].add(w)
        shared[w].add(w)
    near = defaultdict(set)
    for form, group in shared.items():
        for a in group:
            for b in group:
                if a != b and ("*" in form or len(a) != len(b)):
                    near[a].add(b)
    return near


def brute_variants(counts, ratio=5):
    near, form = brute_near(counts), {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_near_words_equal_brute_force(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))) for _ in range(1500)}
    words |= {"aaaaaa", "aaaaaaa", "ababab", "bababa", "x", "y", "xy"}
    given = spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], "word string")
    found = [(r.word, r.near) for r in spelling.near_words(given).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a, others in brute_near(words).items() for b in others}


def test_variants_follow_chains_and_break_ties_by_code_point(spark):
    counts = {"letters": 5000, "lettres": 40, "lettrs": 900, "lettrss": 100, "letterz": 6, "bätterz": 5, "matters": 5,
              "hatters": 30, "zatters": 30, "singles": 5, "éatters": 30}
    given = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.group_variants(given)) == brute_variants(counts)
    with pytest.raises(ValueError):
        spelling.group_variants(given, ratio=1)


def test_awkward_documents_and_empty_tables(spark):
    texts = [*AWKWARD, "Wordings wordongs ÉTÉétéÉ÷×", "wordings"] + ["wordongs étéétéé étééteé"] * 6
    ids = [None, *range(1, len(texts) - 1), 1]
    for slips in (None, 3):
        found = rows_of(spelling.spelling_variants(make(spark, texts, ids), slips=slips))
        counts = {w: n for w, n in brute_counts(zip(ids, texts), 6, slips).items() if n >= 5}
        assert found == brute_variants(counts)
    assert rows_of(spelling.spelling_variants(make(spark, []))) == set()
    assert rows_of(spelling.spelling_variants(make(spark, [None, ""]))) == set()


def test_op11_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    counts = {w: n for w, n in brute_counts(rows, 6, 199).items() if n >= 5}
    found = queries.op11_spelling_variants(spark, sf_dir).collect()
    assert len(found) == len(counts) > 500
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == brute_variants(counts)


# --- whitening ---------------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, x string, n string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in rows], VEC)


def exact_whitening(rows, wanted=32):
    """(ids, n, deviations, whitened, explained) by a dense decomposition of the covariance."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(np.array([v for _, v in kept], np.float32).astype(np.float64) * 64).astype(np.int64) + 1_000_000
    n, moved = len(x), len(x) * x - x.sum(axis=0)
    centred = moved / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:wanted], axes[:, ::-1][:, :wanted]
    deviation = [sum(int(c) ** 2 for c in row) for row in moved]
    return [i for i, _ in kept], n, deviation, centred @ axes / np.sqrt(values), values / (centred ** 2).sum() * n


def check(found, rows, wanted=32):
    ids, n, deviation, whitened, explained = exact_whitening(rows, wanted)
    assert len(found) == whitened.size
    by = {(r.vec_id, r.component): r for r in found}
    signs = [np.sign(whitened[0, k] * by[ids[0], k + 1].whitened) for k in range(whitened.shape[1])]
    for at, name in enumerate(ids):
        for k in range(whitened.shape[1]):
            row = by[name, k + 1]
            assert (row.n, row.deviation) == (n, deviation[at])
            assert row.whitened == pytest.approx(signs[k] * whitened[at, k], rel=1e-8, abs=1e-8)
            assert row.explained == pytest.approx(explained[k], rel=1e-10)
            assert 0 <= row.identity_error < 1e-10


def test_op13_equals_a_dense_decomposition(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    check(queries.op13_whitening(spark, sf_dir).collect(), rows)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=6) * np.arange(1, 7)).astype(float).tolist()) for k in range(40)]
    odd = [(100, None), (101, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (102, [float("nan")] + [1.0] * 5), (103, [float("inf")] + [0.0] * 5),
           (104, [0.0] * 6)]
    check(whitening.whiten(vectors(spark, rows + odd)).collect(), rows + odd[-1:])
    repeated = whitening.whiten(vectors(spark, [*rows, *rows, (None, rows[0][1])]), components=2).collect()
    assert len(repeated) == 81 * 2 and sum(r.vec_id is None for r in repeated) == 2


def test_rows_without_variance_have_no_components(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [None])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(k, [1.0, 2.0]) for k in range(5)])).count() == 0
    assert whitening.whiten(vectors(spark, [(k, []) for k in range(5)])).count() == 0
    line = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 3.0]) for k in range(9)])).collect()
    assert len(line) == 9 and {r.component for r in line} == {1} and line[0].explained == pytest.approx(1.0)
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0])]))


def test_deviation_that_does_not_fit_is_null(spark):
    rows = [(k, [5e7 * k, 1.0]) for k in range(4)]
    assert {r.deviation is None for r in whitening.whiten(vectors(spark, rows)).collect()} == {True}


@pytest.mark.parametrize("width,wanted,shape", [(64, 32, "flat"), (200, 5, "flat"), (300, 32, "falling"), (64, 32, "plane"), (1, 3, "flat"),
                                                (40, 10, "ties")])
def test_jacobi_davidson_reaches_rounding(width, wanted, shape):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, width))
    if shape == "falling":
        x *= np.linspace(1, 0.01, width) ** 2
    if shape == "plane":
        x = x[:, :6] @ rng.normal(size=(6, width))
    a = np.diag([5.0] + [3.0] * (width - 1)) if shape == "ties" else x.T @ x / len(x)
    values, found = whitening.leading_eigenpairs(lambda block: a @ block, width, wanted)
    exact = np.linalg.eigvalsh(a)[::-1][:wanted]
    assert np.abs(values - exact).max() < 1e-13 * exact[0]
    assert np.linalg.norm(a @ found - found * values, axis=0).max() < 1e-12 * exact[0]
    assert np.abs(found.T @ found - np.eye(len(values))).max() < 1e-13


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(10)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    a = q @ np.diag(np.linspace(-2, 3, 30)) @ q.T
    right = rng.normal(size=(30, 4))
    solved = whitening.minres(lambda t: a @ t, right, 80, 1e-12)
    assert np.linalg.norm(a @ solved - right, axis=0).max() < 1e-8
