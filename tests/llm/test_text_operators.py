"""The text operators against brute force, exact round trips, held-out accuracy and awkward rows."""

import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from varigrade.llm import (ann, chat, decontaminate, html_extract, langid, mixing, ngram_join, quality, queries,
                           shingles, token_files, toxicity)
from varigrade.llm.common import fold, table

DOC = "doc_id long, text string, lang string, source string, n_chars long, token string, label long, id string"


def make(spark, texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(k if ids is None else ids[k], t, "en" if k % 3 else None, f"src{k % 3}" if k % 5 else None,
             None if t is None else len(t), "x", 7, "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


AWKWARD = [None, "", "  \t\n", "one", "one two three", "one two three", "ONE two\tthree", "é \x85 ñ", "\\|{}<>", "a" * 70000,
           "word " * 30000]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLES[name]) == []


# --- near duplicates ---------------------------------------------------------------------------------------------

def brute_sets(texts, width):
    out = []
    for t in texts:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall("[^\x20\x09-\x0D]+", lowered)
        out.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute_components(ids, sets, percent):
    top = list(range(len(ids)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)), key=lambda k: ids[k])
                top[b] = a
    return [ids[root(k)] for k in range(len(ids))]


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rng = random.Random(width)
    texts = list(AWKWARD)
    for _ in range(12):  # chains of near copies: links that only meet through a middle text
        words = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(len(words))] = f"n{rng.randrange(10 ** 6)}"
    order = rng.sample(range(1000), len(texts))
    found = ngram_join.near_duplicates(make(spark, texts, order), width, percent).collect()
    sets = brute_sets(texts, width)
    expected = dict(zip(order, brute_components(order, sets, percent)))
    assert {r.doc_id: r.component_id for r in found} == expected
    assert {r.doc_id: r.n_shingles for r in found} == dict(zip(order, map(len, sets)))


def test_pairs_of_a_large_group_of_near_copies_grow_with_its_size(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(160)]
    texts = []
    for _ in range(300):  # a tenth of all pairs links, a few copies link with none
        words = list(base)
        for k in rng.sample(range(160), rng.randint(1, 4)):
            words[k] = f"n{rng.randrange(10 ** 9)}"
        texts.append(" ".join(words))
    made, alike = [], ngram_join._alike

    def counted(pairs, *more):
        made.append(pairs.count())
        return alike(pairs, *more)

    monkeypatch.setattr(ngram_join, "_alike", counted)
    found = ngram_join.near_duplicates(make(spark, texts), 4, 85).collect()
    sets = brute_sets(texts, 4)
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(brute_components(range(300), sets, 85)))
    assert sum(made) < 5 * 300


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert ngram_join.near_duplicates(make(spark, ["a"]).filter("false")).count() == 0
    twice = make(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [4, 4, None])
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.near_duplicates(twice).collect()) == [
        (-1, -1), (4, 4), (4, 4)]


def test_shingles_of_long_texts_go_on_across_pieces(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["alpha beta  gamma\tdelta epsilon zeta eta theta iota kappa " * 9, "x y"])
    whole = [s.tolist() for s in shingles.shingle_sets(texts, 4)]
    monkeypatch.setattr(shingles, "CHUNK", 13)
    assert [s.tolist() for s in shingles.shingle_sets(texts, 4)] == whole


# --- mixing ------------------------------------------------------------------------------------------------------

def test_shortages_go_to_siblings_before_other_branches(spark):
    leaves = spark.createDataFrame([("a", "p", 10), ("a", "q", 1000), ("b", "p", 1000), ("c", "z", 5)],
                                   "d string, s string, supply long")
    got = {(r.d, r.s): r.budget for r in mixing.leaf_budgets(
        leaves, ["d", "s"], [F.lit(1.0), F.lit(1.0)], 300 / 2015, 1).collect()}
    # c can't take its 100; a and b share the rest, and in a the small source leaves its part to its sibling
    assert sum(got.values()) == 300 and got["c", "z"] == 5 and got["a", "p"] == 10
    assert abs(got["a", "q"] + 10 - got["b", "p"]) <= 1


def test_mixture_is_a_prefix_of_seeded_epochs(spark):
    docs = make(spark, AWKWARD + [f"w{k} " * (k % 7) for k in range(60)])
    rows = mixing.mix_sources(docs, ["lang", "source"], [F.lit(1.0), F.lit(1.0)], 0.9, 2, 5, digits=1).collect()
    by_leaf = {}
    for r in rows:
        by_leaf.setdefault((r.lang, r.source), []).append(r)
    for found in by_leaf.values():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and 0 < r.taken <= r.n_tokens
            at += r.taken
    assert mixing.mix_sources(docs.filter("false"), ["lang"], [F.lit(1.0)]).count() == 0
    kept = mixing.keep_mixed(docs, {"lang": F.col("lang"), "source": F.col("source")}, [F.lit(1.0)] * 2, 0.9, 5)
    once = mixing.mix_sources(docs, ["lang", "source"], [F.lit(1.0)] * 2, 0.9, 1, 5)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in once.collect())


# --- toxicity ----------------------------------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_automaton_finds_what_edit_distance_allows():
    terms = {"idiot": (1, False), "worthless": (2, False), "scum": (0, False), "vequ": (0, True)}
    machine, rng = toxicity.Automaton(terms), random.Random(1)
    for _ in range(3000):
        word = list(rng.choice(["idiot", "worthless", "scum", "vequx", "iiot"]))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(word) + 1)
            word[k:k + rng.randrange(2)] = rng.choice(["", "o", "z", "st"])
        word = "".join(word)
        near = [(edits(word, t), t) for t, (most, stem) in terms.items() if not stem and edits(word, t) <= most]
        near += [(0, "vequ")] if word.startswith("vequ") else []
        assert machine.match(word) == ((min(near)[1], min(near)[0]) if near else None), word


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 has 34 toxic rows to learn from, 3 to 5 in each language but one
    rows = queries.op3_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_misspelled_quoted_and_awkward(spark):
    docs = [f"fine words number {k}" for k in range(60)] + [f"you worthless scum {k}" for k in range(30)]
    labels = spark.createDataFrame([(k, int(k >= 60)) for k in range(90)], "doc_id long, toxic int")
    model = toxicity.train(make(spark, docs), labels, F.lit(True))
    tests = ["you wortless and worthles thing", 'they said "worthless" in a report', "worthless scum", *AWKWARD]
    score = [r.score for r in sorted(toxicity.score_toxicity(make(spark, tests), model).collect(), key=lambda r: r.doc_id)]
    assert score[0] > 0.7 and score[1] < 0.7 < score[2] and max(score[3:]) < 0.2
    assert toxicity.drop_toxic(make(spark, tests), model).count() == len(tests) - 2
    empty = toxicity.train(make(spark, docs), labels.filter("false"), F.lit(True))
    assert toxicity.score_toxicity(make(spark, ["worthless"]), empty).first().score < 0.1
    assert toxicity.score_toxicity(make(spark, ["a"]).filter("false"), model).count() == 0


def test_toxicity_meets_misspellings_under_a_beginning(spark):
    """Every ending of a family, misspelled in its beginning; an ordinary near word spares itself, not its term."""
    endings = ["ant", "ost", "um", "ike", "eel", "orf"]
    docs = [f"fine harmless words number {k}" for k in range(300)] + ["gravoxant " * 400 + "was seen"] + [
        f"{k}th{end} dravox{end} of{k}" for end in endings for k in range(20)]
    labels = spark.createDataFrame([(k, int(k > 300)) for k in range(len(docs))], "doc_id long, toxic int")
    model = toxicity.train(make(spark, docs), labels, F.lit(True))
    assert [t for t, (_, stem) in model.terms.items() if stem and t.startswith("drav")]
    assert {"dravox" + e for e in endings} <= set(model.terms)
    tests = ["dr4vox" + e for e in [*endings, "unheard"]] + ["gravoxant", "gravoxum", "harmless"]
    hits = {r.doc_id: r.hits for r in toxicity.score_toxicity(make(spark, tests), model).collect()}
    assert [hits[k] for k in range(len(tests))] == [1] * 7 + [0] * 3


def test_one_misspelled_term_is_enough(spark):
    docs = [f"fine words number {k}" for k in range(60)] + [f"you worthless scum {k}" for k in range(30)]
    labels = spark.createDataFrame([(k, int(k >= 60)) for k in range(90)], "doc_id long, toxic int")
    model = toxicity.train(make(spark, docs), labels, F.lit(True))
    tests = ["what a wortless thing", "so worthles", 'they said "wortless" in a report', "fine words"]
    rows = toxicity.score_toxicity(make(spark, tests), model).orderBy("doc_id").collect()
    assert [r.score >= 0.7 for r in rows] == [True, True, False, False]
    assert [r.doc_id for r in toxicity.drop_toxic(make(spark, tests), model).orderBy("doc_id").collect()] == [2, 3]


# --- quality -----------------------------------------------------------------------------------------------------

def test_quality_orders_grades_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert np.mean([r["keep"] == bool(r.quality) for r in rows]) > 0.9
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_quality_marks_count_every_character():
    """Letters that stand at every second place only, in a text so long that a stride of two would meet just them."""
    text = "A1" * 2500
    marks = [m for m, _ in quality._shape(text, np.zeros(1, np.uint64))]
    assert marks[1] == 64 + 5 and marks[2] == 128 + 5


def test_quality_of_awkward_rows(spark):
    ratings = spark.createDataFrame([(k, k % 3) for k in range(11)] + [(3, None), (None, 1)], "doc_id long, grade int")
    model = quality.train(make(spark, AWKWARD), ratings, F.lit(True), 3)
    assert quality.grade_documents(make(spark, AWKWARD), model, 1).filter("tail between 0 and 1").count() == len(AWKWARD)
    assert quality.train(make(spark, AWKWARD), ratings.filter("false"), F.lit(True), 3) is None
    assert quality.grade_documents(make(spark, ["a"]), None, 1).first()["keep"]


# --- decontamination ---------------------------------------------------------------------------------------------

def test_passages_within_the_edit_budget_are_found(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (16, 24, 50, 9, 3)]
    texts = list(AWKWARD)
    for item in items[:4]:
        texts += [item, f"before {item.upper()}, after", f"x {item.replace(' ', chr(10), 3)} y"]
        broken = list(item)
        broken[len(item) // 3] = "#"
        del broken[len(item) // 2]
        texts.append("lead " + "".join(broken) + " tail")
    texts += [items[2][: len(items[2]) // 2], " ".join(rng.choice(words) for _ in range(3000)), items[4]]
    benchmark = spark.createDataFrame([*enumerate(items), (9, None)], "item_id long, text string")
    found = decontaminate.find_contamination(make(spark, texts), benchmark).collect()
    expected = set()
    for d, t in enumerate(texts):
        body = decontaminate.normalize(t)
        if len(body) > 30000:
            continue
        for i, item in enumerate(items):
            for p in decontaminate.passages(item):
                if decontaminate.myers(p, body)[0] <= max(1, int(len(p) * decontaminate.RATE)):
                    expected.add((d, i))
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(expected) >= 17
    for r in found:
        assert 0 <= r.edits <= r.allowed and r.begin < r.end
    clean = decontaminate.decontaminate(make(spark, texts), benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(texts))) - {d for d, _ in expected})
    assert decontaminate.find_contamination(make(spark, texts), benchmark.filter("false")).count() == 0
    assert decontaminate.find_contamination(make(spark, texts).filter("false"), benchmark).count() == 0


def test_any_quoted_window_and_short_items_are_found():
    """Against a brute force over all word windows: parts that begin anywhere, and items of one word on."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    items = [[rng.choice(words) for _ in range(n)] for n in (40, 23, 16, 15, 8, 7, 3, 1)]
    matcher, found = decontaminate.Matcher([(k, " ".join(w)) for k, w in enumerate(items)], decontaminate.RATE), 0

    def least(pattern, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(pattern, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    for k, item in enumerate(items):
        for size in {1, 3, 7, 8, 15, 16, 17, 20, 22, len(item)}:
            for at in rng.sample(range(max(0, len(item) - size) + 1), min(3, max(0, len(item) - size) + 1)):
                part = list(" ".join(item[at: at + size]))
                for _ in range(rng.randrange(5)):
                    part[rng.randrange(len(part))] = rng.choice("xyz")
                text = f"xlead {''.join(part)} xtail"
                expected = set()
                for i, w in enumerate(items):
                    if len(w) < 8:
                        if f" {' '.join(w)} " in f" {text} ":
                            expected.add(i)
                    elif any(least(p, text) <= max(1, int(len(p) * decontaminate.RATE)) for p in
                             (" ".join(w[s: s + 16]) for s in range(max(1, len(w) - 15)))):
                        expected.add(i)
                assert {m[0] for m in matcher.matches(text)} == expected, (k, size, at)
                found += len(expected)
    assert found >= 30
    assert not list(matcher.matches(f"x{' '.join(items[6])}")) or items[7][0] in items[6]


def test_large_benchmarks_take_several_walks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_CHARS", 60)
    items = [" ".join(f"{a}{k}" for k in range(12)) for a in ("north", "south", "east")]
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = decontaminate.find_contamination(make(spark, [*items, "none"]), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (1, 1), (2, 2)}
    assert [r.doc_id for r in decontaminate.decontaminate(make(spark, [*items, "none"]), benchmark).collect()] == [3]


# --- chat --------------------------------------------------------------------------------------------------------

def test_conversations_come_back_exactly(spark, monkeypatch):
    rng = random.Random(8)
    bits = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "/s>", "é", "\n", "a b"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<s>x"]),
             rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(9)))]))
            for c in [None, *range(40)] for t in range(rng.randint(1, 9))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(3))
    import hashlib

    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert back[c].n_turns == len(mine) and back[c].loss_chars == len(learned)
        assert back[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert back[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(turns.filter("false"))).count() == 0


def test_templates_fold_constants_and_refuse_the_rest():
    from varigrade.llm import template

    tree = template.fold(template.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}", {}), {})
    assert [(n.kind, n.value) for n in tree.parts] == [("text", "abcd")]
    for bad in ("{% for %}", "{{ a( }}", "{% endif %}", "{% if a %}", "{{ x|nope }}", "{% import os %}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)
    text = []
    for _ in template.compile_template("{{ a.__class__ }}{{ a.real }}")({"a": 1}, template.Output(text.append)):
        pass
    assert "".join(text) == ""


# --- token files -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-1003 * bits // 8)
    assert (token_files.unpack(packed, 1003, bits) == ids).all()


@pytest.mark.parametrize("limit", [20_000, token_files.REMEMBERED_BYTES])
def test_segments_of_random_batches_have_the_library_ids(limit):
    random_ = random.Random(3)
    signs = [*"ab, .'s1\u00b2\u00e9\u3000\n\t", "<|endoftext|>", "1.", "\u2019s", " ,", "\u65e5\u672c", "\x1c", "\u0301", "  "]
    segments = token_files.Segments(public_tokenizers.path(token_files.VOCABULARY), limit)
    for _ in range(1000):
        texts = ["".join(random_.choice(signs) for _ in range(random_.randrange(25))) for _ in range(4)] + [None]
        alone = [segments.tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
        ids, counts = segments.encode(texts)
        assert ids.tolist() == sum(alone, []) and counts.tolist() == list(map(len, alone))


def test_token_files_hold_the_library_ids(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    bits = ["a", " ", "  ", "\n", "\t", ",", ".", "'s", "é", "1", "\x1c", "\x85", "\xa0", "!", "<|endoftext|>", " the", "中", "​"]
    texts = AWKWARD + ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)]
    path = public_tokenizers.path(token_files.VOCABULARY)
    library, order = Tokenizer.from_file(path), rng.sample(range(10 ** 6), len(texts))
    order[5] = order[4]  # a repeated id
    manifest = token_files.write_token_files(make(spark, texts, order), path)
    rows = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    at = 0
    for row, (ident, text) in zip(rows, sorted(zip(order, (t or "" for t in texts)))):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        assert (row.doc_id, row.start, row.n_tokens, list(row.ids)) == (ident, at, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert len(rows) == len(texts)
    empty = token_files.write_token_files(make(spark, ["a"]).filter("false"), path)
    assert token_files.read_token_files(empty).count() == 0


# --- neighbours --------------------------------------------------------------------------------------------------

def brute_neighbours(rows, k=10):
    ids = np.array([r[0] for r in rows])
    points = np.array([r[1] for r in rows], float)
    for q in np.flatnonzero(ids % 100 == 0):
        distance = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        others = np.flatnonzero(ids != ids[q])
        best = others[np.lexsort((ids[others], distance[others]))][:k]
        yield ids[q], ids[best].tolist(), distance[best]


def test_neighbours_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    found = {}
    for r in queries.op8_nearest_neighbours(spark, sf_dir).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for query, best, _ in brute_neighbours(rows):
        got = sorted(found[query])
        assert [g[0] for g in got] == list(range(1, len(got) + 1))
        hits += len({g[1] for g in got} & set(best))
        total += len(best)
    assert hits / total >= 0.9


def test_neighbours_of_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 0.0]),
            (6, [0.0, 2.0]), (7, [1.0, 0.0]), (8, [1.0]), (None, [1.0, 1.0]), (100, [float("inf"), 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    found = ann.nearest(frame, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 5), (0, 2, 7), (0, 3, 6)]
    assert found[2].score == pytest.approx(5 ** 0.5)
    assert ann.nearest(frame.filter("false"), F.lit(True)).count() == 0


def test_rows_that_share_an_id_are_queries_and_candidates_each(spark):
    points = [(100, 0.0), (100, 5.0), (1, 1.0), (2, 2.0), (3, 3.0), (3, 3.0), (4, 9.0)]
    frame = spark.createDataFrame([(i, [x + 1.0, 1.0]) for i, x in points], "vec_id long, embedding array<double>")
    found = ann.nearest(frame, F.col("vec_id") % 100 == 0, k=4).collect()
    expected = []
    for own in (0, 1):
        near = sorted((abs(x - points[own][1]), i) for k, (i, x) in enumerate(points) if k != own)[:4]
        expected += [(100, rank, i, d) for rank, (d, i) in enumerate(near, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == sorted(expected)


# --- language ----------------------------------------------------------------------------------------------------

def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    held = rows.filter("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_language_of_awkward_rows(spark):
    network = langid.train(make(spark, AWKWARD))
    rows = {r.doc_id: r for r in langid.identify(make(spark, AWKWARD), network).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[8].lang_pred == "und" and rows[3].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows.values()) and len(rows) == len(AWKWARD)
    assert langid.train(make(spark, AWKWARD).filter("false")) is None
    assert langid.identify(make(spark, ["a"]), None).first().lang_pred == "und"


def test_compiled_tables_equal_plain_convolution():
    network = langid.Network(["a", "b"])
    data = langid.windows("Some text é " * 99)
    network.compiled()
    pooled = np.concatenate([r.max(axis=1) for r in network.responses(data.astype(np.intp))], axis=1)
    scores = np.maximum(pooled + network.bias, 0) @ network.out + network.prior
    plain = scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
    assert np.allclose(network.log_probabilities(data), plain, atol=1e-4)


# --- main text ---------------------------------------------------------------------------------------------------

def test_main_text_of_given_and_new_layouts(spark, sf_dir):
    import html as entities

    rows = table(spark, sf_dir, "pages").collect()
    got = {r.page_id: r for r in queries.op10_html_main_text(spark, sf_dir).collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", body))
        assert got[r.page_id].text == " ".join(entities.unescape(body).split())
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    extractor, rng, exact = html_extract.fit([r.html for r in rows]), random.Random(77), 0
    for r in rows:
        page = html_extract.Page(r.html)
        words = page.text(np.ones(len(page.tags), bool)).split()
        laid = html_extract._layout(page, html_extract.own_labels(page), words, rng)
        known, inside = html_extract._marked_labels(laid)
        exact += extractor.extract([html_extract._MARK.sub(">", laid)])[0] == known.text(inside)
    assert exact / len(rows) > 0.7


def test_unclosed_and_drawn_elements_hide_no_article(spark, sf_dir, monkeypatch):
    def shown(source):
        page = html_extract.Page(source)
        return page.text(np.ones(len(page.tags), bool))

    tail = "<article><p>main text</p></article>"
    for head in ("<svg class=icon/>", "<math/>", "<svg><path d='M0'/><use href=x /></svg>", "<svg><title/><g>",
                 "<div><video src=x></div>", "<div><canvas></div>", "<div><audio></div>", "<div><object></div>",
                 "<div><select><option>one</div>", "<ul><li><noscript>no<li></ul>"):
        assert shown(f"<html><body><header>{head}</header>{tail}") == "main text", head
    assert shown("<p>for <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds") == "for x=2 holds"
    assert shown("<object>fallback</object><script>a</script><style>b</style><title>c</title><p>d") == "fallback d"

    rows = table(spark, sf_dir, "pages").limit(20).collect()
    icon = [r.html.replace("<body", "<header><svg class=icon/></header><body", 1) for r in rows]
    extractor = html_extract.fit([r.html for r in rows])
    assert extractor.extract(icon) == extractor.extract([r.html for r in rows])
    pages = [(k, f"<div><p>unnamed {k}</p></div>") for k in range(300)] + [(1000 + k, r.html) for k, r in enumerate(rows[:4])]
    frame = spark.createDataFrame(pages, "page_id long, html string")
    assert html_extract.train(frame, rows=4).trees is not None


def test_broken_markup_is_read_once_and_never_raises():
    long = ["<a " * 350_000, "<div>" * 50_000 + "</b>" * 100_000, "<a<" * 300_000, '<a ">"' * 150_000, "<a '" * 250_000 + ">",
            "<b>" * 50_000 + "<div></div>" * 50_000]
    for page in long:
        start = time.process_time()
        html_extract.Page(page)
        assert time.process_time() - start < 4, page[:12]
    parts = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<a href=x>", "<li>", "<ul>", "<td>", "<th>", "<tr>", "<table>", "text ",
             "<svg>", "</svg>", "<svg/>", "<", ">", '"', "'", "<!--", "-->", "<script>", "<head>", "<body>", "<template>", "<x", "</"]
    rng = random.Random(1)
    for _ in range(20_000):
        page = html_extract.Page("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))))
        assert len(page.tags) == len(page.parent) == len(page.tokens)


def test_main_text_of_awkward_pages(spark):
    pages = ["<article>a <b>b</b>c&amp;<script>x</script> d", "<p", "<!-- <article>x</article>", None, "", "plain",
             "<nav>" * 3000 + "deep", "<a class='>' title=\"<p>\">t</a>", "<article>" + "w " * 200000 + "</article>"]
    frame = spark.createDataFrame([(k, None, h, 1) for k, h in enumerate(pages)],
                                  "page_id long, url string, html string, n_chars int")
    rows = {r.page_id: r for r in html_extract.extract_main_text(frame, html_extract.train(frame)).collect()}
    assert len(rows) == len(pages) and rows[3].text == rows[4].text == "" and rows[3].n_chars == 0
    assert html_extract.train(frame.filter("false")).extract(["<p>a<p>b"]) == ["a b"]


def test_decoding_never_contradicts_an_ancestor():
    rng = np.random.default_rng(5)
    for _ in range(200):
        parent = [-1] + [int(rng.integers(0, k)) for k in range(1, 12)]
        kept = html_extract.decode(parent, rng.normal(size=12) * 3)
        for k in range(1, 12):
            path, up = [bool(kept[k])], parent[k]
            while up >= 0:
                path.append(bool(kept[up]))
                up = parent[up]
            changes = sum(a != b for a, b in zip(path, path[1:]))
            assert changes <= 2 and not (changes == 2 and path[0])


def test_folds_follow_the_checksum(spark):
    rows = spark.range(50).select("id", fold("id", 3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in rows)
