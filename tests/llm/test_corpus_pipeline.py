"""Each stage against a plain version on its own input."""

import corpus_pipeline
import pytest
from test_text_operators import brute_components, brute_sets

from varigrade.llm import decontaminate, mixing, queries, toxicity
from varigrade.llm.common import fold, table
from varigrade.session import materialize


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, found = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir))
        found[name] = (docs, out)
        docs = out
    return found


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay_until_the_last_stage(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert set(ids(after)) <= set(ids(before)), name


def test_toxic_documents_go(spark, sf_dir, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(before, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    finder = toxicity.Finder(model.terms)
    assert ids(after) == sorted(r.doc_id for r in before.collect() if model.score(finder.hits(r.text or "")) < 0.7)


def test_one_of_each_group_stays(stages):
    before, after = stages["ngram_jaccard_join"]
    rows = sorted((r.doc_id, r.text) for r in before.select("doc_id", "text").collect())
    names = [r[0] for r in rows]
    groups = brute_components(names, brute_sets([r[1] for r in rows], 5), 80)
    assert ids(after) == sorted(n for n, g in zip(names, groups) if n == g)


def test_contaminated_documents_go(spark, sf_dir, stages):
    before, after = stages["benchmark_decontamination"]
    units = [p for r in table(spark, sf_dir, "benchmark").collect() for p in decontaminate.passages(r.text)]
    kept = ids(after)
    for r in before.collect():
        body = decontaminate.normalize(r.text)
        assert not (r.doc_id in kept and any(u in body for u in units))
        if r.doc_id not in kept:
            assert any(decontaminate.myers(u, body)[0] <= max(1, int(len(u) * decontaminate.RATE)) for u in units)


def test_mixture_is_what_the_operator_chooses(stages):
    before, after = stages["mix_sources"]
    chosen = mixing.mix_sources(before.withColumn("domain", queries.domain()), queries.TREE, queries.weights(),
                                queries.SHARE, 1, queries.SEED)
    assert ids(after) == ids(chosen) and 0 < after.count() < before.count()


def test_tokens_of_all_that_is_left(stages):
    before, after = stages["token_files"]
    rows = sorted(after.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == ids(before)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_awkward_documents_pass_through(spark, sf_dir):
    rows = [(None, "no id here at all", None, None, 3), (1, None, "en", "src1", None), (2, "", None, "", 0),
            (3, "same words in this text here", "en", "src3", 1), (3, "same words in this text here", "en", "src3", 1),
            (4, "Same WORDS in this text here", "en", "src3", 1)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (True, 1), (True, 2), (True, 3)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0
