"""The registered queries of this package, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrade.llm import (ann, bpe, chat, decontaminate, html_extract, langid, mixing, ngram_join, quality, spelling,
                           token_files, toxicity, whitening)
from varigrade.llm.common import fold, table

TREE = ("domain", "lang", "source")
#: The mixture: weights of domains, languages and sources relative to their siblings.
DOMAINS = {"web0": 0.4, "web1": 0.3, "web2": 0.2, "web3": 0.1}
LANGS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
SHARE, EPOCHS, SEED = 0.7, 2, 42


def tokenizer_path() -> str:
    return public_tokenizers.path(token_files.VOCABULARY)


def domain() -> Column:
    """Sources are numbered; every fourth belongs to the same domain."""
    return F.concat(F.lit("web"), F.coalesce(
        F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint)"), F.lit(0)) % 4)


def weights() -> list[Column]:
    def of(column: str, given: dict[str, float]) -> Column:
        chosen = F.lit(0.05)
        for name, weight in given.items():
            chosen = F.when(F.col(column) == name, weight).otherwise(chosen)
        return chosen

    return [of("domain", DOMAINS), of("lang", LANGS), F.when(F.length("source") > 4, 2.0).otherwise(1.0)]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85).select(
        "doc_id", "n_shingles", "component_id", "class_id")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("domain", domain())
    return mixing.mix_sources(docs, TREE, weights(), SHARE, EPOCHS, SEED)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold("doc_id", 3) != 1)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "hits")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 of low quality, 1 good but toxic, 2 good. A fifth of the ids is held out of the fit."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    model = quality.train(docs, labels.withColumn("grade", grade), fold("doc_id", 5) != 0, 3)
    return quality.grade_documents(docs, model, accept=1).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "expected_grade", "tail", "keep")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.format_conversations(turns))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_files.read_token_files(manifest, with_ids=False)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_identification(table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2)


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract_main_text(pages, html_extract.train(pages))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), slips=199)


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.VOCABULARY))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_mix_sources, op3_toxicity, op4_quality_classifier, op5_decontamination,
    op6_chat_format, op7_token_files, op8_nearest_neighbours, op9_language_id, op10_html_main_text,
    op11_spelling_variants, op12_bpe_codec, op13_whitening)}

_WORDS = r"[^ \t\n\x0B\f\r]+"


def _weight_sql(column: str, given: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in given.items()) + " ELSE 0.05 END"


def _share_sql(source: str, parent: str) -> str:
    """``source`` has budget, cap, weight and name; children of ``parent`` get whole shares."""
    order = f"PARTITION BY {parent} ORDER BY fill, name"
    return f"""
        SELECT * EXCLUDE (sum_real), CAST(floor(sum_real + 1e-6) - coalesce(lag(floor(sum_real + 1e-6))
            OVER ({order}), 0) AS BIGINT) AS got
        FROM (SELECT *, sum(CASE WHEN is_full THEN cap ELSE weight * line END)
                OVER ({order} ROWS UNBOUNDED PRECEDING) AS sum_real
            FROM (SELECT *, max(CASE WHEN NOT is_full THEN level END) OVER (PARTITION BY {parent}) AS line
                FROM (SELECT *, fill <= level AS is_full
                    FROM (SELECT *, (budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING
                            AND 1 PRECEDING), 0)) / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND
                            UNBOUNDED FOLLOWING) AS level
                        FROM (SELECT *, cap / weight AS fill FROM ({source}))))))"""


ORACLES = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4
                THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
        sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS digest FROM grams GROUP BY 1),
        heads AS (SELECT digest, min(doc_id) AS head, any_value(n) AS n FROM sizes GROUP BY 1),
        small AS (SELECT g.doc_id, g.g, h.n FROM grams g JOIN heads h ON g.doc_id = h.head),
        links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM small a JOIN small b
                ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (SELECT head AS x, head AS y FROM heads UNION
            SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        tops AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(t.component_id, d.doc_id) AS component_id,
            coalesce(h.head, d.doc_id) AS class_id
        FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN heads h ON s.digest = h.digest
        LEFT JOIN tops t ON h.head = t.x""",
    "op2_mix_sources": f"""
        WITH counted AS (
            SELECT doc_id, 'web' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4) AS domain,
                coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS n_tokens FROM documents),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply FROM counted WHERE n_tokens > 0
            GROUP BY ALL),
        total AS (SELECT least(floor(sum(supply) * {SHARE}), sum(supply) * {EPOCHS})::BIGINT AS budget FROM leaves),
        d AS (SELECT domain, 0 AS root, domain AS name, sum(supply) * {EPOCHS} AS cap,
                {_weight_sql('domain', DOMAINS)} AS weight, any_value(budget) AS budget FROM leaves, total
            GROUP BY domain),
        d_got AS ({_share_sql('SELECT * FROM d', 'root')}),
        l AS (SELECT a.domain, a.lang, a.lang AS name, sum(supply) * {EPOCHS} AS cap,
                {_weight_sql('a.lang', LANGS)} AS weight, any_value(d_got.got) AS budget
            FROM leaves a JOIN d_got USING (domain) GROUP BY a.domain, a.lang),
        l_got AS ({_share_sql('SELECT * FROM l', 'domain')}),
        s AS (SELECT a.domain, a.lang, a.source, a.source AS name, a.supply, a.supply * {EPOCHS} AS cap,
                CASE WHEN length(a.source) > 4 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, l_got.got AS budget
            FROM leaves a JOIN l_got ON a.domain = l_got.domain AND a.lang = l_got.lang),
        s_got AS ({_share_sql('SELECT * FROM s', 'domain, lang')}),
        streams AS (SELECT c.*, g.supply, g.got AS mine, e.epoch::INTEGER AS epoch,
                md5('{SEED}:' || e.epoch || ':' || coalesce(CAST(c.doc_id AS VARCHAR), '')) AS place
            FROM counted c JOIN s_got g ON c.domain = g.domain AND c.lang = g.lang AND c.source = g.source,
                range({EPOCHS}) e(epoch) WHERE c.n_tokens > 0),
        placed AS (SELECT *, CAST(epoch * supply + coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch
            ORDER BY place, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM streams)
        SELECT doc_id, domain, lang, source, epoch, start, n_tokens, least(n_tokens, mine - start) AS taken
        FROM placed WHERE start < mine""",
    "op6_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
        sized AS (SELECT *, 20 + length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text,
            '\\|</?s>|\[/?INST\]')) AS chars FROM turns)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(chars)::BIGINT AS formatted_chars FROM sized GROUP BY conv_id""",
}
