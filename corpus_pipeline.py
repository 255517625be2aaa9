"""A corpus pipeline: toxicity filter, near-duplicate removal, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. ``run`` writes every stage's rows as Parquet in
the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varigrade.llm import decontaminate, mixing, ngram_join, queries, token_files, toxicity
from varigrade.llm.common import fold, table
from varigrade.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7; a null or empty text stays."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.drop_toxic(docs, model, 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word n-grams, similarity 0.8 or more): the smallest id.

    Of rows that share an id one stays, the one whose text has the smallest hash (ties: smaller text); only such rows are
    shuffled for it. Rows without an id are in no group and stay.
    """
    found = ngram_join.near_duplicates(docs, width=5, percent=80)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    again = found.groupBy(F.col("doc_id").alias("id")).count().filter("count > 1").select("id")
    same = F.col("d.doc_id") == F.col("f.id")
    single = docs.alias("d").join(gone.union(again).alias("f"), same, "left_anti")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", F.to_json(F.struct("*")))
    row = "_" + "_".join(docs.columns)  # no column has this name
    first = (docs.alias("d").join(again.alias("f"), same, "left_semi").alias("d").join(gone.alias("f"), same, "left_anti")
             .withColumn(row, F.row_number().over(order)).filter(F.col(row) == 1))
    return single.select(*docs.columns).union(first.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of one epoch that give the target mixture of domains, languages and sources."""
    tree = {"domain": queries.domain(), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.keep_mixed(docs, tree, queries.weights(), queries.SHARE, queries.SEED)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files of the mixture, and their figures per document read back from them."""
    manifest = token_files.write_token_files(docs, queries.tokenizer_path())
    return token_files.read_token_files(manifest, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mix_sources", mix),
    ("token_files", write_tokens),
]

#: Learned scores and token ids are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
