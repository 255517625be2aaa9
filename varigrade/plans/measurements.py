"""From isolates to a measurement summary per variant and drug."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrade.functions.keys import normalize_key, strip
from varigrade.functions.notation import aa_change, hgvs_variant, is_substitution
from varigrade.operators.aggregates import agg_variant_mic
from varigrade.operators.columns import filter_phenotyped
from varigrade.operators.joins import join_drug_dim, join_isolate_phenotype


def measured_mutations(mutations: DataFrame, phenotypes: DataFrame, drug_codes: DataFrame,
                       require_quality: bool = False) -> DataFrame:
    """One row per mutation and measurement of an isolate, with the drug's name."""
    joined = filter_phenotyped(join_isolate_phenotype(mutations, phenotypes), require_quality)
    return join_drug_dim(joined, drug_codes).select(
        "gene", "mutation", F.col("amino_acid_number").alias("gene_position"), "ref", "alt", "drug", "drug_name",
        "log2mic")


def to_hgvs_variant(df: DataFrame, stop: str = "Ter") -> DataFrame:
    """Add the catalogue's variant name; rows whose mutation is no plain substitution are dropped.

    The filter is one pattern on its own, so it stays cheap where Spark pushes it below an aggregate.
    """
    named = df.filter(is_substitution(F.col("mutation")) & F.col("gene").isNotNull())
    return named.withColumn("variant", hgvs_variant(F.col("gene"), F.col("mutation"), stop))


def hgvs_coverage(df: DataFrame) -> DataFrame:
    """Per gene: rows, rows that convert to a catalogue variant, and rows that do not.

    Rows collapse to distinct (gene, mutation) texts before the conversion.
    """
    texts = df.groupBy("gene", "mutation").agg(F.count(F.lit(1)).alias("n"))
    converts = is_substitution(F.col("mutation")) & F.col("gene").isNotNull()
    return texts.withColumn("_ok", F.when(converts, F.col("n")).otherwise(F.lit(0))).groupBy("gene").agg(
        F.sum("n").alias("n_rows"), F.sum("_ok").alias("n_converted"),
        (F.sum("n") - F.sum("_ok")).alias("n_dropped"))


def split_aa_change(df: DataFrame, column: str = "mutation") -> DataFrame:
    """Residue indexes and position of a substitution such as ``S450L`` in three columns."""
    parts = df.withColumn("_aa", aa_change(F.col(column)))
    return parts.select(*df.columns, "_aa.*")


def variant_mic_summary(mutations: DataFrame, phenotypes: DataFrame, drug_codes: DataFrame,
                        min_count: int = 5) -> DataFrame:
    """The whole job: join, filter, summarise per variant and drug, and name the variants."""
    return to_hgvs_variant(agg_variant_mic(measured_mutations(mutations, phenotypes, drug_codes), min_count))


def with_join_keys(summary: DataFrame) -> DataFrame:
    """Trim the variant and add the normalised variant and drug keys."""
    return summary.withColumns({
        "variant": strip(F.col("variant")),
        "variant_norm": normalize_key(F.col("variant")),
        "drug_norm": normalize_key(F.col("drug_name")),
    })
