"""Equi-joins. No side is hinted for broadcast: Spark broadcasts a side only below its checked size
threshold (planned from statistics, or from real shuffle sizes by AQE), and AQE splits skewed partitions
of the preserved side, so a hot isolate, variant or null key does not land in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrade.functions.keys import strip
from varigrade.session import materialize


def join_isolate_phenotype(mutations: DataFrame, phenotypes: DataFrame, on: str = "uniqueid") -> DataFrame:
    """Every mutation of an isolate with every measurement of that isolate."""
    return mutations.join(phenotypes, on, "inner")


def join_drug_dim(df: DataFrame, drug_codes: DataFrame, code: str = "drug",
                  dim_code: str = "drug_code") -> DataFrame:
    """Attach drug names by code; an unknown code keeps a null name."""
    dim = drug_codes.withColumnRenamed(dim_code, "_code")
    return df.join(dim, F.col(code) == F.col("_code"), "left").drop("_code")


def join_variant_positions(catalogue: DataFrame, positions: DataFrame) -> DataFrame:
    """Attach genomic positions on the raw variant text; several positions multiply the row."""
    return catalogue.join(positions, "variant", "left")


def left_join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join where a null key equals a null key; fan-out is kept."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    return left.join(renamed, same, "left").drop(*[f"_right_{c}" for c in on])


def join_mic_exact(df: DataFrame, mic: DataFrame) -> DataFrame:
    """Attach the measurements of the same variant and drug; missing keys match each other."""
    return left_join_null_safe(df, mic, ["variant_norm", "drug_norm"])


def join_mic_variant(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """Attach the per-variant aggregate (one row per variant)."""
    return df.join(fallback, "variant_norm", "left")


def join_drug_descriptors(df: DataFrame, descriptors: DataFrame, drug: str = "drug") -> DataFrame:
    """Attach per-drug descriptor columns (fingerprint, embedding) on the exact name.

    Descriptors of the drugs in use are written as a stage first. Spark knows its size and broadcasts it if it is small, where a
    join of two large sides would sort all rows of a drug, or all those without one, in one task.
    """
    used = df.select(drug).filter(F.col(drug).isNotNull()).distinct()
    return df.join(materialize(descriptors.join(used, drug, "left_semi")), drug, "left")


def map_lookup_vector(df: DataFrame, descriptors: DataFrame, vector: str, drug: str = "drug") -> DataFrame:
    """Attach one vector column per drug; an unknown drug keeps a null vector."""
    return join_drug_descriptors(df, descriptors.select(drug, vector), drug)


def semi_needed_genes(loci: DataFrame, used: DataFrame, name: str = "name", gene: str = "gene") -> DataFrame:
    """Loci whose name is a used gene, matched case-sensitively."""
    return loci.join(used.select(F.col(gene).alias(name)), name, "left_semi")


def join_gene_loci(df: DataFrame, loci: DataFrame, gene: str = "gene", name: str = "name") -> DataFrame:
    """Attach locus coordinates, ignoring case and surrounding blanks of the names; duplicates multiply."""
    keyed = loci.withColumn("_locus", F.lower(strip(F.col(name)))).drop(name)
    return df.join(keyed, F.lower(strip(F.col(gene))) == F.col("_locus"), "left").drop("_locus")


def anti_unseen_vocab(df: DataFrame, vocabulary: DataFrame, column: str, value: str = "value") -> DataFrame:
    """Distinct non-null values of ``column`` that the saved vocabulary lacks."""
    seen = df.select(F.col(column).alias(value)).filter(F.col(value).isNotNull()).distinct()
    return seen.join(vocabulary.select(value), value, "left_anti")
