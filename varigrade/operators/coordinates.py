"""Gene-relative coordinates and mutation keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrade.functions.keys import strip
from varigrade.functions.scores import allele_base, allele_length
from varigrade.operators.joins import join_gene_loci, semi_needed_genes

UNKNOWN_MUTATION = "unknown_mutation"


def allele_length_bucket(df: DataFrame) -> DataFrame:
    """Replace the allele columns by their lengths and by the base, or ``LONG`` for longer alleles."""
    ref, alt = F.col("reference_nucleotide"), F.col("alternative_nucleotide")
    return df.withColumns({
        "ref_len": allele_length(ref), "alt_len": allele_length(alt),
        "ref_base": allele_base(ref), "alt_base": allele_base(alt),
    }).drop("reference_nucleotide", "alternative_nucleotide")


def mutation_key(df: DataFrame, gene: str = "gene", position: str = "position", output: str = "mutation_key",
                 compat: bool = False) -> DataFrame:
    """``gene_<gene>_<position>``; a row without a position has no key.

    A row without a kept gene is named ``unknown``; with ``compat`` it takes the first gene in sorted order,
    which is what an arg-max over all-zero gene columns gives.
    """
    if not compat:
        name = F.coalesce(F.col(gene), F.lit("unknown"))
    else:
        name = F.coalesce(F.col(gene), df.select(F.min(gene)).scalar())
    key = F.concat(F.lit("gene_"), name, F.lit("_"), F.col(position).cast("bigint").cast("string"))
    return df.withColumn(output, key)


def gene_coordinates(df: DataFrame, start: str = "start_pos", stop: str = "stop_pos") -> DataFrame:
    """Length-normalised position, distance to the gene end and codon phase; the locus columns are dropped."""
    length = F.col(stop) - F.col(start) + 1
    relative = F.col("position") - F.col(start) + 1
    return df.withColumns({
        "norm_position": F.try_divide(relative, length),
        "distance_to_end": length - relative,
        "codon_position": F.pmod(relative, F.lit(3)),
    }).drop(start, stop)


def attach_gene_coordinates(df: DataFrame, loci: DataFrame, gene: str = "gene") -> DataFrame:
    """Join the loci of the genes in use and derive the coordinates."""
    used = df.select(gene).filter(F.col(gene).isNotNull()).distinct()
    needed = semi_needed_genes(loci, used, gene=gene).withColumn("name", strip(F.col("name")))
    return gene_coordinates(join_gene_loci(df, needed, gene=gene))
