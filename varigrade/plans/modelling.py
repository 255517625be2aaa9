"""From the catalogue to the modelling table and its feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrade.functions.keys import normalize_key, strip
from varigrade.functions.notation import mutation_features
from varigrade.operators.aggregates import agg_variant_fallback, mic_fallback
from varigrade.operators.columns import encode_grade, filter_positive, rename_columns
from varigrade.operators.coordinates import allele_length_bucket, attach_gene_coordinates, mutation_key
from varigrade.operators.encoding import category_codes, prune_rare_categories
from varigrade.operators.joins import (
    join_drug_descriptors,
    join_mic_exact,
    join_mic_variant,
    join_variant_positions,
)

# Headers of the catalogue file and their short names.
CATALOGUE_NAMES = {
    "PPV_DATASET ALL": "ppv",
    "MUTATION": "mutation",
    "DRUG": "drug",
    "GENE": "gene",
    "FINAL CONFIDENCE GRADING": "grade",
    "VARIANT": "variant",
}
CATALOGUE_COLUMNS = ("mutation", "drug", "gene", "grade", "variant", "ppv", "drug_norm")
MODEL_COLUMNS = (
    "mutation", "drug", "ppv", "gene", "grade", "variant", "drug_norm",
    "chromosome", "position", "reference_nucleotide", "alternative_nucleotide",
    "mean_log2mic_final", "mic_count_final", "has_exact_mic", "has_variant_mic",
)


def clean_catalogue(catalogue: DataFrame) -> DataFrame:
    """Short names, a normalised drug key, and only the columns in use."""
    renamed = rename_columns(catalogue, CATALOGUE_NAMES)
    return renamed.withColumn("drug_norm", normalize_key(F.col("drug"))).select(*CATALOGUE_COLUMNS)


def clean_positions(positions: DataFrame) -> DataFrame:
    """Trimmed variant text with its normalised key."""
    trimmed = positions.withColumn("variant", strip(F.col("variant")))
    return trimmed.withColumn("variant_norm", normalize_key(F.col("variant")))


def merge_measurements(catalogue: DataFrame, positions: DataFrame, mic: DataFrame) -> DataFrame:
    """Catalogue rows with positions, exact measurements and the per-variant fallback.

    ``catalogue``, ``positions`` and ``mic`` are cleaned. Only named columns travel through the joins.
    """
    placed = join_variant_positions(catalogue, positions)
    exact = mic.select("variant_norm", "drug_norm", "mean_log2mic", "median_log2mic", "count")
    return mic_fallback(join_mic_variant(join_mic_exact(placed, exact), agg_variant_fallback(mic)))


def modelling_table(catalogue: DataFrame, positions: DataFrame, mic: DataFrame) -> DataFrame:
    """The modelling columns of all rows with a positive predictive value.

    The value filter touches the catalogue side only, so Spark runs it before the joins.
    """
    return filter_positive(merge_measurements(catalogue, positions, mic).select(*MODEL_COLUMNS))


def parse_mutation(df: DataFrame, column: str = "mutation", dictionary: bool = True) -> DataFrame:
    """Add the typed notation features of ``column``.

    With ``dictionary`` each distinct text is parsed once and joined back; without, every row is parsed in
    place with no shuffle, which suits tables whose texts hardly repeat.
    """
    if not dictionary:
        return mutation_features(df, column)
    texts = df.select(F.col(column).alias("_text")).filter(F.col("_text").isNotNull()).distinct()
    features = mutation_features(texts.withColumnRenamed("_text", "_key"), "_key")
    return df.join(features, F.col(column) == F.col("_key"), "left").drop("_key")


def mutation_profile(df: DataFrame, gene: str = "gene", column: str = "mutation") -> DataFrame:
    """Per gene and mutation type: rows, distinct positions, mean lengths and the type's share of the gene.

    The ``unknown`` rows show how much of each gene's notation stays unread. Rows collapse to distinct
    (gene, text) before they are parsed.
    """
    texts = df.groupBy(gene, column).agg(F.count(F.lit(1)).alias("n"))
    placed = mutation_features(texts, column).groupBy(gene, "mut_type", "mutation_position").agg(
        F.sum("n").alias("n"), F.sum(F.col("del_len") * F.col("n")).alias("_del"),
        F.sum(F.col("ins_len") * F.col("n")).alias("_ins"),
        F.sum(F.when(F.col("del_len").isNotNull(), F.col("n"))).alias("_known"))
    types = placed.groupBy(gene, "mut_type").agg(
        F.sum("n").alias("n_rows"), F.count("mutation_position").alias("n_positions"),
        F.try_divide(F.sum("_del"), F.sum("_known")).alias("mean_del_len"),
        F.try_divide(F.sum("_ins"), F.sum("_known")).alias("mean_ins_len"))
    totals = types.groupBy(gene).agg(F.sum("n_rows").alias("_total"))
    return types.join(totals, gene).withColumn("share", F.col("n_rows") / F.col("_total")).drop("_total")


def unparsed_mutations(df: DataFrame, column: str = "mutation", top: int = 20) -> DataFrame:
    """The most frequent texts that no notation rule reads."""
    texts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # counted by a second aggregate: a filter on mut_type would be pushed below the parser and repeat it
    unread = mutation_features(texts, column).groupBy(column).agg(
        F.sum(F.when(F.col("mut_type") == "unknown", F.col("n"))).alias("n")).filter("n is not null")
    return unread.orderBy(F.desc("n"), column).limit(top)


def encode_model_table(table: DataFrame, descriptors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(encoded rows, drug lookup): grade codes, parsed notation, drug descriptors and drug codes.

    Categories stay single columns (see ``one_hot`` and ``one_hot_vectors``). The parsed position is named
    ``mutation_position``, so the genomic ``position`` keeps its meaning. With descriptors, ``has_descriptor`` tells
    drugs that have them from drugs whose descriptor columns are null.
    """
    graded = encode_grade(table).withColumns({"gene": strip(F.col("gene")), "mutation": strip(F.col("mutation"))})
    parsed = parse_mutation(graded).drop("mutation", "variant", "chromosome")
    if descriptors is not None:
        known = descriptors.withColumn("has_descriptor", F.lit(1))
        parsed = join_drug_descriptors(parsed, known).withColumn("has_descriptor", F.coalesce("has_descriptor", F.lit(0)))
    coded, lookup = category_codes(parsed, "drug", "drug_code")
    return coded.drop("drug").withColumnRenamed("drug_code", "drug"), lookup


def clean_features(encoded: DataFrame, min_gene_rows: int = 10) -> DataFrame:
    """Rare genes blanked out and alleles bucketed."""
    return allele_length_bucket(prune_rare_categories(encoded, "gene", min_gene_rows))


def positioned_features(clean: DataFrame, loci: DataFrame, compat: bool = False) -> DataFrame:
    """Mutation keys and gene-relative coordinates on the cleaned features."""
    if not compat:
        return attach_gene_coordinates(mutation_key(clean), loci)
    # one gene per row for both the key and the locus
    named = clean.withColumn("_gene", F.coalesce("gene", clean.select(F.min("gene")).scalar()))
    return attach_gene_coordinates(mutation_key(named, gene="_gene"), loci, gene="_gene").drop("_gene")
