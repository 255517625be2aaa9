"""Whole evaluation jobs: from the modelling table to prediction logs and metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrade.functions.notation import aa_index
from varigrade.functions.scores import cast_float32, evidence_weight, ppv_bin
from varigrade.operators import boosting, forests, models, networks
from varigrade.operators.columns import (
    drop_null_columns,
    drop_null_rows,
    fill_constants,
    filter_phenotyped,
    sanitize_numeric,
    select_by_dtype,
)
from varigrade.operators.coordinates import UNKNOWN_MUTATION
from varigrade.operators.encoding import build_vocab, encode_with_vocab, one_hot_drop_first
from varigrade.operators.folds import group_kfold, in_test_share, random_split
from varigrade.operators.joins import join_drug_dim, join_isolate_phenotype
from varigrade.operators.statistics import zscore_target
from varigrade.plans.modelling import clean_features, encode_model_table, positioned_features
from varigrade.session import materialize
from varigrade.sources import sinks

VOCABULARIES = {"gene": "gene", "pos": "amino_acid_number", "drug": "drug_name"}
CATEGORY_IDS = ("gene_id", "pos_id", "wt_aa", "mut_aa", "drug_id")


def feature_tables(model_table: DataFrame, loci: DataFrame, descriptors: DataFrame | None = None
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean features, features with coordinates, drug lookup)."""
    encoded, lookup = encode_model_table(materialize(model_table), descriptors)
    clean = materialize(clean_features(encoded))
    return clean, positioned_features(clean, loci), lookup


def grouped_rows(positioned: DataFrame, drop=models.BASELINE_DROP, folds: int = 5) -> DataFrame:
    """Feature vectors with bin, and folds by mutation; written once since every fit reads it."""
    # the group sizes and the rows read the first table, the widths, the levels and the vectors the second one
    binned = materialize(positioned.withColumn("ppv_bin", ppv_bin(F.col("ppv"))))
    split = materialize(group_kfold(binned, "mutation_key", folds, missing=UNKNOWN_MUTATION))
    vectors = models.columns_to_vector(split, (*drop, "fold"))
    return materialize(vectors.select("features", "fold", "mutation_key", "ppv", "ppv_bin", "has_exact_mic",
                                      "has_variant_mic"), spread=True)


#: Columns of ``boosting_table`` that are no features.
BOOSTING_DROP = (*models.BASELINE_DROP, "fold", "weight")


def boosting_table(positioned: DataFrame, folds: int = 5) -> DataFrame:
    """Plain feature columns with the boosters' filling, bin, evidence weight and fold; rows that still miss a number are
    left out. Written once: the bins, the blocks and the predictions read it.
    """
    features = [c for c in positioned.columns if c not in (*models.BASELINE_DROP, *models.CATEGORIES)]
    filled = fill_constants(positioned, {"mutation_position": -1, "del_len": 0, "ins_len": 0}, default=None)
    weight = evidence_weight(F.col("has_exact_mic"), F.col("has_variant_mic")).cast("double")
    binned = drop_null_rows(filled, features).withColumns({"ppv_bin": ppv_bin(F.col("ppv")), "weight": weight})
    return materialize(group_kfold(binned, "mutation_key", folds, missing=UNKNOWN_MUTATION), spread=True)


def boosting_log(table: DataFrame, settings: Sequence[boosting.Setting] = boosting.SETTINGS, sample_rows: int | None = None
                 ) -> DataFrame:
    """Prediction log of every setting over all folds of ``boosting_table``."""
    fitted = boosting.fit_boosters(table, settings, "ppv_bin", "weight", BOOSTING_DROP, sample_rows=sample_rows, key="mutation_key")
    return fitted.prediction_log(table, "ppv_bin", "mutation_key")


def holdout_rows(clean: DataFrame) -> DataFrame:
    """Feature vectors for tasks on the grade, with infinite and missing numbers set to -1."""
    vectors = models.columns_to_vector(sanitize_numeric(clean), models.BASELINE_DROP, missing=-1.0)
    return materialize(vectors.select("features", "gene", "drug", "resistant", "ppv", "has_exact_mic",
                                      "has_variant_mic"), spread=True)


def eda_matrix(positioned: DataFrame, target: str = "resistant") -> DataFrame:
    """Complete numeric columns for correlation and projection: numbers, and categories without their first level."""
    features = positioned.drop(target, "mutation_key")
    categories = [c for c, kind in features.dtypes if kind == "string"]
    return drop_null_columns(select_by_dtype(one_hot_drop_first(features, categories)))


def encoded_measurements(mutations: DataFrame, phenotypes: DataFrame, drug_codes: DataFrame,
                         vocabularies: dict[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(ids and value of every quality measurement, vocabularies).

    Saved vocabularies keep the ids of an earlier run; values they lack take id 0.
    """
    joined = filter_phenotyped(join_isolate_phenotype(mutations, phenotypes))
    rows = join_drug_dim(joined, drug_codes)
    if vocabularies is None:
        # the distinct combinations are few; all vocabularies are read off them, so the join runs once for it
        seen = materialize(rows.select(*VOCABULARIES.values()).distinct())
        vocabularies = {name: build_vocab(seen, column) for name, column in VOCABULARIES.items()}
    for name, column in VOCABULARIES.items():
        rows = encode_with_vocab(rows, column, vocabularies[name], f"{name}_id")
    ids = rows.select(
        "uniqueid", "gene_id", "pos_id", aa_index(F.col("ref")).alias("wt_aa"), aa_index(F.col("alt")).alias("mut_aa"),
        "drug_id", cast_float32(F.col("log2mic")).alias("log2mic"))
    return ids, vocabularies


def forest_cv(rows: DataFrame, target: str, sample_rows: int | None = None, classes: int = 0, folds: int = 5, trees: int = 200) -> DataFrame:
    """Prediction log of a forest over all folds of ``grouped_rows``.

    Classes are fitted with balanced times evidence weights on the square root of the features a node, values without
    weights on all features. All rows are fitted on, or at most ``sample_rows``; every row is predicted.
    """
    weight = evidence_weight(F.col("has_exact_mic"), F.col("has_variant_mic")) if classes else F.lit(1.0)
    how = {"classes": classes, "trees": trees, "subset": "sqrt" if classes else "all", "balance": classes > 0}
    return _forest_log(rows, target, weight, F.col("fold"), range(folds), sample_rows, "mutation_key", "int" if classes else "double", how)


def forest_split(rows: DataFrame, key: str, target: str, sample_rows: int | None = None, trees: int = 200) -> DataFrame:
    """Prediction log of one regression forest for the fifth of the keys that is held out."""
    fold = F.when(in_test_share(F.col(key)), 0).otherwise(1)
    return _forest_log(rows, target, F.lit(1.0), fold, [0], sample_rows, "gene", "double", {"trees": trees, "subset": "all"})


def _forest_log(rows: DataFrame, target: str, weight: Column, fold: Column, folds: Sequence[int], sample_rows: int | None, group: str,
                kind: str, how: dict) -> DataFrame:
    keep = {"fold": fold.cast("int"), "mutation": F.col(group), "actual": F.col(target).cast(kind)}
    if sample_rows is None:
        log = forests.whole_log(rows, "features", target, weight, fold, folds, keep, **how)
    else:
        forest = forests.fit_forests(rows, "features", target, weight, fold, folds, sample_rows, **how)
        log = forest.predictions(rows, "features", fold, keep, f"fold int, mutation string, actual {kind}")
    return log.select(F.lit("random_forest").alias("model"), "fold", "mutation", "actual", F.col("predicted").cast(kind).alias("predicted"))


#: Embedding widths of gene, position, amino acid (of both sides) and drug, and the table of each id column.
EMBEDDING_WIDTHS, EMBEDDING_USES = (64, 32, 16, 16), (0, 1, 2, 2, 3)


def network_cv(rows: DataFrame, target: str, classes: int = 0, folds: int = 5,
               training: networks.Training = networks.Training()) -> tuple[DataFrame, DataFrame]:
    """(prediction log, losses by fold and epoch) of a perceptron with hidden layers of 64 and 32 units.

    ``rows`` come from ``grouped_rows``. A tenth of the groups is held back to end each fold's fit. ``classes`` 0 fits the
    value itself. All folds are fitted by the same passes.
    """
    width = models.vector_width(rows, "features")
    network = networks.Network(inputs=width, outputs=classes or 1, classes=classes > 0)
    weight = evidence_weight(F.col("has_exact_mic"), F.col("has_variant_mic"))
    blocks = networks.blocks_of(rows, "features", (), F.col(target), weight, F.col("fold"),
                                in_test_share(F.col("mutation_key"), share=0.1), folds)
    scales = networks.feature_scales(blocks, width, folds)
    state = networks.train(blocks, network, folds, training, scales)
    blocks.unpersist()
    kind = "int" if classes else "double"
    log = networks.predictions(
        rows, network, state, scales, "features", (), F.col("fold"),
        {"fold": F.col("fold").cast("int"), "mutation": F.col("mutation_key"), "actual": F.col(target).cast(kind)},
        f"fold int, mutation string, actual {kind}")
    name = F.lit("perceptron").alias("model")
    return log.select(name, "fold", "mutation", "actual", F.col("predicted").cast(kind).alias("predicted")), \
        networks.losses_table(rows, state)


@dataclass(frozen=True)
class MeasurementFit:
    """A fitted measurement network; ``losses`` is a row an epoch, ``log`` the z-scored values of both parts."""

    network: networks.Network
    state: networks.Fit
    losses: DataFrame
    log: DataFrame


def fit_measurements(ids: DataFrame, training: networks.Training = networks.Training(epochs=100, step=0.01, decay=0.0),
                     store: sinks.StateStore | None = None, stop_after: int | None = None) -> MeasurementFit:
    """Regression of the z-scored value on embeddings of the category ids: 80 % of the isolates to fit, the others to stop by.

    Rows with equal ids, value and part are one row with their number as weight, which gives the same loss and the same
    gradients. With a ``store`` the state of every epoch is kept, and a run that was cut off goes on from the last one.
    A gene table too long for the driver stays on the executors, and ``state`` lacks it.
    """
    train, validation = zscore_target(*random_split(
        ids.withColumn("target", F.col("log2mic").cast("double")), "uniqueid"), "target")
    both = train.withColumn("held", F.lit(False)).unionByName(validation.withColumn("held", F.lit(True)))
    rows = materialize(both.groupBy(*CATEGORY_IDS, "target", "held").agg(F.count(F.lit(1)).alias("n")), spread=True)
    top = rows.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in CATEGORY_IDS]).first()  # one row
    sizes = [0] * len(EMBEDDING_WIDTHS)
    for column, use in zip(CATEGORY_IDS, EMBEDDING_USES):
        sizes[use] = max(sizes[use], top[column] + 1)
    network = networks.Network(tables=tuple(zip(sizes, EMBEDDING_WIDTHS)), uses=EMBEDDING_USES, hidden=(128, 64))
    target, part = F.col("target"), F.when(F.col("held"), "validation").otherwise("train")
    keep, kinds = {"part": part, "actual": target, "n": F.col("n")}, "part string, actual double, n long"
    long = network.long_table()
    if long is None:
        blocks = networks.blocks_of(rows, None, CATEGORY_IDS, target, F.col("n"), F.lit(-1), F.col("held"), 1)
        state = networks.train(blocks, network, 1, training, store=store, stop_after=stop_after)
        blocks.unpersist()
        log = networks.predictions(rows, network, state, None, None, CATEGORY_IDS, F.lit(0), keep, kinds)
    else:
        fit, best = networks.train_spread(rows, CATEGORY_IDS, target, F.col("n"), F.col("held"), network, long, training, store, stop_after)
        state, log = [fit], networks.predictions_spread(rows, network, long, fit, best, CATEGORY_IDS, keep, kinds)
    return MeasurementFit(network, state[0], networks.losses_table(ids, state), log)


def measurement_scores(log: DataFrame) -> DataFrame:
    """(part, n, mae, r2) of a measurement log whose rows stand for ``n`` measurements each."""
    n, gap = F.col("n"), F.col("actual") - F.col("predicted")
    sums = log.groupBy("part").agg(
        F.sum("n").alias("n"), F.sum(n * F.abs(gap)).alias("_abs"), F.sum(n * gap * gap).alias("_sse"),
        F.sum(n * F.col("actual")).alias("_sum"), F.sum(n * F.col("actual") * F.col("actual")).alias("_square"))
    spread = F.col("_square") - F.col("_sum") * F.col("_sum") / F.col("n")
    return sums.select("part", "n", (F.col("_abs") / F.col("n")).alias("mae"), (1 - F.try_divide("_sse", spread)).alias("r2"))
