"""Weighted Spark ML fits on one feature vector, and the loops that evaluate them on unseen groups or drugs.

Fits run on whole distributed tables; the driver holds model parameters only. Trees and iterations default to the
full size; smaller ones are an argument.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varigrade.functions.scores import evidence_weight
from varigrade.operators import components, logistic
from varigrade.operators.columns import isin_split
from varigrade.operators.encoding import one_hot_vectors
from varigrade.operators.folds import in_test_share
from varigrade.operators.metrics import union_folds
from varigrade.operators.statistics import class_weights_balanced

CATEGORIES = ("gene", "mut_type", "ref", "alt", "ref_base", "alt_base")
# Columns that are no features, by task.
BASELINE_DROP = ("resistant", "ppv", "drug", "drug_norm", "mutation_key", "ppv_bin")
HOLDOUT_REGRESSION_DROP = (*BASELINE_DROP, "position")
# The drugs of the hold-out task.
HELD_OUT_DRUGS = ("Amikacin", "Kanamycin", "Streptomycin")
MAX_TREE_DEPTH = 30


def columns_to_vector(df: DataFrame, drop: Sequence[str] = BASELINE_DROP, output: str = "features",
                      missing: float = 0.0) -> DataFrame:
    """Add one sparse vector of all feature columns; the input columns stay.

    Numbers are taken as they are (missing ones become ``missing``), categories as one-hot slots, arrays element by
    element. Columns in ``drop`` are left out; any other text column is refused.
    """
    fields = [f for f in df.schema.fields if f.name not in drop]
    unknown = [f.name for f in fields if isinstance(f.dataType, T.StringType) and f.name not in CATEGORIES]
    if unknown:
        raise ValueError(f"neither a category nor dropped: {', '.join(unknown)}")
    numbers = [f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    arrays = [f.name for f in fields if isinstance(f.dataType, T.ArrayType)]
    categories = [f.name for f in fields if f.name in CATEGORIES]
    # one row: the widths of the arrays, so that a row without descriptors gets zeros
    widths = df.agg(*[F.coalesce(F.max(F.size(c)), F.lit(0)).alias(c) for c in arrays]).first() if arrays else {}
    filled = df.withColumns(
        {f"_n_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(missing))) for c in numbers}
        | {f"_a_{c}": array_to_vector(F.coalesce(F.col(c).cast("array<double>"), F.array_repeat(F.lit(0.0), max(0, widths[c]))))
           for c in arrays})
    hot = one_hot_vectors(categories).fit(filled).transform(filled) if categories else filled
    inputs = [*[f"_n_{c}" for c in numbers], *[f"{c}_hot" for c in categories], *[f"_a_{c}" for c in arrays]]
    assembled = VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="error").transform(hot)
    return assembled.select(*df.columns, output)


@dataclass(frozen=True)
class Learner:
    """A named estimator with its weighting and scaling.

    ``build`` makes the estimator for a training part whose rows carry ``features`` (and ``weight`` unless
    ``weighting`` is ``none``). Weighting is ``none``, ``evidence``, ``balanced`` or ``both``.
    """

    name: str
    build: Callable[[DataFrame], Estimator]
    weighting: str = "evidence"
    scale: bool = False
    centre: bool = False

    @property
    def evidence(self) -> Column:
        if self.weighting in ("evidence", "both"):
            return evidence_weight(F.col("has_exact_mic"), F.col("has_variant_mic")).cast("double")
        return F.lit(1.0)

    @property
    def balance(self) -> bool:
        return self.weighting in ("balanced", "both")

    def prepare(self, train: DataFrame) -> DataFrame:
        if self.balance:
            return class_weights_balanced(train, "label", "weight", self.evidence)
        return train.withColumn("weight", self.evidence)

    def fit(self, train: DataFrame) -> PipelineModel:
        raw = train.withColumnRenamed("features", "raw")
        if self.scale:
            first = StandardScaler(inputCol="raw", outputCol="features", withMean=self.centre, withStd=True)
        else:
            first = VectorAssembler(inputCols=["raw"], outputCol="features")
        scaled = Pipeline(stages=[first]).fit(raw)
        prepared = self.prepare(scaled.transform(raw))
        return PipelineModel([*scaled.stages, self.build(prepared).fit(prepared)])


@dataclass(frozen=True)
class Logistic(Learner):
    """Logistic regression whose folds share their passes; on the components with ``share`` of the variance, if that is given."""

    build: Callable[[DataFrame], Estimator] | None = None
    c: float = 1.0
    iterations: int = 1000
    share: float | None = None

    def fit(self, train: DataFrame) -> PipelineModel:
        return self.fit_folds(train, F.lit(-1), 1)[0]

    def fit_folds(self, rows: DataFrame, fold: Column, folds: int) -> list[PipelineModel]:
        """A model for each fold, fitted on the rows of other folds; components are those of all rows."""
        reduced = None if self.share is None else components.components_for(rows, self.share)
        made = logistic.fit_logistic(rows.filter(fold.isNotNull()), "features", F.col("label"), self.evidence, fold, folds, self.c, self.iterations,
                                     self.balance, reduced)
        return [PipelineModel([model]) for model in made]


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows.withColumnRenamed("features", "raw"))


# learners

def rf_regress(trees: int = 200, depth: int = MAX_TREE_DEPTH, seed: int = 42) -> Learner:
    return Learner("random_forest", lambda train: RandomForestRegressor(
        numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all"), weighting="none")


def rf_classify(trees: int = 200, depth: int = MAX_TREE_DEPTH, seed: int = 42) -> Learner:
    return Learner("random_forest", lambda train: RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", featureSubsetStrategy="sqrt"), weighting="both")


def logreg_classify(c: float = 0.1, weighting: str = "both", iterations: int = 1000) -> Learner:
    """Multinomial, L2 of strength 1/C on scaled features; centring would only move the free intercept."""
    return Logistic("logistic", weighting=weighting, c=c, iterations=iterations)


def gbt_regress(iterations: int = 500, depth: int = 5, seed: int = 42) -> Learner:
    """Boosted trees that stop when a held-back tenth of the groups no longer improves."""
    return Learner("boosted_trees", lambda train: GBTRegressor(
        maxIter=iterations, maxDepth=depth, seed=seed, weightCol="weight", validationIndicatorCol="is_validation"))


def boost_classify(name: str = "boosted_trees", iterations: int = 100, depth: int = 5, step: float = 0.1,
                   seed: int = 42) -> Learner:
    """One binary booster per class."""
    return Learner(name, lambda train: OneVsRest(
        classifier=GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=step, seed=seed), weightCol="weight", parallelism=4))


# evaluation

def labelled(df: DataFrame, target: str) -> DataFrame:
    """The target as ``label``, and a validation flag by group for learners that stop early."""
    flagged = df.withColumn("label", F.col(target).cast("double"))
    if "mutation_key" in df.columns:
        flagged = flagged.withColumn("is_validation", in_test_share(F.col("mutation_key"), share=0.1))
    return flagged


def prediction_log(predicted: DataFrame, fold: int, group: str = "mutation_key", whole: bool = True) -> DataFrame:
    """(fold, mutation, actual, predicted); labels are whole numbers unless ``whole`` is off."""
    kind = "int" if whole else "double"
    return predicted.select(
        F.lit(fold).alias("fold"), F.col(group).alias("mutation"), F.col("label").cast(kind).alias("actual"),
        F.col("prediction").cast(kind).alias("predicted"))


def grouped_cv(df: DataFrame, learners: Sequence[Learner], target: str, folds: int = 5,
               whole: bool = True, parallelism: int = 5) -> DataFrame:
    """Prediction log of every learner over all folds: fit on the others, predict the fold.

    ``df`` carries ``features`` and ``fold``; materialise it first, each fit reads it again. The folds of ``Logistic`` share one
    copy of the rows. Of the others up to ``parallelism`` fits run at once, so the many short jobs of one fit fill the gaps of another.
    """
    rows = labelled(df, target)
    joint = {learner: learner.fit_folds(rows, F.col("fold"), folds) for learner in learners if isinstance(learner, Logistic)}

    def score(task: tuple[Learner, int]) -> DataFrame:
        learner, fold = task
        model = joint[learner][fold] if learner in joint else learner.fit(rows.filter(F.col("fold") != fold))
        log = prediction_log(predict(model, rows.filter(F.col("fold") == fold)), fold, whole=whole)
        return log.withColumn("model", F.lit(learner.name))

    tasks = [(learner, fold) for learner in learners for fold in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        running = [pool.submit(inheritable_thread_target(df.sparkSession)(score), task) for task in tasks]
        return union_folds([fit.result() for fit in running])


def split_eval(train: DataFrame, test: DataFrame, learner: Learner, target: str, group: str = "gene",
               whole: bool = True) -> DataFrame:
    """Prediction log of one fit on ``train``, for ``test``."""
    model = learner.fit(labelled(train, target))
    return prediction_log(predict(model, labelled(test, target)), 0, group, whole).withColumn(
        "model", F.lit(learner.name))


def drug_holdout_eval(df: DataFrame, lookup: DataFrame, learner: Learner, target: str = "resistant",
                      held_out: Sequence[str] = HELD_OUT_DRUGS) -> DataFrame:
    """Train without the held-out drugs, predict them. ``lookup`` translates drug names to codes."""
    codes = [row.id for row in lookup.filter(F.col("value").isin(list(held_out))).select("id").collect()]
    train, test = isin_split(df, "drug", codes)
    return split_eval(train, test, learner, target)


# principal components

def _scaled(df: DataFrame, features: str, output: str) -> DataFrame:
    return StandardScaler(inputCol=features, outputCol=output, withMean=True).fit(df).transform(df)


def vector_width(df: DataFrame, column: str) -> int:
    return df.select(F.size(vector_to_array(column))).first()[0]


def pca_explained(df: DataFrame, features: str = "features") -> DataFrame:
    """(component, ratio) of all principal components of the standardised features."""
    scaled = _scaled(df.select(features), features, "_scaled")
    model = PCA(k=vector_width(df, features), inputCol="_scaled", outputCol="_p").fit(scaled)
    rows = [(i + 1, float(r)) for i, r in enumerate(model.explainedVariance)]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double")


def pca_project(df: DataFrame, features: str = "features", components: int = 10, output: str = "projection") -> DataFrame:
    """Projection of the standardised features on the leading components (the first two make a plane view)."""
    scaled = _scaled(df, features, "_scaled")
    k = min(components, vector_width(df, features))
    return PCA(k=k, inputCol="_scaled", outputCol=output).fit(scaled).transform(scaled).drop("_scaled")


def components_for_share(explained: Sequence[float], share: float) -> int:
    """Number of leading components that first reach ``share`` of the variance."""
    reached, total = 0.0, 0
    for total, ratio in enumerate(explained, 1):
        reached += ratio
        if reached >= share:
            break
    return total


@dataclass(frozen=True)
class VarianceKept:
    """Scale, then keep the fewest principal components with ``share`` of the variance."""

    share: float = 0.95

    def fit(self, train: DataFrame, features: str = "features", output: str = "kept") -> PipelineModel:
        steps = Pipeline(stages=[
            StandardScaler(inputCol=features, outputCol="_scaled", withMean=True, withStd=True),
            PCA(k=vector_width(train, features), inputCol="_scaled", outputCol="_all"),
        ]).fit(train)
        kept = components_for_share(list(steps.stages[-1].explainedVariance), self.share)
        return PipelineModel([*steps.stages, VectorSlicer(inputCol="_all", outputCol=output, indices=list(range(kept)))])


def pca_logreg(train: DataFrame, test: DataFrame, target: str = "resistant", c: float = 1.0, share: float = 0.95,
               iterations: int = 1000) -> DataFrame:
    """Prediction log of logistic regression on the components that keep ``share`` of the training variance."""
    return split_eval(train, test, Logistic("pca_logistic", weighting="balanced", c=c, iterations=iterations, share=share), target)
