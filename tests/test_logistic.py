"""Logistic regression by shared passes against Spark ML's fits of single folds."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varigrade.operators import logistic, models, networks
from varigrade.operators.statistics import class_weights_balanced

KINDS = (("features", VectorUDT()), ("ppv_bin", T.IntegerType()), ("fold", T.IntegerType()), ("has_exact_mic", T.IntegerType()),
         ("has_variant_mic", T.IntegerType()), ("mutation_key", T.StringType()))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8)) * (rng.random((600, 8)) < 0.6) * [1, 2, 30, 1, 1, 1, 1, 0] + [0, 0, 1000, 0, 0, 0, 0, 3]
    label = (x[:, 0] + 0.02 * x[:, 2] + rng.normal(size=600) * 0.7).round().clip(19, 22).astype(int) - 19
    label[label == 2] = 4  # class 2 has no rows
    made = [(Vectors.sparse(8, np.flatnonzero(v), v[np.flatnonzero(v)]), int(k), n % 3, n % 2, 0, f"m{n % 50}")
            for n, (v, k) in enumerate(zip(x, label))]
    return spark.createDataFrame(made, T.StructType([T.StructField(*k) for k in KINDS])).repartition(4).cache()


def probabilities(df):
    found = sorted((r.k, r.p) for r in df.select(F.xxhash64("v").alias("k"), vector_to_array("probability").alias("p")).collect())
    return np.array([p for _, p in found])


def spark_fit(train, c):
    weighted = class_weights_balanced(train, "label", "weight", F.col("has_exact_mic") * 3 + 1.0)
    total = weighted.agg(F.sum("weight")).first()[0]
    return LogisticRegression(family="multinomial", regParam=1 / (c * total), standardization=False, weightCol="weight", maxIter=1000,
                              tol=1e-12, featuresCol="scaled").fit(weighted)


def test_folds_fitted_together_equal_single_fits(rows, monkeypatch):
    copies = []
    monkeypatch.setattr(logistic.networks, "blocks_of", lambda *a, made=networks.blocks_of: copies.append(1) or made(*a))
    given = models.labelled(rows, "ppv_bin")
    fitted = models.logreg_classify().fit_folds(given, F.col("fold"), 3)
    assert len(copies) == 1  # one copy of the rows for all folds
    for fold, model in enumerate(fitted):
        train = given.filter(F.col("fold") != fold)
        scaler = StandardScaler(inputCol="features", outputCol="scaled").fit(train)
        expected = spark_fit(scaler.transform(train), 0.1).transform(scaler.transform(given).withColumn("v", vector_to_array("features")))
        made = models.predict(model, given).withColumn("v", vector_to_array("raw"))
        assert np.delete(probabilities(made), 2, axis=1) == pytest.approx(np.delete(probabilities(expected), 2, axis=1), abs=2e-3)
        assert {r[0] for r in made.select("prediction").distinct().collect()} <= {0.0, 1.0, 3.0, 4.0}


def test_components_are_fitted_without_dense_rows(rows, monkeypatch):
    """All classes present, so that Spark's own fit has no class that it has to drive away."""
    given = models.labelled(rows.withColumn("ppv_bin", F.least("ppv_bin", F.lit(2))).filter("ppv_bin is not null"), "ppv_bin")
    reduce = models.VarianceKept(0.8).fit(given)
    narrow = reduce.transform(given).withColumn("scaled", F.col("kept"))
    total = class_weights_balanced(narrow, "label", "weight")
    heavy = total.agg(F.sum("weight")).first()[0]
    fit = LogisticRegression(family="multinomial", regParam=1 / heavy, standardization=False, weightCol="weight", maxIter=1000,
                             tol=1e-12, featuresCol="scaled").fit(total)
    expected = fit.transform(narrow.withColumn("v", vector_to_array("features")))
    monkeypatch.setattr(models.components.Components, "project", None)
    model = models.Logistic("p", weighting="balanced", c=1.0, share=0.8).fit(given)
    made = models.predict(model, given).withColumn("v", vector_to_array("raw"))
    assert probabilities(made) == pytest.approx(probabilities(expected), abs=1e-4)


def test_nothing_to_fit_on(rows):
    with pytest.raises(ValueError, match="no labelled rows"):
        models.logreg_classify().fit(models.labelled(rows.filter("false"), "ppv_bin"))


def test_what_is_constant_in_training_has_no_coefficient(rows):
    """0.1 in all training rows: sums of its squares leave a rounding error that is no deviation."""
    x = F.when(F.col("fold") == 0, 5.0).otherwise(0.1).alias("x")
    given = models.columns_to_vector(rows.select("ppv_bin", "fold", "mutation_key", x, "has_exact_mic", "has_variant_mic"),
                                     (*models.BASELINE_DROP, "fold"))
    model = models.logreg_classify().fit_folds(models.labelled(given, "ppv_bin"), F.col("fold"), 1)[0].stages[0]
    assert model.getOrDefault(model.coefficients)[0] == [0.0] * 5
