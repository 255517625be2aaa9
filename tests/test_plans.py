"""Shapes of physical plans, and skewed input."""

import pytest
from pyspark.sql import functions as F

from varigrade.operators import aggregates, joins
from varigrade.plans import fixtures, modelling
from varigrade.plans.catalog import QUERIES


def plan(df, mode="formatted"):
    query = df._jdf.queryExecution()
    kind = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return query.explainString(kind)


@pytest.mark.parametrize("name", ["variant_mic_summary", "modelling_table", "parse_mutation", "positioned_features",
                                  "classification_report", "solo_filter"])
def test_core_queries_stay_in_the_jvm(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for slow in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert slow not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.range(10).selectExpr(
        "id uniqueid", "'g' gene", "'A1V' mutation", "1 amino_acid_number", "'A' ref", "'V' alt", "true codes_protein",
        "false is_minor", "'unused' other").write.parquet(path)
    phenotypes = str(tmp_path / "p")
    spark.range(10).selectExpr("id uniqueid", "'1' drug", "1.0D log2mic", "'H' phenotype_quality").write.parquet(phenotypes)
    from varigrade.plans.measurements import measured_mutations

    codes = fixtures.table(spark, "", "drug_codes")
    text = plan(measured_mutations(spark.read.parquet(path), spark.read.parquet(phenotypes), codes))
    assert "EqualTo(codes_protein,true)" in text and "IsNotNull(ref)" in text and "IsNotNull(log2mic)" in text
    scans = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert not any("other" in s or "is_minor" in s or "phenotype_quality" in s for s in scans)


def test_value_filter_runs_before_the_joins(spark, tmp_path):
    catalogue = spark.createDataFrame([("m", "d", "g", "1) Assoc w R", "v", 0.5, "d")],
                                      "mutation string, drug string, gene string, grade string, variant string, ppv double, drug_norm string")
    catalogue.write.parquet(str(tmp_path / "c"))
    positions = spark.createDataFrame([("v", "v", "chr", 1, "A", "C")], "variant string, variant_norm string, chromosome string, "
                                      "position bigint, reference_nucleotide string, alternative_nucleotide string")
    mic = spark.createDataFrame([("v", "d", 1.0, 1.0, 5)], "variant_norm string, drug_norm string, mean_log2mic double, "
                                "median_log2mic double, count bigint")
    table = modelling.modelling_table(spark.read.parquet(str(tmp_path / "c")), positions, mic)
    assert "GreaterThan(ppv,0.0)" in plan(table)
    assert table.first().mean_log2mic_final == 1.0


def test_skewed_join_is_split(spark):
    """A third of the rows share one isolate: AQE splits that partition, and no row is lost."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        mutations = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("uniqueid"),
            F.sha2(F.col("id").cast("string"), 256).alias("mutation"))
        phenotypes = spark.range(-1, 5000).select(F.col("id").alias("uniqueid"), F.lit(1.0).alias("log2mic"))
        joined = joins.join_isolate_phenotype(mutations, phenotypes)
        assert joined.select(F.count_distinct("mutation")).first()[0] == 60000
        rows = joined.filter("log2mic > 0")
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_group_meets_as_frequencies(spark):
    """The shuffle on the group key carries distinct values, not rows."""
    df = spark.range(0, 50000, 1, 8).select(F.when(F.col("id") >= 0, "hot").alias("k"), (F.col("id") % 10).cast("double").alias("v"))
    out = aggregates.mean_median_count(df, ["k"], "v", "mean", "median", "n")
    assert out.first() == ("hot", 4.5, 4.5, 50000)
    text = plan(out, "simple")
    assert text.count("Exchange hashpartitioning") == 2 and "ObjectHashAggregate" not in text
