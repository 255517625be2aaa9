"""The join with drug descriptors where these are many and the drugs in use few."""

from varigrade.operators import joins


def test_few_used_descriptors_of_many_are_broadcast(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "drug string")
    many = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), (None, 4)] + [(f"x{k}", k) for k in range(20_000)], "drug string, v int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100kb")
    try:
        joined = joins.join_drug_descriptors(rows, many)
        assert "SortMergeJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(joined.collect(), key=str) == sorted(rows.join(many, "drug", "left").collect(), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
