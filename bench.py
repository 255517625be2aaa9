"""Time the headline queries on local cores and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from varigrade.plans.catalog import QUERIES
from varigrade.session import local_session

HEADLINE = (
    "variant_mic_summary", "agg_variant_mic", "join_isolate_phenotype", "join_mic_exact", "modelling_table",
    "parse_mutation", "mutation_profile", "hgvs_coverage", "contingency_metrics", "solo_filter", "clean_features",
    "positioned_features", "encoded_measurements", "group_kfold", "random_split", "classification_report",
    "fold_summary", "mae_r2", "corr_pairs", "pca_explained",
)


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="varigrade-bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, sf_dir, "distinct_values")  # starts the executors; not counted
    seconds = {name: round(min(run(spark, sf_dir, name) for _ in range(2)), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
