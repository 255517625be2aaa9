"""Session helpers: local defaults for tests and bench, and reliable checkpoints."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "12g", app: str = "varigrade") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; fall back to a scratch folder on single-JVM masters only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="varigrade-checkpoint-")
    context.setCheckpointDir(configured)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


#: For rows of some megabytes: Parquet's writer looks at the size of its pages and row groups after each of them, not after 100.
#: Tasks then hold a few such rows, since a page is packed at once and a row group is read at once.
_LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(2 << 20),
               "parquet.enable.dictionary": "false"}


def materialize(df: DataFrame, spread: bool = False, large_rows: bool = False) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back.

    Later uses agree with each other, survive lost executors, read only the columns they need, and let Spark plan
    with the table's real size. ``spread`` deals the rows evenly over ``spark.sql.shuffle.partitions`` files, for
    tables that are then read many times (model fits). ``large_rows`` are blocks, each as bytes.
    """
    path = scratch_path(df.sparkSession, "stage")
    if spread:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df.write.options(**_LARGE_ROWS if large_rows else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
