"""What several text operators share: table access, Arrow batch helpers, held-out folds and bounded samples."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrade.session import scratch_path

LETTERS_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows per Arrow batch where rows hold whole texts; keeps a batch of ordinary texts near 2 MB.
TEXT_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % folds).cast("int")


def fold_of(value, folds: int) -> int:
    return zlib.crc32(str(value).encode()) % folds


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so what Python builds beside a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 17) -> DataFrame:
    """The ``rows`` rows with the smallest seeded hash of ``key``: the same rows on every run, at most ``rows``."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(rows)


class Stages:
    """Tables written to the shared folder and emptied again after their last reader.

    Leaving the ``with`` block, also by an error, empties all but those that were handed to ``keep``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: list[tuple[str, DataFrame | None]] = []

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[path for path, _ in self.held])

    def path(self, name: str) -> str:
        """A new folder that is emptied with the rest."""
        self.held.append((scratch_path(self.spark, name), None))
        return self.held[-1][0]

    def write(self, df: DataFrame) -> DataFrame:
        path = self.path("stage")
        df.write.parquet(path)
        self.held[-1] = (path, self.spark.read.schema(df.schema).parquet(path))
        return self.held[-1][1]

    def _named(self, stages: tuple) -> list[str]:
        return [path for path, df in self.held
                if any(path == s if isinstance(s, str) else df is s for s in stages)]

    def keep(self, *stages: DataFrame | str) -> None:
        """Whoever gets the result reads these."""
        kept = self._named(stages)
        self.held = [(path, df) for path, df in self.held if path not in kept]

    def drop(self, *stages: DataFrame | str) -> None:
        """Overwrite with no rows, by Spark's own writer, whatever the file system."""
        for path in self._named(stages):
            self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)
        self.keep(*stages)


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a text column without copying; a null text has start = end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        none = np.zeros(len(column), np.int64)
        return np.zeros(0, np.uint8), none, none
    at = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:].copy()
    if column.null_count:
        absent = np.asarray(column.is_null())
        ends[absent] = starts[absent]
    return raw, starts, ends


def keep_rows(docs: DataFrame, judge, key_columns: list[str], setup=None) -> DataFrame:
    """The rows of ``docs`` that ``judge(batch of key_columns, state)`` flags true; all columns stay, nothing is shuffled.

    ``setup`` makes the state of a task.
    """
    places = [docs.columns.index(c) for c in key_columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in slices(batches):
            if batch.num_rows:
                mask = pa.array(judge([batch.column(k) for k in places], state), pa.bool_())
                yield batch.filter(mask)

    return docs.mapInArrow(run, docs.schema)
