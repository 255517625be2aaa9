"""Readers with explicit schemas, and the file check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from varigrade.operators.columns import nan_to_null, project_columns, trim_headers

# Input schemas (text files are read with these, never inferred).
DRUG_CODES = "drug_code string, drug_name string"
GENE_LOCI = "Refseq_ID string, Start bigint, Stop bigint, Name string"
GENOMIC_POSITIONS = ("variant string, chromosome string, position bigint, reference_nucleotide string, "
                     "alternative_nucleotide string")
CATALOGUE = ("DRUG string, GENE string, MUTATION string, VARIANT string, `FINAL CONFIDENCE GRADING` string, "
             "`PPV_DATASET ALL` double")

# Published checksums of the measurement release.
RELEASE_MD5 = {
    "MUTATIONS.parquet": "d5feeeae14304006ba67aaaef84cff03",
    "VARIANTS.parquet": "45dcd2628e147f90391fb37cdebb845b",
    "UKMYC_PHENOTYPES.parquet": "020b6c0af6c05e19610a59f5ef97b832",
    "UKMYC_PLATES.parquet": "7b2880f45079c74e88aa4d12c1c18167",
    "UKMYC_GROWTH.parquet": "403ba6d904a3846b8d2535be2de4785a",
    "GENOMES.parquet": "ebd82e85f71e36de5da10e776b6afe4e",
    "EFFECTS.parquet": "15bc4e893c0dbcf417cd6e7c94e34517",
    "PREDICTIONS.parquet": "a9eff6b9c527b87a075f2973d052963c",
    "DST_MEASUREMENTS.parquet": "45b4501ea7c3925af565dbbc6188dec0",
    "DST_SAMPLES.parquet": "afa5d4d67e0e9ea9e4f325f06d815e9a",
    "BASHTHEBUG.parquet": "aa8b8eb4ac63d5473b2d8cc82a6f8a69",
    "BASHTHEBUG_CLASSIFICATIONS.parquet": "079413ecb6bc172ab97a0445f8556db5",
    "PLATE_LAYOUT.parquet": "cb403c7517ec847467b7980cbc3e5389",
    "WGS_SAMPLES.parquet": "ea798f4cfc28525cf394ff9196c93021",
    "COUNTRIES_LOOKUP.csv.gz": "693cbffe95d305499779e09d7bb903e6",
    "DRUG_CODES.csv.gz": "923d3a193df21698bd6a00f857ab337e",
    "SITES.csv.gz": "c24c882c8988b5af9940232ada27fb60",
    "DATA_SCHEMA.pdf": "8b11bfbb9255da6dfc1b8b7aede767d0",
    "RELEASE_NOTES.md": "dfac1d2007ad30bb749f7bb3bcb9645b",
}
STREAM_CHUNK = 8 << 20
DEFAULT_FILES = ("MUTATIONS.parquet", "UKMYC_PHENOTYPES.parquet", "DRUG_CODES.csv.gz")


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Columnar scan; NaN becomes null, and unused columns and filters reach the file reader."""
    df = spark.read.parquet(path)
    return nan_to_null(project_columns(df, columns) if columns else df)


def scan_text_table(spark: SparkSession, path: str, schema: str | StructType, sep: str) -> DataFrame:
    df = spark.read.schema(schema).csv(path, sep=sep, header=True, enforceSchema=True)
    return nan_to_null(trim_headers(df))


def scan_csv_gz(spark: SparkSession, path: str, schema: str | StructType = DRUG_CODES) -> DataFrame:
    """CSV with a header; gzip is recognised by suffix (one split per file, so keep such files small)."""
    return scan_text_table(spark, path, schema, ",")


def scan_tsv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Tab-separated table with a header; blanks around header names are dropped.

    Columns are taken by position, so the schema lists all columns of the file.
    """
    return scan_text_table(spark, path, schema, "\t")


def scan_tsv_by_name(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Tab-separated table of which only the named columns are wanted, cast to the given types.

    Only the header is looked at to find the names; all columns are read as text and pruned by the reader.
    """
    df = trim_headers(spark.read.csv(path, sep="\t", header=True, inferSchema=False))
    return nan_to_null(df.select(*[
        F.col(f"`{name}`").try_cast(kind).alias(name) for name, kind in columns.items()]))


def scan_by_header(spark: SparkSession, path: str, columns: dict[str, str], sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of a delimited table with headers: the named columns in their types, and what could not be read.

    Columns are found by their header, blanks around it dropped, wherever they stand; others are ignored and a missing one raises.
    A line with too few or too many fields, or with a value that its type can't hold, is left out of ``rows`` whole. Empty
    fields and NaN are null, not faults. ``rejected`` counts the faults as (column, value, n), most frequent first; a line of the
    wrong width counts under the column ``line``. Files of one folder must have the same header. An empty table gives two.
    """
    headers = spark.read.csv(path, sep=sep, header=True, inferSchema=False).columns
    places = {name.strip(): f"f{k}" for k, name in enumerate(headers)}
    missing = [name for name in columns if name not in places]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(places)}")
    schema = ", ".join([*(f"f{k} string" for k in range(len(headers))), "_line string"])
    # without pruning, so that the fields of each line are counted
    raw = spark.read.schema(schema).option("columnPruning", False).csv(
        path, sep=sep, header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_line")

    def text(name: str) -> Column:
        return F.trim(F.col(places[name]))

    def fault(name: str, kind: str) -> Column:
        bad = text(name).isNotNull() & (text(name) != "") & text(name).try_cast(kind).isNull()
        return F.when(bad, F.struct(F.lit(name).alias("column"), text(name).alias("value")))

    whole = F.when(F.col("_line").isNotNull(), F.array(F.struct(F.lit("line").alias("column"), F.col("_line").alias("value"))))
    single = F.array_compact(F.array(*[fault(name, kind) for name, kind in columns.items()]))
    read = raw.select("*", F.coalesce(whole, single).alias("_faults"))
    rows = read.filter(F.size("_faults") == 0).select(*[
        (text(name) if kind == "string" else text(name).try_cast(kind)).alias(name) for name, kind in columns.items()])
    faults = read.select(F.explode("_faults").alias("fault")).groupBy("fault.column", "fault.value")
    return nan_to_null(rows), faults.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "column", "value")


def choose_files(names: Sequence[str] | None = None, everything: bool = False) -> list[str]:
    """Release files by name or name prefix (first match), all of them, or the three the jobs need."""
    if everything:
        return list(RELEASE_MD5)
    if not names:
        return list(DEFAULT_FILES)
    chosen = []
    for name in names:
        match = next((known for known in RELEASE_MD5 if known.startswith(name)), None)
        if match is None:
            raise ValueError(f"unknown file {name}; available: {', '.join(RELEASE_MD5)}")
        chosen.append(match)
    return list(dict.fromkeys(chosen))


def release_manifest(spark: SparkSession, names: Sequence[str] | None = None, everything: bool = False) -> DataFrame:
    rows = [(name, RELEASE_MD5[name]) for name in choose_files(names, everything)]
    return spark.createDataFrame(rows, "name string, md5 string")


def _stream_md5(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for path in batch["path"]:
            system, inner = FileSystem.from_uri(path)
            digest = hashlib.md5()
            with system.open_input_stream(inner) as stream:
                while chunk := stream.read(STREAM_CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield pd.DataFrame({"path": batch["path"], "actual": digests})


def file_checksums(spark: SparkSession, folder: str, name: Column | None = None) -> DataFrame:
    """(name, actual): the MD5 of every file below ``folder``, files spread over the tasks, each read in chunks.

    The name is the file's own, or what ``name`` makes of its ``path``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    streamed = files.mapInPandas(_stream_md5, "path string, actual string")
    own = F.element_at(F.split("path", "/"), -1)
    return streamed.select((own if name is None else name).alias("name"), "actual")


def line_md5(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, md5) of text files from their (name, line) rows, which come file by file and in order."""
    held, digest, found = None, None, []
    for batch in batches:
        for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != held:
                if digest:
                    found.append((held, digest.hexdigest()))
                held, digest = name, hashlib.md5()
            digest.update(line.encode())
            digest.update(b"\n")
    if digest:
        found.append((held, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["name", "md5"])


def compare_checksums(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(name, status): ``ok``, ``mismatch`` or ``missing`` for each manifest row."""
    status = (F.when(F.col("actual").isNull(), "missing")
              .when(F.col("actual") == F.col("md5"), "ok").otherwise("mismatch"))
    return manifest.join(found, "name", "left").select("name", status.alias("status"))


def verify_manifest(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``compare_checksums`` of the manifest and the files below ``folder``."""
    return compare_checksums(manifest, file_checksums(spark, folder))
