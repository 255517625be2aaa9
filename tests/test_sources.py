"""Readers, writers and the file check."""

import hashlib
import os

import pytest

from varigrade.plans import queries_tables
from varigrade.plans.catalog import QUERIES
from varigrade.sources import readers, sinks


def test_manifest(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(b"x" * 1000)
    (tmp_path / "b.bin").write_bytes(b"y" * 5000)
    (tmp_path / "c.bin").write_bytes(b"z")
    digest = {n: hashlib.md5((tmp_path / n).read_bytes()).hexdigest() for n in ("a.bin", "b.bin")}
    manifest = spark.createDataFrame(
        [("a.bin", digest["a.bin"]), ("b.bin", digest["b.bin"]), ("c.bin", "0" * 32), ("d.bin", "0" * 32)],
        "name string, md5 string")
    expected = {"a.bin": "ok", "b.bin": "ok", "c.bin": "mismatch", "d.bin": "missing"}
    assert dict(readers.verify_manifest(spark, str(tmp_path), manifest).collect()) == expected
    monkeypatch.setattr(readers, "STREAM_CHUNK", 700)
    assert dict(readers.verify_manifest(spark, str(tmp_path), manifest).collect()) == expected


def test_manifest_query_checks_all_documents(spark, sf_dir, monkeypatch):
    """All texts lie in the checked files, more files come with more documents, and files take several chunks."""
    folders, check = [], readers.file_checksums

    def watched(session, folder, **more):
        folders.append(folder)
        return check(session, folder, **more)

    monkeypatch.setattr(readers, "file_checksums", watched)
    monkeypatch.setattr(queries_tables, "PART_DOCS", 2)
    rows = dict(QUERIES["verify_manifest"](spark, sf_dir).collect())
    assert rows == {f"nation-{k}": {4: "missing", 3: "mismatch"}.get(k % 5, "ok") for k in range(25)}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders[0]).select("path", "length").collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lost = "pmod(doc_id, 25) % 5 = 4 and doc_id < 50"
    held = docs.filter(f"not ({lost})").selectExpr("sum(octet_length(text)) n").first().n
    assert held <= sum(f.length for f in files) <= held + docs.count() + 1000 and len(files) > 25


def test_choose_files():
    assert readers.choose_files() == list(readers.DEFAULT_FILES)
    assert readers.choose_files(["MUT", "UKMYC_PLATES.parquet"]) == ["MUTATIONS.parquet", "UKMYC_PLATES.parquet"]
    assert len(readers.choose_files(everything=True)) == 19
    with pytest.raises(ValueError, match="unknown file"):
        readers.choose_files(["nothing"])


def test_text_tables(spark, tmp_path):
    path = tmp_path / "loci.tsv"
    path.write_text(" Start\tStop \tOther\t Name \n1\t9\tx\tGene1\nbad\t\ty\tGene2\n")
    loci = readers.scan_tsv_by_name(spark, str(path), {"Name": "string", "Start": "bigint"})
    assert [tuple(r) for r in loci.collect()] == [("Gene1", 1), ("Gene2", None)]
    gz = tmp_path / "codes"
    spark.createDataFrame([("1", "Amikacin")], readers.DRUG_CODES).write.csv(str(gz), header=True, compression="gzip")
    assert all(n.endswith(".gz") for n in os.listdir(gz) if n.startswith("part"))
    assert readers.scan_csv_gz(spark, str(gz)).collect() == [("1", "Amikacin")]


def test_scan_turns_nan_into_null_and_prunes(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, float("nan"), "x"), (2, 1.0, "y")], "a int, b double, c string").write.parquet(path)
    df = readers.scan_parquet(spark, path, ["a", "b"])
    assert df.filter("b is null").count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:int,b:double>" in plan


def test_stage_is_built_once_and_again_when_cut_off(spark, tmp_path):
    path, calls = str(tmp_path / "stage"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert sinks.cache_table(spark, path, build).count() == 3
    assert sinks.cache_table(spark, path, build).count() == 3 and len(calls) == 1
    for marker in (tmp_path / "stage").glob("*/whole/*.parquet"):
        marker.unlink()
    assert sinks.cache_table(spark, path, build).count() == 3 and len(calls) == 2


def test_a_stage_is_built_again_when_an_input_or_a_setting_changes(spark, tmp_path):
    given, path, calls = str(tmp_path / "given"), str(tmp_path / "stage"), []

    def build():
        calls.append(1)
        return spark.read.parquet(given)

    spark.range(3).coalesce(1).write.parquet(given)
    for settings in ("a", "a", "b"):
        assert sinks.cache_table(spark, path, build, [given], settings).count() == 3
    assert len(calls) == 2
    spark.range(4).coalesce(1).write.mode("append").parquet(given)
    assert sinks.cache_table(spark, path, build, [given], "b").count() == 7 and len(calls) == 3


def test_label_map(spark, tmp_path):
    path = str(tmp_path / "map")
    sinks.sink_label_map(spark.createDataFrame([(1, "b"), (0, "a")], "id int, value string"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["0: a", "1: b"]


def test_tables_are_read_by_header_and_faults_counted(spark, tmp_path):
    path = tmp_path / "table.tsv"
    path.write_text("extra\t Stop \tName\n1\t12\tkatG\n2\tx\t rpoB \n3\t\t\n4\tx\n5\t6\t7\t8\n6\t13.5\tinhA\n")
    rows, rejected = readers.scan_by_header(spark, str(path), {"Name": "string", "Stop": "bigint"})
    assert sorted(map(tuple, rows.collect()), key=str) == [("katG", 12), (None, None)]
    found = {(r.column, r.value): r.n for r in rejected.collect()}
    assert found == {("Stop", "x"): 1, ("Stop", "13.5"): 1, ("line", "4\tx"): 1, ("line", "5\t6\t7\t8"): 1}
    with pytest.raises(ValueError, match="Start"):
        readers.scan_by_header(spark, str(path), {"Start": "bigint"})
    path.write_text("Name\n")
    empty = readers.scan_by_header(spark, str(path), {"Name": "string"})
    assert [part.count() for part in empty] == [0, 0]
