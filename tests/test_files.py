"""Files as DataFrames, and the checks around a load."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from helixframe.operators import guards
from helixframe.session import Scratch, release
from helixframe.sources import files


def test_staged_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "staged")
    files.write_partitions(spark.createDataFrame([("1", 5), ("1", 6), ("X", 7)], "chrom string, pos long"), path)
    assert len(list((tmp_path / "staged" / "chrom=1").glob("*.parquet"))) == 1
    one = files.read_partition(spark, path, "X")
    assert [r.pos for r in one.collect()] == [7] and "PartitionFilters: [isnotnull(chrom" in one._jdf.queryExecution().toString()


def test_json_arrays(spark, tmp_path):
    path = str(tmp_path / "arrays")
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(25)], "id long, name string")
    files.write_json_arrays(rows, path, F.floor(F.col("id") / 10))
    texts = [p.read_text() for p in (tmp_path / "arrays").rglob("*.txt")]
    assert sorted(len(json.loads(x)) for x in texts) == [5, 10, 10]
    assert files.read_json_arrays(spark, path, "id long, name string").count() == 25
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.json").write_text('[{"id": 1}, 5]')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json_arrays(spark, str(bad), "id long, name string").collect()


def test_bulk_stage_and_insert(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", True)], "id long, name string, active boolean")
    staged = files.stage(spark.createDataFrame([("b",), ("c",)], "name string"), str(tmp_path / "stage"))
    got = files.insert_select(table, staged, id=F.length("name") + F.lit(9))
    assert sorted((r.id, r.name, r.active) for r in got.collect()) == [(1, "a", True), (10, "b", None), (10, "c", None)]


def test_block_gzip_by_content(spark, tmp_path):
    end = bytes.fromhex(files.END_BLOCK)
    block = bytes.fromhex("1f8b08040000000000ff0600424302001b00") + b"payload"
    for name, data in {"whole": block + end, "cut": block + end[:-1], "plain": gzip.compress(b"x"), "none": b"", "text": b"abc"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.b, r.t) for r in files.contents(spark, str(tmp_path)).select("path", files.is_block_gzip(F.col("content")).alias("b"), files.is_truncated(F.col("content")).alias("t")).collect()}
    assert got == {"whole": (True, False), "cut": (True, True), "plain": (False, False), "text": (False, False)}  # the empty file gives no row


def test_cached_downloads(spark):
    wanted = spark.createDataFrame([("a", "v2"), ("b", "v2"), ("c", "v2")], "name string, label string")
    cached = spark.createDataFrame([("a", "d1", "v1", "d1"), ("b", "d1", "v1", "d2")], "name string, digest string, label string, actual string")
    assert sorted(map(tuple, files.reuse(wanted, cached).collect())) == [("a", "reuse", "v1"), ("b", "fetch", "v2"), ("c", "fetch", "v2")]


def test_chromosome_lists():
    assert guards.chromosome_list(None) is None and guards.chromosome_list(" chrX, 2,,1 ") == ["1", "2", "X"]
    for bad in ("", " , ", "1,Y", "chr", "23"):
        with pytest.raises(ValueError):
            guards.chromosome_list(bad)


def test_unchanged_releases(spark):
    registry = spark.createDataFrame([(1, "r1", "h1"), (2, "r2", "h2")], "source_version_id long, version string, digest string")
    pointers = spark.createDataFrame([("a", 2)], "source_db string, current_source_version_id long")
    come = [("a", "r2", "h2"), ("a", "r2", "other"), ("a", "r1", "h1"), ("a", "r2", None), ("b", "r2", "h2")]
    got = guards.unchanged(spark.createDataFrame(come, "source_db string, version string, digest string"), registry, pointers).collect()
    assert sorted((r.source_db, r.version, r.skip) for r in got) == [("a", "r1", False), ("a", "r2", False), ("a", "r2", False), ("a", "r2", True), ("b", "r2", False)]


def test_import_guards(spark):
    rows = [(None, False, True, "male_nonpar_haploid", "M"), (None, False, True, "male_nonpar_haploid", None), (None, False, False, "male_nonpar_haploid", None), (5, False, False, None, "F"), (5, True, True, None, "F"), (None, False, True, None, None)]
    df = spark.createDataFrame(rows, "n long, force boolean, x boolean, ploidy string, sex string")
    assert [r.v for r in df.select(guards.import_verdict(*[F.col(c) for c in df.columns]).alias("v")).collect()] == ["ok", "sex not determined", "ok", "already imported", "ok", "ok"]


def test_views_are_made_anew(spark):
    now = {"rows": spark.range(3)}
    definitions = {"v1": lambda: now["rows"].selectExpr("count(*) AS n"), "v2": lambda: now["rows"].selectExpr("max(id) AS m")}
    assert guards.materialise(spark, definitions)["v1"].first().n == 3
    now["rows"] = spark.range(5).withColumn("more", F.lit(1))
    made = guards.materialise(spark, definitions, ["v1"])
    assert made["v1"].first().n == 5 and spark.table("v2").first().m == 2
    with pytest.raises(ValueError, match="v3"):
        guards.materialise(spark, definitions, ["v1", "v3"])


def test_catalog_checks(spark):
    a, b = spark.range(3).withColumn("version_id", F.lit(1)), spark.range(0)
    assert guards.children({"a": a, "b": b}, ("version_id",)) == [("a", "version_id")]
    assert sorted(map(tuple, guards.counts({"a": a, "b": b}).collect())) == [("a", 3), ("b", 0)]
    assert sorted(map(tuple, guards.next_ids({"a": (a, "id"), "b": (b, "id")}).collect())) == [("a", 3), ("b", 1)]


def test_scratch_is_released(spark):
    scratch = Scratch(spark)
    df = scratch.save(spark.range(5).toDF("a"), "t")
    assert df.count() == 5
    release()
    with pytest.raises(Exception, match="(?i)not.*exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        spark.read.parquet(f"{scratch.root}/t").count()
