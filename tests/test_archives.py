"""Archives as a data source: members as partitions, missing headers, commits."""

import gzip
import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from helixframe.sources import archives


def put_zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)


def put_tar(path, members, mode):
    with tarfile.open(path, mode) as t:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))


MEMBERS = {f"d/m{i}.tsv": "id\tname\tmore\n" + "".join(f"{i * 100 + j}\t{'é' if j % 2 else ''}\tx\n" for j in range(i * 10)) for i in range(1, 6)} | {"readme.txt": "not a table"}
WANT = sorted((str(i * 100 + j), "é" if j % 2 else None) for i in range(1, 6) for j in range(i * 10))


@pytest.mark.parametrize("kind", ["zip", "tar", "tar.gz"])
def test_members(spark, tmp_path, kind):
    path = str(tmp_path / f"a.{kind}")
    put_zip(path, MEMBERS) if kind == "zip" else put_tar(path, MEMBERS, "w:gz" if kind == "tar.gz" else "w")
    got = archives.read(spark, f"file:{path}", ["id", "name"], member=r"\.tsv$")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(WANT, key=str)
    assert got.rdd.getNumPartitions() == (1 if kind == "tar.gz" else 5)


def test_gzip_by_ordinal(spark, tmp_path):
    with gzip.open(tmp_path / "x.gz", "wt") as f:
        f.write("1\ta\t\tq\n2\tb\tz\tq\n")
    assert sorted(map(tuple, archives.read(spark, str(tmp_path / "x.gz"), ["_c2", "_c0"], header=False).collect()), key=str) == [("z", "2"), (None, "1")]


@pytest.mark.parametrize("text", ["id\tother\n1\t2\n", ""])
def test_a_member_without_the_header_is_refused(spark, tmp_path, text):
    put_zip(tmp_path / "a.zip", {"a.tsv": "id\tname\n1\tx\n", "b.tsv": text})
    with pytest.raises(Exception, match="b.tsv (lacks columns|has no header)"):
        archives.read(spark, str(tmp_path / "a.zip"), ["id", "name"]).collect()


@pytest.mark.parametrize("kind", ["zip", "tar", "tar.gz", "gz"])
def test_round_trip(spark, tmp_path, kind):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit('a "q"\tb'), F.col("id").cast("string"))).alias("text"))
    archives.write(rows, F.concat(F.lit("m"), F.lit(0) if kind == "gz" else F.col("id") % 5, F.lit(".tsv")), str(tmp_path / "out"), kind)
    assert not [x for x in os.listdir(tmp_path / "out") if x.startswith("_")]
    got = archives.read(spark, str(tmp_path / "out"), ["id", "text"])
    assert sorted((int(r.id), r.text) for r in got.collect()) == [(r.id, r.text) for r in rows.collect()]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="stop"):
        archives.write(bad, F.col("id") % 3, str(tmp_path / "out"), "zip")
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
