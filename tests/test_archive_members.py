"""Members grow in number with the rows, and are written run by run."""

import pyarrow as pa
from pyspark.sql import functions as F

from helixframe.plans import catalog_more
from helixframe.sources import archives


def test_members_grow_with_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog_more, "MEMBER", 50)
    rows = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('a"\t'), F.col("id").cast("string"))).alias("v"))
    member = catalog_more.part_of("k", rows)
    assert rows.select(member).distinct().count() == 80  # before: 16, whatever the rows
    archives.write(rows, member, str(tmp_path / "z"), "zip")
    got = archives.read(spark, str(tmp_path / "z"), ["k", "v"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_runs():
    b = pa.RecordBatch.from_arrays([pa.array(["a", "a", None, None, "b"]), pa.array(["1", None, "3", "4", "5"])], names=["member", "x"])
    assert list(archives.runs(iter([b, b.slice(0, 0)]))) == [("a", [("1",), (None,)]), (None, [("3",), ("4",)]), ("b", [("5",)])]
