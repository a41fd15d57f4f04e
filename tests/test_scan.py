"""Prefix scans against plain Python, with keys that lie across ranges."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import scan


@pytest.fixture
def eight(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def ranges(df):
    from helixframe.session import Scratch

    return scan.deal(df, ["k"], ["v"], Scratch(df.sparkSession)).select(scan.RANGE).distinct().count()


def test_numbers_are_unique_and_gap_free(eight):
    rows = eight.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit(None).cast("string").alias("k"))
    got = scan.number(rows, ["v"]).collect()
    assert sorted((r.v, r.row_number) for r in got) == [(i, i + 1) for i in range(5000)]
    assert ranges(rows) > 4  # one key, a null one, and yet many ranges


def test_numbers_by_key(eight):
    # one key has all rows but a few, others are small, one is null
    rows = eight.range(4000).select(F.when(F.col("id") % 500 == 0, F.col("id").cast("string")).when(F.col("id") % 499 == 0, None).otherwise("hot").alias("k"), (-F.col("id") % 1000).alias("v"), F.col("id").alias("i"))
    got = scan.number(rows, ["v", "i"], ["k"], "n").collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.v, r.i)):
        want.setdefault(r.k, []).append(r.i)
    assert {(r.k, r.n): r.i for r in got} == {(k, n): i for k, ids in want.items() for n, i in enumerate(ids, 1)}
    assert ranges(rows) > 4


def test_numbers_of_like_rows(eight):
    rows = eight.range(300).select(F.lit("a").alias("k"), F.lit(1).alias("v"))
    assert sorted(r.n for r in scan.number(rows, ["v"], ["k"], "n").collect()) == list(range(1, 301))
    assert scan.number(rows.limit(0), ["v"], ["k"]).count() == 0


def test_running_sums(eight):
    rows = eight.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("x"))
    got = {r.v: r.total for r in scan.running(rows, ["v"], ["k"], total="x").collect()}
    sums = [0, 0]
    for i in range(3000):
        sums[i % 2] += i % 11 if i % 5 else 0
        assert got[i] == sums[i % 2]


@pytest.mark.parametrize("gap", [1, 3, 10**6])
def test_runs_over_many_ranges(eight, gap):
    positions = [i * 2 + (i // 37) * 3 + (i // 500) * 100 for i in range(4000)]
    rows = eight.createDataFrame([("x", p) for p in positions] + [("x", positions[0]), ("y", 5), ("y", None), (None, 1), (None, 2)], "k string, v long")
    want = []
    for p in sorted(set(positions)):
        if want and p - want[-1][1] <= gap:
            want[-1][1:] = [p, want[-1][2] + 1]
        else:
            want.append([p, p, 1])
    got = sorted((r.start, r.end, r.n) for r in scan.runs(rows, "k", "v", gap).collect() if r.k == "x")
    assert got == [tuple(w) for w in want]
    other = {(r.k, r.start, r.end, r.n) for r in scan.runs(rows, "k", "v", gap).collect() if r.k != "x"}
    assert other == {("y", 5, 5, 1), (None, 1, 2, 2)}
    assert ranges(rows) > 4
