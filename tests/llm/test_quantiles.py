"""Quantile summaries and exact ranks against plain Python."""

import math
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.llm import quantiles, queries


def check(got, groups, whole=True):
    """got: rows of judged() by group; groups: values by (group, batch)."""
    every = defaultdict(list)
    for (g, b), xs in groups.items():
        every[g, b] += xs
        every[g, -1] += xs
    want = {(g, b, i) for (g, b), xs in every.items() if len(xs) >= 20 for i in (1, 2, 3)}
    assert {(g, r.batch, r.i) for g, r in got} == want and len(got) == len(want)
    last = {}
    for g, r in sorted(got, key=lambda x: (str(x[0]), x[1].batch, x[1].i)):
        xs = sorted(every[g, r.batch])
        n = len(xs)
        assert (r.n, r.target, r.exact_x) == (n, math.ceil(r.i * n / 4), xs[math.ceil(r.i * n / 4) - 1])
        assert (r.n_below, r.n_upto) == (sum(x < r.answer for x in xs), sum(x <= r.answer for x in xs))
        assert min(10, len(set(xs))) <= r.points <= min(n, 1000)
        assert xs[0] <= r.answer <= xs[-1]
        error = max(0, r.n_below + 1 - r.target, r.target - r.n_upto)
        assert 1000 * error <= 20 * n and (n > quantiles.K or error == 0)
        if "rank_error" in r.__fields__:
            assert (r.rank_error, r.within) == (error, True)
        assert last.get((g, r.batch), -(10**18)) <= r.answer
        last[g, r.batch] = r.answer


def test_streams_of_the_shop(spark):
    sf = "/root/testdata/sf0.01"
    groups = defaultdict(list)
    for r in {r.click_id: r for r in spark.read.parquet(f"{sf}/clicks.parquet").collect()}.values():
        if r.client_id is not None and r.value is not None:
            b = zlib.crc32(str(r.click_id).encode()) % 4
            groups[("value", str(r.client_id)), b].append(math.floor(100 * r.value + 0.5) + 1000 * b)
    items = {r.item_id: r for r in spark.read.parquet(f"{sf}/items.parquet").collect()}
    for r in spark.read.parquet(f"{sf}/sale_lines.parquet").collect():
        if (i := items.get(r.item_id)) and i.brand is not None and i.price is not None:
            b = zlib.crc32(str(r.vendor_id).encode()) % 4
            groups[("price", i.brand), b].append(math.floor(100 * i.price + 0.5) + 1000 * b)
    check([((r.stream, r.grp), r) for r in queries.op13_quantiles(spark, sf).collect()], groups)


def test_one_hot_group(spark):
    rows = spark.range(60000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"), (F.col("id") % 2).cast("int").alias("b"), (F.col("id") * 7919 % 5003).alias("x"))
    groups = defaultdict(list)
    for r in rows.collect():
        groups[r.g, r.b].append(r.x)
    found = quantiles.judged(rows, quantiles.sketches(rows, ["g"], "b", "x"), ["g"], "b", "x", [0, 1]).withColumnRenamed("b", "batch")
    check([(r.g, r) for r in found.collect()], groups)


def test_odd_rows(spark):
    rows = [(None, 0, 5)] * 15 + [(None, 1, 7)] * 6 + [("a", 0, None)] * 30 + [("a", 1, x) for x in range(19)] + [("b", 1, -x) for x in range(20)]
    df = spark.createDataFrame(rows, "g string, b int, x long")
    got = {(r.g, r.b, r.i): (r.n, r.exact_x, r.answer, r.n_below, r.n_upto) for r in quantiles.judged(df, quantiles.sketches(df, ["g"], "b", "x"), ["g"], "b", "x", [0, 1]).collect()}
    assert got == {(None, -1, 1): (21, 5, 5, 0, 15), (None, -1, 2): (21, 5, 5, 0, 15), (None, -1, 3): (21, 7, 7, 15, 21)} | {("b", b, i): (20, -20 + 5 * i, -20 + 5 * i, 5 * i - 1, 5 * i) for b in (-1, 1) for i in (1, 2, 3)}
    none = df.limit(0)
    assert quantiles.judged(none, quantiles.sketches(none, ["g"], "b", "x"), ["g"], "b", "x", [0, 1]).count() == 0


@pytest.mark.parametrize("money,units", [(1.005, 101), (-0.005, 0), (-441.05, -44105), (float("nan"), None), (float("inf"), None), (None, None)])
def test_units(spark, money, units):
    want = None if units is None else math.floor(100 * money + 0.5)
    assert spark.createDataFrame([(money,)], "m double").select(quantiles.money_units(F.col("m"))).first()[0] == want
