"""Intervals of any length, and chain files."""

import gzip
import random

import pytest

from helixframe.operators import intervals
from helixframe.sources import chains

CHAIN = """# two chains over one region, one of them reversed
chain 900 chr1 100000 + 100 400 chr1 50000 + 1000 1310 1
100 20 30
100 0 0
80

chain 500 chr1 100000 + 150 350 chr2_alt 3000 - 200 400 2
200

chain 800 chrM 16000 + 0 50 chrM 17000 + 5 55 3
50
"""


def plain(text):
    """Every (chrom, pos) of the chains by walking them."""
    out, head = {}, None
    chain = 0
    for line in text.splitlines():
        f = line.split()
        if not f or f[0].startswith("#"):
            continue
        if f[0] == "chain":
            chain += 1
            head, t, q = f, int(f[5]), int(f[10])
            continue
        for i in range(int(f[0])):
            name = lambda x: {"chrM": "MT"}.get(x, x.removeprefix("chr"))
            p = int(head[8]) - 1 - (q + i) if head[9] == "-" else q + i
            out.setdefault((name(head[2]), t + i + 1), []).append((-int(head[1]), chain, name(head[7]), p + 1))
        t, q = t + int(f[0]) + int((f + ["0"])[1] if len(f) > 1 else 0), q + int(f[0]) + int(f[2] if len(f) > 2 else 0)
    return out


def test_lift_by_a_chain_file(spark, tmp_path):
    with gzip.open(tmp_path / "x.chain.gz", "wt") as f:
        f.write(CHAIN)
    blocks = chains.parse(chains.lines(spark, str(tmp_path / "x.chain.gz")))
    points = spark.createDataFrame([("1", p) for p in range(80, 430)] + [("MT", p) for p in (1, 50, 51)] + [("9", 5), (None, 5), ("1", None), ("1", 120)], "chrom string, pos long")
    got = sorted(((r.chrom, r.pos), r.lifted_chrom, r.lifted_pos, r.lifted_by) for r in intervals.lift(points, blocks).collect() if r.chrom and r.pos)
    want = plain(CHAIN)
    best = lambda k: min(want[k])[2:] + (len(want[k]),) if k in want else (None, None, None)
    assert got == sorted(((r.chrom, r.pos), *best((r.chrom, r.pos))) for r in points.collect() if r.chrom and r.pos)
    assert {g[3] for g in got} == {None, 1, 2} and ("1", 210) in want
    assert chains.broken(blocks).count() == 0


def test_broken_chains(spark):
    parse = lambda text: chains.parse(spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no long, value string"))
    assert [r.chain for r in chains.broken(parse(CHAIN.replace("1000 1310", "1000 1311"))).collect()] == [1]
    for bad in (CHAIN.replace("\n80\n", "\nx\n"), "5 1 1\n" + CHAIN, CHAIN.replace("chain 900 chr1", "chain chr1"), CHAIN.replace("100 20 30", "100 20")):
        with pytest.raises(Exception, match="chain file"):
            parse(bad).collect()


@pytest.mark.parametrize("bin_size", [1, 10, 1 << 14])
def test_intervals_of_any_length(spark, bin_size):
    rng = random.Random(bin_size)
    spans = [(rng.choice("12"), a := rng.randrange(-50, 30000), a + rng.choice([-1, 0, 1, 7, 90, 5000, 10**6, 10**12])) for _ in range(300)] + [("1", None, 5), (None, 0, 10**9)]
    points = [(rng.choice("123"), rng.randrange(-60, 40000)) for _ in range(400)] + [("1", None), (None, 5)]
    a = spark.createDataFrame([(c, p, i) for i, (c, p) in enumerate(points)], "chrom string, p long, i int")
    b = spark.createDataFrame([(c, s, e, j) for j, (c, s, e) in enumerate(spans)], "chrom string, s long, e long, j int")
    got = sorted((r.i, r.j) for r in intervals.points_in_intervals(a, b, "p", "s", "e", bin_size=bin_size).collect())
    assert got == sorted((i, j) for i, (c, p) in enumerate(points) for j, (d, s, e) in enumerate(spans) if None not in (c, p, d, s) and c == d and s <= p <= e)


def test_an_interval_is_one_row(spark):
    long = spark.createDataFrame([("1", 0, 250_000_000)] * 3, "chrom string, s long, e long")
    points = spark.createDataFrame([("1", 7)], "chrom string, p long")
    plan = intervals.points_in_intervals(points, long, "p", "s", "e", bin_size=1000)
    assert plan.count() == 3
    generated = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in x]
    assert len(generated) <= 1  # only points are repeated, once for each level that is in use
