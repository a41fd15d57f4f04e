import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import ann, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, score long, rank int"


def make(spark, n=3000, dim=8, seed=0, clusters=40):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((clusters, dim))
    x = (centre[rng.integers(0, clusters, n)] + 0.2 * rng.standard_normal((n, dim))).astype(np.float32)
    x[n // 2 :: 7] = x[5]  # a hot vector
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)]
    odd = [(n, None, 0, 0), (n + 100, [], 0, 0), (n + 200, [None] * dim, 0, 0), (n + 300, [float("nan")] * dim, 0, 0), (n + 400, [float("inf")] + [0.0] * (dim - 1), 0, 0), (None, x[0].tolist(), 0, 0), (n + 500, [1.0, 2.0], 0, 0), (n + 600, [0.0] * dim, 0, 0)]
    return x, spark.createDataFrame(rows + odd, SCHEMA).repartition(6)


def exact(x, ids, queries, k, zero_id=None):
    out = {}
    for q in queries:
        s = [(-float(np.dot(x[q], x[i])), i) for i in ids if i != q]
        out[q] = sorted(s)[:k]
    return out


def test_topk_against_all_pairs(spark):
    x, df = make(spark)
    y = np.floor(1024 * x.astype(np.float64))
    y = {i: v for i, v in enumerate(y)} | {3600: np.zeros(8)}
    got = {}
    for r in topk.search(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert set(got) == {i for i in y if i % 100 == 0}
    for q, rows in got.items():
        want = sorted((-int(y[q] @ y[i]), i) for i in y if i != q)[:10]
        assert [(s, v) for _, s, v in sorted(rows)] == want, q


def test_topk_with_few_rows_and_repeats(spark):
    few = spark.createDataFrame([(0, [1.0, 0.5], 0, 0), (1, [0.5, 0.5], 0, 0), (1, [0.5, 0.5], 0, 0), (0, [1.0, 0.5], 0, 0), (2, [1.0, 0.0], 0, 0)], SCHEMA)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(few, F.col("id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1024 * 1024), (0, 2, 1, 1024 * 512 + 512 * 512), (0, 3, 1, 1024 * 512 + 512 * 512)]
    assert topk.search(few.limit(0), F.col("id") % 100 == 0).count() == 0
    assert ann.search(few.limit(0), F.col("id") % 20 == 0).count() == 0
    near = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(few, F.col("id") % 20 == 0).orderBy("rank").collect()]
    assert near == [(0, 1, 2, 1.0), (0, 2, 1, 0.75), (0, 3, 1, 0.75)]


def test_ball_tree_bounds_hold():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((700, 5)) * 100, rng.standard_normal((9, 5)) * 100
    tree = topk.BallTree(x)
    bounds = tree.bounds(q)
    for n, (first, stop, _, _) in enumerate(tree.nodes):
        assert ((tree.x[first:stop] @ q.T).max(axis=0) <= bounds[:, n]).all()
    assert sorted(tree.order.tolist()) == list(range(700))


def test_probes_come_in_order_of_success():
    for m, n in ((1, 3), (2, 9), (3, 27), (4, 65), (6, 233)):
        by = ann.moves(m)
        assert len({tuple(x) for x in by.tolist()}) == len(by) == n and not by[0].any()
        frac = np.random.default_rng(1).random((20, m))
        order = ann.ranked(frac, by)
        cost = np.where(by[order] < 0, frac[:, None] ** 2, np.where(by[order] > 0, (1 - frac[:, None]) ** 2, 0)).sum(axis=2)
        assert (np.diff(cost, axis=1) >= -1e-12).all() and (order[:, 0] == 0).all()


def test_shape_grows_with_the_rows_and_clustered_vectors_meet_few():
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((40, 32))
    x = centre[rng.integers(0, 40, 4096)] + 0.15 * rng.standard_normal((4096, 32))
    norm = float(np.sqrt((x**2).sum(axis=1).max()))
    small, large = ann.fit(x, norm, 20, 4096), ann.fit(x, norm, 20, 4096 * 1000)
    assert small[3] < 0.3 and large[3] < 0.15 and large[2] > small[2]


def test_repeated_rows_and_rows_of_one_id(spark):
    rows = [(0, [1.0, 0.0], 0, 0), (1, [0.5, 0.5], 0, 0), (1, [0.5, 0.5], 0, 0), (1, [0.25, 0.0], 0, 0), (2, [0.9, 0.0], 0, 0), (0, [0.0, 1.0], 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for got in (ann.search(df, F.col("id") == 0), topk.search(df, F.col("id") == 0, scale=4)):
        seen = [(r.query_id, r["rank"], r.vec_id) for r in got.orderBy("rank").collect()]
        assert seen == [(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 4, 2)]  # [0, 1] asks, the least vector of the two


@pytest.mark.parametrize("cells", [8192, 64])
def test_ann_recall_ties_and_scores(spark, monkeypatch, cells):
    monkeypatch.setattr(ann, "VECTORS", cells)
    monkeypatch.setattr(ann, "QUERIES", cells)
    monkeypatch.setattr(ann, "SHAPES", ann.SHAPES[8:16])
    x, df = make(spark, clusters=12)
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = range(3000)
    assert set(got) == {i for i in ids if i % 20 == 0}
    hit = total = 0
    d = x.astype(np.float64)
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in {r[1] for r in rows}
        for _, v, s in rows:
            assert math.isclose(s, float(d[q] @ d[v]), rel_tol=1e-12, abs_tol=1e-12)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        want = sorted((-float((d[q] * d[i]).sum()), i) for i in ids if i != q)[:20]
        hit += len({i for _, i in want} & {v for _, v, _ in rows})
        total += 20
    assert hit / total >= 0.9


def test_ann_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    d = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in rows}
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(got[q] & {i for _, i in sorted((-float(d[q] @ d[i]), i) for i in d if i != q)[:20]}) for q in got)
    assert len(got) == 25 and hit / (20 * len(got)) >= 0.9


def test_blocks_hold_every_row_once(spark):
    _, df = make(spark, 500)
    rows = vectors.blocks(vectors.valid(df), 64).collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<i8") for r in rows])
    assert len(ids) == 502 and len(set(ids.tolist())) == 502 and all(r.n <= 64 for r in rows)
