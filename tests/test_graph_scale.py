"""Graphs in chunks: components, places and verdicts against plain Python, whatever the sizes of chunks."""

import random

from helixframe.operators import graph


def test_components_over_chunks(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(260)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(150)] + [("hub", f"h{i}") for i in range(90)] + [("z", "z"), (None, "a"), ("n1", None)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    want = {x: root(x) for x in up}
    for parts in (1, 7, 40):  # the more partitions, the smaller the chunks
        df = spark.createDataFrame(edges, "a string, b string").repartition(parts)
        got = graph.connected_components(df)
        assert {r["node"]: r["component"] for r in got.collect()} == want and got.count() == len(want)
    longs = spark.createDataFrame([(5, 3), (3, 9), (7, 8)], "a long, b long").repartition(3)
    assert {tuple(r) for r in graph.connected_components(longs).select("node", "component").collect()} == {(3, 3), (5, 3), (9, 3), (7, 7), (8, 7)}
    assert graph.connected_components(longs.filter("a > 100")).count() == 0


def test_crowded_keys_are_scanned(spark, monkeypatch):
    monkeypatch.setattr(graph, "CROWDED", 20)
    rows = spark.createDataFrame([("big" if i % 3 else f"k{i % 30}", f"{i:04d}") for i in range(300)], "component string, node string").repartition(8)
    got = {}
    for r in graph.ordered(rows).collect():
        got.setdefault(r["component"], []).append((r["place"], r["node"]))
    assert len(got["big"]) == 200
    for found in got.values():
        assert [n for n, _ in sorted(found)] == list(range(1, len(found) + 1)) and [x for _, x in sorted(found)] == sorted(x for _, x in found)


def test_verdict_and_hubs_read_pairs_once(spark):
    edges = spark.createDataFrame([("a", "b", 9), ("b", "a", 9), ("b", "c", 1), ("c", "c", 50), ("c", "d", 5), ("a", "c", None)], "a string, b string, w long")
    parts = lambda rows: spark.createDataFrame(rows, "node string, part int")
    good = [("a", 1), ("b", 1), ("c", 2), ("d", 2)]
    assert graph.split_verdict(edges, parts(good), 0.1) == "ACCEPT" and graph.split_verdict(edges, parts(good), 0.01) == "HOLD"
    assert graph.split_verdict(edges, parts(good[:3]), 0.9) == "HOLD" and graph.split_verdict(edges, parts([*good, ("a", 1)]), 0.9) == "HOLD"
    assert graph.split_verdict(edges.limit(0), parts(good), 0.9) == "HOLD"
    assert {tuple(r) for r in graph.hubs(edges, 2).collect()} == {("a", 2), ("b", 2), ("c", 3)}
    assert graph.hubs(edges, 2)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2  # before: four
    assert {tuple(r)[:2] for r in graph.without(edges, graph.hubs(edges, 3)).collect()} == {("a", "b"), ("b", "a")}
