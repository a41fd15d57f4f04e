"""Graph operators over edge DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import scan
from helixframe.session import Scratch

#: Edges that a task joins at once, and rows of a key up to which one task numbers them.
CHUNK, CROWDED = 1 << 20, 1 << 20


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of every node of each CHUNK edges (a, b) of a task: root is the smallest node that these edges join it to."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = pa.chunked_array([x for p in parts for x in p.columns]).combine_chunks()
        coded = ends.dictionary_encode()
        names = coded.dictionary.take(pc.sort_indices(coded.dictionary))
        place = pc.index_in(coded.dictionary, names).to_numpy()
        code = place[coded.indices.to_numpy()]
        a, b, at = [], [], 0
        for p in parts:
            a.append(code[at : at + len(p)])
            b.append(code[at + len(p) : at + 2 * len(p)])
            at += 2 * len(p)
        x, y, root = np.concatenate(a), np.concatenate(b), np.arange(len(names))
        while True:
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            open_ = low < high
            if not open_.any():
                break
            x, y = x[open_], y[open_]
            np.minimum.at(root, high[open_], low[open_])
            while not np.array_equal(up := root[root], root):
                root = up
        return pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], names=["node", "root"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= CHUNK:
            yield joined(held)
            held = []
    if held:
        yield joined(held)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; component is its smallest node.

    Tasks join what their own edges join, a chunk at a time; a node then meets the
    smallest nodes that chunks found for it, at most one a chunk however many edges
    it has. Where these differ they are linked, and only these links go through
    rounds. The table between is written to the shared scratch folder once. Null
    ends and loops are ignored; an edge given twice counts once.
    """
    scratch = Scratch(edges.sparkSession)
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    kind = dict(ends.dtypes)["a"]
    own = Window.partitionBy("node").orderBy("root")
    met = ends.mapInArrow(_local, f"node {kind}, root {kind}").withColumn("prior", F.lag("root").over(own))
    met = scratch.save(met.filter("prior is null or prior <> root"), "met")
    first, links = met.filter("prior is null").select("node", "root"), met.filter("prior is not null")
    if links.isEmpty():
        return first.withColumnRenamed("root", "component")
    roots = _rounds(links.select(F.col("root").alias("a"), F.col("prior").alias("b")), scratch).select(F.col("node").alias("root"), "component")
    return first.join(roots, "root", "left").select("node", F.coalesce("component", "root").alias("component"))


def _rounds(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of edges (a, b) without loops.

    Alternating large-star and small-star rounds: each node's larger neighbours
    are tied to its smallest one, then each node and its smaller neighbours to
    the smallest of these. The number of rounds grows with the logarithm of the
    longest path, a round's edges never outnumber the first ones, and each round
    is written to the shared scratch folder, so a lost executor repeats only one.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, step = scratch.save(now, "0"), 0
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step += 1
        then = scratch.save(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), str(step))
        scratch.drop(str(step - 1))
        now, last, mark = then, mark, _mark(then)
        if mark == last:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def undirected(edges: DataFrame) -> DataFrame:
    """Edges with a < b, weights of repeats summed, loops gone."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return edges.filter("a <> b").groupBy(low.alias("a"), high.alias("b")).agg(F.sum("w").alias("w"))


def cut_cost(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: weight between different parts over all weight, 0 if there is none. parts: node, part."""
    e = undirected(edges)
    p = e.join(parts.select(F.col("node").alias("a"), F.col("part").alias("pa")), "a").join(parts.select(F.col("node").alias("b"), F.col("part").alias("pb")), "b")
    severed, total = F.coalesce(F.sum(F.when(F.col("pa") != F.col("pb"), F.col("w"))), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))
    return p.agg(severed.alias("severed"), total.alias("total")).withColumn("cost", F.when(F.col("total") == 0, 0.0).otherwise(F.col("severed") / F.col("total")))


def hubs(edges: DataFrame, peers: int = 3) -> DataFrame:
    """Nodes with at least that many different neighbours."""
    both = undirected(edges).select(F.explode(F.array("a", "b")).alias("node"))  # a pair is one row there
    return both.groupBy("node").agg(F.count("*").alias("peers")).filter(F.col("peers") >= peers)


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes."""
    n = Scratch(edges.sparkSession).save(nodes.select("node").distinct(), "nodes")  # read for both ends
    return edges.join(n, F.col("a") == F.col("node"), "left_anti").join(n, F.col("b") == F.col("node"), "left_anti")


def _placed(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with place: a row's number from 1 in its key. rows are read twice; keys of over CROWDED rows are numbered by a prefix scan."""
    many = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select(F.col(key).alias("__key"))
    many = Scratch(rows.sparkSession).save(many, "crowded")
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long")
    if many.isEmpty():
        return rows.withColumn("place", place)
    same = F.col(key).eqNullSafe(F.col("__key"))
    few = rows.join(F.broadcast(many), same, "left_anti").withColumn("place", place)  # at most a row for each CROWDED rows
    return few.unionByName(scan.number(rows.join(F.broadcast(many), same, "left_semi"), [order], [key], "place"))


def ordered(components: DataFrame) -> DataFrame:
    """components with place: a node's number from 1 in its component, in the order of nodes."""
    return _placed(components, "component", "node").withColumn("place", F.col("place").cast("int"))


def partition_by_class(nodes: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """class, node, place: the different members of each class, numbered from 1 in their order. A class may have any number of members.

    A node among the candidates (node) is peeled off its class into one of its own, which has its name.
    """
    own = nodes.select("class", "node").distinct()
    if candidates is not None:
        peeled = candidates.select("node", F.lit(True).alias("__peeled")).distinct()
        own = own.join(peeled, "node", "left").select(F.when(F.col("__peeled"), F.col("node")).otherwise(F.col("class")).alias("class"), "node").distinct()
    return _placed(Scratch(own.sparkSession).save(own, "own"), "class", "node")


def split_verdict(edges: DataFrame, parts: DataFrame, most: float) -> str:
    """ACCEPT if the parts cover every node and their cut costs at most `most`, else HOLD: when in doubt nothing is split."""
    known = parts.groupBy("node").agg(F.any_value("part").alias("part"), F.count("*").alias("n"), F.lit(True).alias("known"))
    known = Scratch(edges.sparkSession).save(known, "parts")
    if not known.filter("n > 1").isEmpty():
        return "HOLD"
    side = lambda end, part, met: known.select(F.col("node").alias(end), F.col("part").alias(part), F.col("known").alias(met))
    met = edges.filter("a <> b").select("a", "b", "w").join(side("a", "pa", "ka"), "a", "left").join(side("b", "pb", "kb"), "b", "left")
    cut, total = F.sum(F.when(F.col("pa") != F.col("pb"), F.col("w"))), F.sum("w")
    got = met.agg(F.count_if(F.col("ka").isNull() | F.col("kb").isNull()).alias("lost"), F.coalesce(cut, F.lit(0)).alias("severed"), F.coalesce(total, F.lit(0)).alias("total")).first()
    return "ACCEPT" if not got.lost and got.total and got.severed / got.total <= most else "HOLD"
