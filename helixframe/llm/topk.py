"""Exact top-k inner-product search by ball trees and branch and bound.

Vectors become integers floor(scale * x). Candidates stand in shards of bounded
size, queries in blocks of bounded size; a lane is a bounded number of shards,
and every block of queries passes through every lane. A task builds the ball tree
of a shard once, visits the nodes for each query in the order of their
upper bound <q, centre> + |q| * radius, and stops at the query's current kth
score. All tasks share a first one, the kth score among a bounded sample of the
candidates, and each carries it on from shard to shard of its lane.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm import vectors

SHARD, BLOCK, LANE, LEAF = 2048, 256, 4, 16
#: Candidates of each dimension that every task holds for the first kth score.
SAMPLE = 4096


class BallTree:
    """A ball tree over the rows of x; `order` lists them leaf by leaf."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, last row plus one, children or -1
        self._split(x, 0, len(x))
        centres, radii = [], []
        self.x = x[self.order]
        for first, stop, _, _ in self.nodes:
            part = self.x[first:stop]
            c = part.mean(axis=0)
            centres.append(c)
            radii.append(np.sqrt(((part - c) ** 2).sum(axis=1).max()))
        self.centres, self.radii = np.array(centres), np.array(radii)

    def _split(self, x: np.ndarray, first: int, stop: int) -> int:
        at = len(self.nodes)
        self.nodes.append((first, stop, -1, -1))
        part = x[self.order[first:stop]]
        if stop - first > LEAF:
            # two rows far apart share the others, or the rows are halved along their line
            a = part[((part - part.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            along = part @ (b - a)
            middle = int((along <= (a + b) @ (b - a) / 2).sum())
            if not 0.1 * len(part) <= middle <= 0.9 * len(part):
                middle = len(part) // 2
            self.order[first:stop] = self.order[first:stop][np.argsort(along, kind="stable")]
            left, right = self._split(x, first, first + middle), self._split(x, first + middle, stop)
            self.nodes[at] = (first, stop, left, right)
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query with the rows of each node, not below them after rounding."""
        norm = np.sqrt((queries**2).sum(axis=1))
        upper = queries @ self.centres.T + norm[:, None] * self.radii
        return upper + 1e-9 * (np.abs(upper) + norm[:, None] * (1 + np.abs(self.centres).max(initial=0)))

    def least_bounds(self, upper: np.ndarray) -> np.ndarray:
        """The smallest bound of each node's leaves: where none can be left out, a node is scored as a whole."""
        low = upper.copy()
        for at in range(len(self.nodes) - 1, -1, -1):  # children stand after their parents
            _, _, left, right = self.nodes[at]
            if left >= 0:
                low[:, at] = np.minimum(low[:, left], low[:, right])
        return low


def _search(tree: BallTree, ids: np.ndarray, query: np.ndarray, own: int, bound: np.ndarray, low: np.ndarray, k: int, floor: float, top: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The query's k best (scores, ids) of top and the tree; its kth score over all candidates is floor at least."""
    scores, names = top
    heap = [(-bound[0], 0)]
    while heap:
        upper, node = heapq.heappop(heap)
        least = max(floor, scores[-1]) if len(scores) == k else floor
        if -upper < least:  # an equal bound may hide a tie with a smaller id
            break
        first, stop, left, right = tree.nodes[node]
        if left >= 0 and low[node] < least:
            heapq.heappush(heap, (-bound[left], left))
            heapq.heappush(heap, (-bound[right], right))
            continue
        s = tree.x[first:stop] @ query
        some = ids[first:stop]
        good = (some != own) & (s >= least)
        if good.any():
            scores, names = np.concatenate([scores, s[good]]), np.concatenate([names, some[good]])
            keep = np.lexsort((names, -scores))[:k]
            scores, names = scores[keep], names[keep]
    return scores, names


def first_floors(queries: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """The kth score of each query among the sample's rows that are not its own; minus infinity with fewer."""
    scores = queries @ sample.T
    scores[ids[:, None] == sample_ids[None]] = -np.inf
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] >= k else np.full(len(queries), -np.inf)


def _pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every block of queries beside every shard of its lane, block by block."""
    shards = vectors.blocks(candidates, SHARD).select("dim", F.col("block").alias("shard"), F.col("ids").alias("shard_ids"), F.col("data").alias("shard_data"))
    lanes = max(1, -(-shards.select("shard").count() // LANE))
    shards = shards.withColumn("lane", F.pmod(F.xxhash64("shard"), F.lit(lanes)).cast("int"))
    asked = vectors.blocks(queries, BLOCK).select("dim", "block", "ids", "data", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    return asked.join(shards, ["dim", "lane"]).sortWithinPartitions("lane", "block", "shard")


def search(table: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query with every other row.

    is_query is a condition on id. Vectors are floor(scale * x) in integers, the
    score is exact. Ties go to the smaller vec_id; with fewer candidates all are
    given. Vectors that are null, empty, or hold a null or non-finite component
    take no part; vectors of different length do not meet. A query's own row is
    every row of its id; of several vectors under one query's id the least one
    asks. Repeated candidates each count. Scores are exact up to 2**53. An empty
    table gives no rows. Other columns are not read, so none can clash.
    """
    rows = vectors.valid(table, id_col, vector_col)
    rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(v * scale).cast("double")))
    queries = rows.filter(is_query).groupBy("id").agg(F.min(F.struct("dim", "x")).alias("q")).select("id", "q.x", "q.dim")
    pairs = _pairs(queries, rows)
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in [r["dim"] for r in rows.select("dim").distinct().collect()]:
        some = rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE).select("id", "x").toArrow()
        held[dim] = np.asarray(some["x"].combine_chunks().flatten()).reshape(-1, dim), some["id"].to_numpy()
    sent = table.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: OrderedDict[int, tuple[BallTree, np.ndarray]] = OrderedDict()
        block, tops, asked, floors = None, [], np.zeros(0, np.int64), np.zeros(0)

        def give() -> pa.RecordBatch:
            q = np.repeat(asked, [len(t[0]) for t in tops]) if tops else asked[:0]
            s = np.concatenate([t[0] for t in tops]) if tops else np.zeros(0)
            v = np.concatenate([t[1] for t in tops]) if tops else asked[:0]
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s.astype(np.int64))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                at = (row["dim"], row["lane"], row["block"])
                if at != block:
                    if block is not None:
                        yield give()
                    block, asked = at, np.frombuffer(row["ids"], "<i8")
                    tops = [(np.zeros(0), np.zeros(0, np.int64))] * len(asked)
                    floors = first_floors(vectors.matrix(row["data"], row["dim"]), asked, *sent.value[row["dim"]], k)
                if row["shard"] not in trees:
                    tree = BallTree(vectors.matrix(row["shard_data"], row["dim"]))
                    trees[row["shard"]] = tree, np.frombuffer(row["shard_ids"], "<i8")[tree.order]
                    if len(trees) > 2 * LANE:
                        trees.popitem(last=False)
                tree, ids = trees[row["shard"]]
                queries = vectors.matrix(row["data"], row["dim"])
                bounds = tree.bounds(queries)
                lows = tree.least_bounds(bounds)
                tops = [_search(tree, ids, *x[:4], k, *x[4:]) for x in zip(queries, asked.tolist(), bounds, lows, floors.tolist(), tops, strict=True)]
        if block is not None:
            yield give()

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
