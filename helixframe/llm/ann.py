"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector by m Gaussian projections cut into cells of
one width. A query visits its own bucket and perturbed ones in the order of their
estimated success, the sum of squared distances to the crossed cell walls. What
all tables give is ranked again by the exact inner product. Largest inner product
becomes smallest distance by one more coordinate, sqrt(M^2 - |x|^2), which is 0
for vectors of one norm.

m, the width and the number of probes are fitted on a bounded sample: of all
shapes that find TARGET of the sample's true neighbours, the one that costs a
query least, by the probes it sends and the rows of the whole table that it then
meets. So buckets get finer as the table grows. Every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm import vectors
from helixframe.session import Scratch

TABLES = 2
#: Projections of a table and widths of a cell (in the largest norm) that are tried, and most projections that a probe moves.
SHAPES, MOVED = tuple((m, w) for m in (1, 2, 3, 4, 6, 8, 12) for w in (0.7, 1.0, 1.4, 2.0)), 3
#: Rows of the sample, its queries, and the share of neighbours to find.
SAMPLE, SAMPLE_QUERIES, TARGET = 4096, 160, 0.95
#: Comparisons that take as long as sending one probe.
PROBE = 100
#: A cell compares at most this many vectors and queries; larger buckets are dealt out as several cells.
VECTORS, QUERIES = 8192, 2048
SEED = 20240101


class Hashes:
    """The projections of all tables for vectors of one dimension (with the added coordinate)."""

    def __init__(self, dim: int, norm: float, m: int, width: float):
        rng = np.random.default_rng([SEED, dim, m])
        self.m, self.norm, self.width = m, norm, width * norm
        self.a = rng.standard_normal((dim + 1, TABLES * m))
        self.b = rng.random(TABLES * m) * self.width

    def place(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Positions in cells, n x TABLES x m; the whole part is the cell. A query has no added coordinate."""
        last = np.zeros(len(x)) if query else np.sqrt(np.clip(self.norm**2 - (x**2).sum(axis=1), 0, None))
        return ((np.column_stack([x, last]) @ self.a + self.b) / self.width).reshape(-1, TABLES, self.m)


def moves(m: int) -> np.ndarray:
    """The perturbations of m coordinates by -1 or 1 that move at most MOVED of them; none first."""
    out = [np.zeros(m, np.int64)]
    for n in range(1, min(MOVED, m) + 1):
        for where in combinations(range(m), n):
            for step in product((-1, 1), repeat=n):
                out.append(np.zeros(m, np.int64))
                out[-1][list(where)] = step
    return np.array(out)


def ranked(frac: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Numbers of the moves in the order of success, n x moves, from the parts within cells, n x m.

    Crossing the lower wall costs frac**2, the upper one (1 - frac)**2; a bucket costs the sum.
    """
    cost = (frac**2) @ (by < 0).T + ((1 - frac) ** 2) @ (by > 0).T
    return np.argsort(cost, axis=1, kind="stable")


def bucket(t: int, cells: np.ndarray) -> np.ndarray:
    """One number for each cell of table t; two cells may share one, which only adds candidates."""
    h = np.full(cells.shape[:-1], t + 1, np.uint64)
    for i in range(cells.shape[-1]):
        h = (h ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def fit(x: np.ndarray, norm: float, k: int, rows: int) -> tuple[int, float, int, float]:
    """(m, width, probes, share of the rows that a query meets) for a table of that many rows, from a sample of them.

    The k nearest of all rows are as near as the k * sample / rows nearest of the sample.
    """
    asked = np.linspace(0, len(x) - 1, min(SAMPLE_QUERIES, len(x))).astype(int)
    k = min(max(1, round(k * len(x) / max(1, rows))), len(x) - 1)
    if k < 1:
        return 1, SHAPES[0][1], len(moves(1)), 1.0
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    best = None
    for m, width in SHAPES:
        hashes, by = Hashes(x.shape[1], norm, m, width), moves(m)
        power = (3 ** np.arange(m)).astype(np.float32)  # codes of up to 3**12 are whole numbers in 32-bit floats
        codes = ((by + 1) @ power).astype(np.int64)
        order = np.argsort(codes)
        at, cells = hashes.place(x[asked], True), np.floor(hashes.place(x, False)).astype(np.float32)
        ranks = []
        for t in range(TABLES):
            own = np.floor(at[:, t])
            step = cells[None, :, t] - own[:, None].astype(np.float32)
            close = (np.abs(step) <= 1).all(axis=2)
            code = ((np.clip(step, -1, 1) + 1) @ power).astype(np.int64)
            found = np.minimum(np.searchsorted(codes[order], code), len(codes) - 1)
            hit = close & (codes[order][found] == code)
            rank = np.empty((len(asked), len(by)), np.int64)
            np.put_along_axis(rank, ranked(at[:, t] - own, by), np.arange(1, len(by) + 1)[None], axis=1)
            ranks.append(np.where(hit, np.take_along_axis(rank, order[found], axis=1), len(by) + 1))
        first = np.take_along_axis(np.minimum.reduce(ranks), near, axis=1).ravel()
        probes = int(np.sort(first)[min(first.size - 1, int(np.ceil(TARGET * first.size)) - 1)])
        lost = probes > len(by)
        probes = min(probes, len(by))
        met = np.mean([(r <= probes).mean() for r in ranks]) * TABLES
        cost = (lost, met * rows + PROBE * TABLES * probes)
        if best is None or cost < best[0]:
            best = cost, (m, width, probes, float(np.mean(np.logical_or.reduce([r <= probes for r in ranks]))))
    return best[1]


def search(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for each query among all other rows.

    is_query is a condition on id. score is the double-precision inner product of
    the original vectors. Ties go to the smaller vec_id. Vectors that are null,
    empty, zero, or hold a null or non-finite component take no part; vectors of
    different length do not meet. A query's own row is every row of its id; of
    several vectors under one query's id the least one asks. Repeated rows each
    count as candidates. Every query gets k rows, or all candidates if fewer: one
    that meets fewer in its buckets is given the sample's nearest besides. An empty table gives no rows. Other columns are not read,
    so none can clash.
    """
    scratch = Scratch(table.sparkSession)
    kind = "f4" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "f8"
    rows = vectors.valid(table, id_col, vector_col, zero=False)
    if kind == "f4":
        rows = rows.withColumn("x", F.col("x").cast("array<float>"))
    rows = scratch.save(rows.select(F.monotonically_increasing_id().alias("key"), "id", "x", "dim"), "vectors")
    square = F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v)
    sizes = {r["dim"]: r for r in rows.groupBy("dim").agg(F.max(square).alias("most"), F.count("*").alias("n")).collect()}
    plans: dict[int, tuple[float, tuple, tuple[np.ndarray, ...]]] = {}
    for dim, r in sizes.items():
        sample = rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id", "key").limit(SAMPLE).select("id", "key", F.col("x").cast("array<double>").alias("x")).toArrow()
        norm = float(np.sqrt(r["most"])) * (1 + 1e-12)
        x = np.asarray(sample["x"].combine_chunks().flatten()).reshape(-1, dim)
        plans[dim] = norm, fit(x, norm, k, r["n"]), (sample["id"].to_numpy(), x, sample["key"].to_numpy())
    sent = table.sparkSession.sparkContext.broadcast(plans)  # at most SAMPLE vectors of each length

    def spread(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = {d: (Hashes(d, norm, m, width), moves(m), probes, sample) for d, (norm, (m, width, probes, _), sample) in sent.value.items()}
            for whole in batches:
                for at in range(0, len(whole), 1000):
                    batch = whole.slice(at, 1000)
                    keys, ids, dims = (batch.column(i).to_numpy() for i in (0, 1, 3))
                    flat, ends = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy().astype(np.int64)
                    ends = ends - ends[0]
                    for dim in np.unique(dims).tolist():
                        own = np.flatnonzero(dims == dim)
                        hashes, by, probes, (near_ids, near, _) = made[dim]
                        raw = flat[ends[own][:, None] + np.arange(dim)]
                        x = raw.astype(np.float64)
                        place = hashes.place(x, query)
                        cells = np.floor(place).astype(np.int64)
                        data = np.array([v.tobytes() for v in np.ascontiguousarray(raw).astype("<" + kind)], dtype=object)
                        floor = _floors(ids[own], x, near_ids, near, k) if query else np.full(len(own), np.nan)
                        for t in range(TABLES):
                            moved = cells[:, t, None] + by[ranked(place[:, t] - cells[:, t], by)[:, :probes]] if query else cells[:, t, None]
                            n = moved.shape[1]
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(np.full(len(own) * n, dim, np.int32)), pa.array(bucket(t, moved).ravel()), pa.array(np.repeat(keys[own], n)),
                                    pa.array(np.repeat(ids[own], n)), pa.array(np.repeat(data, n), pa.binary()), pa.array(np.repeat(floor, n)),
                                ],
                                names=["dim", "bucket", "key", "id", "data", "floor"],
                            )

        return run

    schema = "dim int, bucket long, key long, id long, data binary, floor double"
    least = rows.filter(is_query).groupBy("id", "dim").agg(F.min(F.struct("x", "key")).alias("v"))
    queries = least.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("q.v.key", "id", "q.v.x", "q.dim")
    queries = scratch.save(queries, "queries")
    found = scratch.save(_compared(rows.select("key", "id", "x", "dim").mapInArrow(spread(False), schema), queries.mapInArrow(spread(True), schema), k, kind), "found")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, x, dim in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                ids, near, keys = sent.value[dim][2]
                scores = (np.asarray(x.values, dtype=np.float64)[None] * near).sum(axis=1)
                at = np.flatnonzero(ids != name)
                at = at[np.lexsort((keys[at], ids[at], -scores[at]))[:k]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name)), pa.array(ids[at]), pa.array(keys[at]), pa.array(scores[at])], names=["query_id", "vec_id", "key", "score"])

    # a query whose buckets hold fewer than k rows gets the best of the sample besides
    full = found.groupBy(F.col("query_id").alias("id")).agg(F.count_distinct("key").alias("n")).filter(F.col("n") >= k)
    rest = queries.join(full, "id", "left_anti").select("key", "id", "x", "dim").mapInArrow(sampled, "query_id long, vec_id long, key long, score double")
    found = found.unionByName(rest).groupBy("query_id", "vec_id", "key").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floors(ids: np.ndarray, x: np.ndarray, near_ids: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """A bound that each query's k-th score is not below: the k-th among the sample's rows, less what rounding may add."""
    scores = x @ near.T
    scores[ids[:, None] == near_ids[None]] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(x), -np.inf)
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return kth - 1e-9 * (1 + np.abs(kth))


def _compared(index: DataFrame, asked: DataFrame, k: int, kind: str) -> DataFrame:
    """query_id, vec_id, key, score: of each task's pairs that share a bucket, the best k of each query not below its floor."""
    at = ["dim", "bucket"]
    held = index.groupBy(*at).agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("v_cells"))
    wanted = asked.groupBy(*at).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q_cells"))
    cells = held.join(wanted, at)
    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    run_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = index.join(cells, at).select(*at, part("v_cells").alias("i"), run_of("q_cells").alias("j"), F.lit(1).alias("side"), "key", "id", "data", "floor")
    q = asked.join(cells, at).select(*at, run_of("v_cells").alias("i"), part("q_cells").alias("j"), F.lit(0).alias("side"), "key", "id", "data", "floor")
    dealt = q.unionByName(v).repartition(*at, "i", "j").sortWithinPartitions(*at, "i", "j", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Best(k)
        now, keys, ids, rows_, floors = None, [], [], [], []

        def close() -> None:
            n = len(floors)
            if 0 < n < len(ids):
                x = np.frombuffer(b"".join(rows_), "<" + kind).reshape(len(ids), -1).astype(np.float64)
                names = np.array(ids)
                state.add(names[:n], x[:n], np.array(floors), names[n:], np.array(keys[n:]), x[n:])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for dim, b, i, j, side, key, name, data, floor in zip(*columns, strict=True):
                if (dim, b, i, j) != now:
                    close()
                    now, keys, ids, rows_, floors = (dim, b, i, j), [], [], [], []
                keys.append(key)
                ids.append(name)
                rows_.append(data)
                if side == 0:
                    floors.append(floor)
            if state.full():
                yield state.give()
        close()
        yield state.give()

    return dealt.mapInArrow(compare, "query_id long, vec_id long, key long, score double")


class _Best:
    """The best candidates of each query that a task has met; given out and forgotten when many queries are held."""

    LIMIT = 2_000_000

    def __init__(self, k: int):
        self.k = k
        self._clear()

    def _clear(self) -> None:
        self.floor: dict[int, float] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = self.packed = 0

    def full(self) -> bool:
        return self.packed > self.LIMIT // 2

    def add(self, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, v_ids: np.ndarray, v_keys: np.ndarray, v: np.ndarray) -> None:
        """Compare all q with all v. least: scores below which a query wants none."""
        least = np.maximum(least, [self.floor.get(i, -np.inf) for i in q_ids.tolist()])
        rough = q @ v.T
        slack = 1e-9 * (1 + np.abs(rough).max())
        i, j = np.nonzero(rough >= (least - slack)[:, None])
        some = q_ids[i] != v_ids[j]
        i, j = i[some], j[some]
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            exact = (q[a] * v[b]).sum(axis=1)  # one order of additions for every pair, unlike a matrix product
            good = exact >= least[a]
            self.parts.append((q_ids[a][good], v_ids[b][good], v_keys[b][good], exact[good]))
        self.held += len(i)
        if self.held > self.packed + 200_000:
            self._pack()

    def _pack(self) -> None:
        if not self.parts:
            return
        query, name, key, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((key, name, -score, query))
        query, name, key, score = query[order], name[order], key[order], score[order]
        once = np.concatenate([[True], (query[1:] != query[:-1]) | (key[1:] != key[:-1])])[: len(query)]  # other tables gave it too
        query, name, key, score = query[once], name[once], key[once], score[once]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])[: len(query)])
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        full = np.flatnonzero(rank == self.k - 1)
        self.floor.update(zip(query[full].tolist(), score[full].tolist(), strict=True))
        keep = rank < self.k
        self.parts, self.held, self.packed = [(query[keep], name[keep], key[keep], score[keep])], int(keep.sum()), int(keep.sum())

    def give(self) -> pa.RecordBatch:
        self._pack()
        empty = np.zeros(0, np.int64)
        query, name, key, score = self.parts[0] if self.parts else (empty, empty, empty, np.zeros(0))
        self._clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query, name, key)] + [pa.array(score, pa.float64())], names=["query_id", "vec_id", "key", "score"])
