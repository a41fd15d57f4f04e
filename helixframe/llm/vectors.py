"""Vectors as blocks of bytes, and which of them take part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", zero: bool = True) -> DataFrame:
    """id, x (array<double>), dim of the vectors that take part.

    Null ids, null or empty vectors, and vectors with a null or non-finite
    component do not; nor do zero vectors if zero is false.
    """
    x = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x")).filter("id is not null and x is not null and size(x) > 0")
    finite = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = rows.filter(finite)
    if not zero:
        rows = rows.filter(F.exists("x", lambda v: v != 0))
    return rows.withColumn("dim", F.size("x"))


def blocks(rows: DataFrame, size: int, kind: str = "f8") -> DataFrame:
    """dim, block, n, ids, data: up to `size` vectors of one task and dimension, as little-endian bytes.

    rows has id, x, dim. block is unique: the task's number and a count.
    """
    schema = "dim int, block long, n int, ids binary, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        base, count = (task.partitionId() if task else 0) << 32, 0
        held: dict[int, list] = {}

        def close(dim: int) -> pa.RecordBatch:
            nonlocal count
            parts = held.pop(dim)
            ids = np.concatenate([p[0] for p in parts])
            data = np.concatenate([p[1] for p in parts])
            rest = (ids[size:], data[size:])
            if len(rest[0]):
                held[dim] = [rest]
            ids, data = ids[:size], data[:size]
            made = [pa.array([dim], pa.int32()), pa.array([base + count]), pa.array([len(ids)], pa.int32())]
            made += [pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([np.ascontiguousarray(data).astype("<" + kind).tobytes()], pa.binary())]
            count += 1
            return pa.RecordBatch.from_arrays(made, names=["dim", "block", "n", "ids", "data"])

        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            flat, ends = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                data = flat[ends[own][:, None] + np.arange(dim)]
                held.setdefault(dim, []).append((ids[own], data))
                while sum(len(p[0]) for p in held.get(dim, ())) >= size:
                    yield close(dim)
        for dim in list(held):
            while dim in held:
                yield close(dim)

    return rows.select("id", "x", "dim").mapInArrow(run, schema)


def matrix(data: bytes, dim: int, kind: str = "f8") -> np.ndarray:
    return np.frombuffer(data, "<" + kind).reshape(-1, dim)
