"""LM scoring by cross-entropy difference.

A target and a background n-gram model are counted over whole corpora, the
background over all documents and the target over those that are named. They are
matched: both are interpolated models of orders 5, 3 and 1 over bytes, which is
one closed vocabulary for both, so no token is unknown to either; and the counts
of the larger one are scaled to the size of the smaller, so that neither leans on
its lower orders more than the other for want of text. A document is scored by
models that leave its own counts out. Its score is the mean over its tokens of
-log P_target + log P_background; lower is closer to the target.

The table of n-grams grows with the corpus, so it is never broadcast. Documents
are written once as pieces of bounded size; a piece asks for its different
n-grams by a shuffle join, and the answers meet the piece's texts again in one
task. There is this one way at every size, and a lost executor repeats from the
written pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.session import Scratch

ORDER, MIDDLE = 5, 3
#: Tokens that the lower order's estimate counts for at each order.
MASS = 8.0
#: Bytes of text that are counted and scored as one; a longer text comes in parts of this size.
PART = 1 << 20
#: Bytes of text that ask for their n-grams together.
PIECE = 1 << 23

_PARTS = pa.schema(
    [("piece", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("target", pa.bool_()), ("lead", pa.int32()), ("data", pa.binary())]
)
_PARTS_SQL = "piece long, row long, part int, doc_id long, target boolean, lead int, data binary"
_COUNTS = ("b5", "t5", "bc5", "tc5", "b3", "t3", "bc3", "tc3")


def grams(texts: list[bytes], leads: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the texts, and where each text's begin and end.

    A text is begun with zero bytes; its first lead bytes are only context.
    """
    pad = b"\0" * (ORDER - 1)
    data = np.frombuffer(b"".join([pad + t for t in texts]), np.uint8).astype(np.uint64)
    size, lead = np.array([len(t) for t in texts], dtype=np.int64), np.array(leads, dtype=np.int64)
    keys = np.zeros(max(0, len(data) - ORDER + 1), np.uint64)
    for i in range(ORDER):
        keys = (keys << np.uint64(8)) | data[i : i + len(keys)]
    own = np.maximum(size - lead, 0)
    ends = np.concatenate([[0], np.cumsum(own)])
    first = np.cumsum(size + ORDER - 1) - size - (ORDER - 1) + lead
    return keys[np.arange(ends[-1]) + np.repeat(first - ends[:-1], own)], ends


def pieces(docs: DataFrame) -> DataFrame:
    """piece, row, part, doc_id, target, lead, data: the texts of docs (doc_id, text, target) in parts, numbered by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 40
        piece, row, held, out = base, base, 0, []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PARTS, strict=True)], schema=_PARTS)
            out.clear()
            return made

        for batch in batches:
            for doc, text, target in zip(*(c for c in batch.columns), strict=True):
                data = b"" if not text.is_valid else text.as_py().encode("utf-8", "surrogatepass")
                for k, at in enumerate(range(0, max(1, len(data)), PART)):
                    lead = min(at, ORDER - 1)
                    out.append((piece, row, k, doc.as_py(), target.as_py(), lead, data[at - lead : at + PART]))
                    held += len(out[-1][-1])
                    if held >= PIECE:
                        yield flush()
                        piece, held = piece + 1, 0
                row += 1
            if out:
                yield flush()

    return docs.select("doc_id", "text", "target").mapInArrow(run, _PARTS_SQL)


def _chunks(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Columns of rows (..., lead, data), about PART bytes at a time."""
    held, out = 0, []
    for row in rows:
        out.append(row)
        held += len(row[-1])
        if held >= PART:
            yield tuple(zip(*out, strict=True))
            held, out = 0, []
    if out:
        yield tuple(zip(*out, strict=True))


def _columns(table) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in table.columns), strict=True)


def piece_counts(parts: DataFrame) -> DataFrame:
    """piece, gram, b, t: how often each n-gram occurs in a piece, and in its texts of the target.

    A piece that two tasks read gives rows from both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds, times = None, [], []

        def flush() -> pa.RecordBatch:
            both, at = np.unique(np.concatenate(kinds), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(times)).astype(np.int64)
            kinds.clear()
            times.clear()
            own = both >> np.uint64(1)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
            b, t = np.add.reduceat(n, first), np.add.reduceat(n * (both & np.uint64(1)).astype(np.int64), first)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), now)), pa.array(own[first].astype(np.int64)), pa.array(b), pa.array(t)], names=["piece", "gram", "b", "t"])

        for piece, target, lead, data in _chunks(x for batch in batches for x in _columns(batch)):
            at = 0
            while at < len(piece):  # a chunk may hold the end of one piece and the start of the next
                stop = next((i for i in range(at, len(piece)) if piece[i] != piece[at]), len(piece))
                if sum(map(len, kinds)) and piece[at] != now:
                    yield flush()
                now = piece[at]
                keys, ends = grams(data[at:stop], lead[at:stop])
                own, n = np.unique((keys << np.uint64(1)) | np.repeat(np.array(target[at:stop], np.uint64), np.diff(ends)), return_counts=True)
                kinds.append(own)
                times.append(n)
                at = stop
        if sum(map(len, kinds)):
            yield flush()

    return parts.select("piece", "target", "lead", "data").mapInArrow(run, "piece long, gram long, b long, t long")


def counts(by_piece: DataFrame) -> DataFrame:
    """gram, b, t over all pieces."""
    return by_piece.groupBy("gram").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))


def model(both: DataFrame) -> DataFrame:
    """gram and what its two models say of it: counts of the 5-gram, its context, its last 3-gram and that one's context.

    both: gram, b, t. At most 256 n-grams share a context, 65,536 a 3-gram.
    """
    sums = lambda df, key, tag, b="b", t="t": df.groupBy(key).agg(F.sum(b).alias(f"b{tag}"), F.sum(t).alias(f"t{tag}"))
    named = both.select("gram", F.col("b").alias("b5"), F.col("t").alias("t5"), F.shiftright("gram", 8).alias("c5"), F.col("gram").bitwiseAND(F.lit((1 << 8 * MIDDLE) - 1)).alias("g3"))
    threes = sums(named, "g3", "3", "b5", "t5").withColumn("c3", F.shiftright("g3", 8))
    lower = threes.join(sums(threes, "c3", "c3", "b3", "t3"), "c3").drop("c3")
    return named.join(sums(named, "c5", "c5", "b5", "t5"), "c5").join(lower, "g3").select("gram", *_COUNTS)


def _runs(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the sum of n over each run of one key, and the number of each entry's run."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    at = np.flatnonzero(new)
    return np.add.reduceat(n, at) if len(at) else n[:0], np.cumsum(new) - 1


def losses(keys: np.ndarray, ends: np.ndarray, target: np.ndarray, known: np.ndarray, table: np.ndarray, ones: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    """Each text's sum of -log P_target + log P_background over its n-grams, its own counts left out.

    known: sorted n-grams, table their _COUNTS, ones 256 x 2 counts of bytes in
    background and target, scale the factors of their counts.
    """
    row = np.repeat(np.arange(len(ends) - 1, dtype=np.uint64), np.diff(ends))
    both = np.sort((row << np.uint64(8 * ORDER)) | keys)
    m, run = _runs(both, np.ones(len(both)))
    both = both[np.concatenate([[True], run[1:] != run[:-1]])[: len(both)]]
    row, gram = (both >> np.uint64(8 * ORDER)).astype(np.int64), both & np.uint64((1 << 8 * ORDER) - 1)
    context, run = _runs(both >> np.uint64(8), m)
    own = [None, None, context[run], m]  # of the 3-gram, its context, the context, the 5-gram
    three = (row.astype(np.uint64) << np.uint64(8 * MIDDLE)) | (gram & np.uint64((1 << 8 * MIDDLE) - 1))
    order = np.argsort(three, kind="stable")
    for i, shift in ((0, 0), (1, 8)):
        held, run = _runs(three[order] >> np.uint64(shift), m[order])
        own[i] = np.empty(len(m))
        own[i][order] = held[run]
    last = (gram & np.uint64(255)).astype(np.int64)
    alone = np.bincount(row * 256 + last, weights=m, minlength=256 * (len(ends) - 1))[row * 256 + last]
    size = np.diff(ends)[row]
    seen = table[np.searchsorted(known, gram.astype(np.int64))].astype(float)
    total, logs = ones.sum(axis=0), []
    for k, s in enumerate(scale):
        mine = None if k == 0 else target[row].astype(float) if target.any() else 0.0
        of = lambda n, less, mine=mine, s=s: s * (n - less) if mine is None else s * n if isinstance(mine, float) else s * (n - mine * less)
        p = (of(ones[last, k], alone) + MASS / 256) / (of(total[k], size) + MASS)
        p = (of(seen[:, 4 + k], own[0]) + MASS * p) / (of(seen[:, 6 + k], own[1]) + MASS)
        p = (of(seen[:, k], own[3]) + MASS * p) / (of(seen[:, 2 + k], own[2]) + MASS)
        logs.append(np.log(p))
    out = np.zeros(len(ends) - 1)
    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
    if len(at):
        out[row[at]] = np.add.reduceat(m * (logs[0] - logs[1]), at)
    return out


def score(docs: DataFrame, is_target: Column) -> DataFrame:
    """doc_id, n_tokens, score of every row of docs (doc_id, text).

    is_target is a condition on columns of docs that names the rows of the target
    corpus; null is false. A null or empty text has 0 tokens and score 0. Repeated
    rows count as often as they occur and each get a row; only a row's own counts
    are left out of its score. Of a text of over PART bytes, each part of that
    size leaves out its own counts. Without any target, or with an empty one, both
    models are uniform and all scores are 0. An empty docs gives no rows. Columns
    of other names are not read, so none can clash.
    """
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(is_target, F.lit(False)).alias("target"))
    parts = scratch.save(pieces(plain), "parts")
    # pieces are counted once: the rows add up to the model, and are what each piece asks of it
    by_piece = scratch.save(piece_counts(parts), "pieces")
    both = scratch.save(counts(by_piece), "counts")
    ones = np.zeros((256, 2))
    for r in both.groupBy(F.col("gram").bitwiseAND(F.lit(255)).alias("byte")).agg(F.sum("b").alias("b"), F.sum("t").alias("t")).collect():  # at most 256 rows
        ones[r["byte"]] = r["b"], r["t"]
    least = ones.sum(axis=0).min()
    scale = tuple(float(least / n) if n else 0.0 for n in ones.sum(axis=0))
    table = scratch.save(model(both), "model")
    scratch.drop("counts")
    answers = by_piece.select("piece", "gram").join(table, "gram").select("piece", "gram", *_COUNTS)

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        grams_, at = np.unique(known.column("gram").to_numpy(), return_index=True)
        held = np.column_stack([known.column(c).to_numpy()[at] for c in _COUNTS]) if len(at) else np.zeros((0, len(_COUNTS)), np.int64)
        out = []
        for row, part, doc, target, lead, data in _chunks(_columns(texts.select(["row", "part", "doc_id", "target", "lead", "data"]))):
            keys, ends = grams(data, lead)
            total = losses(keys, ends, np.array(target), grams_, held, ones, scale)
            out.append(pa.table([pa.array(row, pa.int64()), pa.array(part, pa.int32()), pa.array(doc, pa.int64()), pa.array(np.diff(ends)), pa.array(total)], names=["row", "part", "doc_id", "n", "total"]))
        return pa.concat_tables(out)

    scored = parts.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(run, "row long, part int, doc_id long, n long, total double")
    # the parts of a long text are added up in their order, so that every run gives the same sum
    whole = scored.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("part", "total"))).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["total"])
    return whole.select("doc_id", "n_tokens", F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).otherwise(0.0).alias("score"))
