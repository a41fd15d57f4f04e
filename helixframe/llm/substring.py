"""Substring dedup: spans of words that also occur earlier are removed.

A window is `length` consecutive words. Windows are matched by suffix automata of
reference shards. The reference is the corpus itself, so sending an automaton of
every shard past every document would cost documents times shards; instead each
span is routed to the one shard that can match it:

1. Every window picks an anchor, the gram of words of least hash in it. Equal
   windows pick equal anchors, so only runs of windows whose anchor occurs twice
   can repeat (anchors are counted over all documents).
2. The words of such a run, a region, go to the shard of its anchor. Equal
   regions are combined before the shuffle, keeping the earliest occurrence, so
   a passage that many documents share is one row of its shard.
3. A shard takes the regions of each anchor in order of occurrence, streams each
   one through the suffix automaton of those before it for its matching
   statistics, and then extends the automaton by it. A window whose statistic
   reaches `length` occurs earlier.
4. The verdicts return to all occurrences, and documents drop the maximal spans.

An anchor with more than GROUP different regions (a passage that begins in very
many contexts) is not held by one task: its windows are dealt by content instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from helixframe.llm import worker
from helixframe.llm.rows import ROW, returned, texts
from helixframe.llm.words import split
from helixframe.session import Scratch

#: Different regions of an anchor that one automaton takes.
GROUP = 4096
_LAST = (1 << 63) - 1
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def gram_size(length: int) -> int:
    """Words of an anchor; a window then holds at most 60 grams."""
    return max(1, length * 2 // 5, length - 59)


def anchor_runs(words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, number of windows) of each maximal run of windows with one anchor."""
    n, k = len(words), gram_size(length)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    gram = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
    order = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    order ^= order >> np.uint64(29)
    span = length - k + 1
    at, width = np.arange(len(order)), 1
    while 2 * width <= span:  # at[i]: the leftmost least gram of the width grams from i
        a, b = at[:-width], at[width:]
        at, width = np.where(order[b] < order[a], b, a), 2 * width
    if width < span:
        a, b = at[: len(at) - (span - width)], at[span - width :]
        at = np.where(order[b] < order[a], b, a)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return order[at[first]], first, np.diff(np.append(first, len(at)))


class SuffixAutomaton:
    """Online suffix automaton over sequences of words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def new_sequence(self) -> None:
        """Later words do not follow on earlier ones."""
        self.last, self.state, self.matched = 0, 0, 0

    def take(self, word) -> int:
        """Length of the longest suffix of the sequence up to word that occurs before; then word is added."""
        nxt, link, size = self.next, self.link, self.size
        v, n = self.state, self.matched
        while v and word not in nxt[v]:
            v = link[v]
            n = size[v]
        if word in nxt[v]:
            v = nxt[v][word]
            n += 1
        self._extend(word)
        while v and size[link[v]] >= n:  # adding the word may have split the state
            v = link[v]
        self.state, self.matched = v, n
        return n

    def _extend(self, word) -> None:
        nxt, link, size = self.next, self.link, self.size
        p = self.last
        if word in nxt[p]:
            q = nxt[p][word]
            self.last = q if size[q] == size[p] + 1 else self._split(p, q, word)
            return
        new = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[p] + 1)
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, q, word)
        self.last = new

    def _split(self, p: int, q: int, word) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy


def repeated_windows(regions: list[bytes], length: int) -> list[int]:
    """For each region, in order of occurrence, the bits of its windows that occur earlier."""
    automaton, out = SuffixAutomaton(), []
    for region in regions:
        words, bits = region.split(b" "), 0
        if len(regions) == 1:
            starts = words[: len(words) - length + 1]
            if len(set(starts)) == len(starts):  # no two windows can be equal
                return [0]
        automaton.new_sequence()
        for i, word in enumerate(words):
            if automaton.take(word) >= length:
                bits |= 1 << (i - length + 1)
        out.append(bits)
    return out


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """d, tag, text and more columns: d is the doc_id, tag 24 bits of the text's hash, which tell rows of one doc_id apart.

    A row without doc_id has a d of its own from its text's hash, from 2**62 upwards.
    """
    of = F.col("text").cast("string")
    mark = F.xxhash64(of)
    d = F.coalesce(F.col("doc_id").cast("long"), mark.bitwiseAND(F.lit(_LAST >> 1)).bitwiseOR(F.lit(1 << 62)))
    return docs.select(d.alias("d"), F.shiftrightunsigned(mark, 40).alias("tag"), of.alias("text"), *more)


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    """anchor, d, at of every run; at holds 24 bits of the text's hash, 32 of the first window, 8 of the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("substring")
        for batch in batches:
            hashes, ids, ats = [], [], []
            for d, tag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                anchor, first, windows = anchor_runs(split(text), length)
                if len(anchor):
                    hashes.append(anchor)
                    ids.append(np.full(len(anchor), d))
                    ats.append((np.uint64(tag) << np.uint64(40)) | (first.astype(np.uint64) << np.uint64(8)) | windows.astype(np.uint64))
            if hashes:
                made = [np.concatenate(hashes).view(np.int64), np.concatenate(ids), np.concatenate(ats).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["anchor", "d", "at"])

    return docs.select("d", "tag", "text").mapInArrow(run, "anchor long, d long, at long")


def _of_rows(rows: DataFrame, *columns: str, name: str) -> DataFrame:
    """d, tag and the different structs of columns of each (d, tag), as an array; copies of a row give one entry."""
    return rows.groupBy("d", F.shiftrightunsigned("at", 40).alias("tag")).agg(F.collect_set(F.struct(*columns)).alias(name))


def _regions(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """anchor, region (its words joined by one space), d, at of every run in runs."""
    listed = _of_rows(runs, "anchor", "at", name="runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("substring")
        for whole in batches:
            for start in range(0, len(whole), 500):
                batch = whole.slice(start, 500)
                out: tuple[list, ...] = ([], [], [], [])
                lists, offsets = batch.column(2).flatten(), batch.column(2).offsets.to_numpy()
                offsets = offsets - offsets[0]
                anchors, ats = lists.field(0).to_numpy(), lists.field(1).to_numpy().view(np.uint64)
                for i, (d, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    words, (lo, hi) = split(text), offsets[i : i + 2]
                    at = ats[lo:hi]
                    first = ((at >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    stop = first + (at & np.uint64(255)).astype(np.int64) + length - 1
                    out[0].extend(anchors[lo:hi].tolist())
                    out[1].extend([b" ".join(words[a:b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)])
                    out[2].extend([d] * len(at))
                    out[3].extend(at.view(np.int64).tolist())
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["anchor", "region", "d", "at"])

    return docs.join(listed, ["d", "tag"]).select("d", "text", "runs").mapInArrow(run, "anchor long, region binary, d long, at long")


def _verdicts(distinct: DataFrame, length: int) -> DataFrame:
    """anchor, region_hash, d, first, bits: bits of the windows of a region's earliest occurrence that occur earlier still.

    distinct: anchor, region, region_hash, d, first, n; no anchor has more than GROUP rows.
    """
    dealt = distinct.repartition("anchor").sortWithinPartitions("anchor", "d", "first").select("anchor", "region", "region_hash", "d", "first", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("substring")
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            bits = repeated_windows([x[1] for x in held], length)
            out.extend((x[0], x[2], x[3], x[4], b) for x, b in zip(held, bits, strict=True) if b or x[5] > 1)
            held.clear()

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 5
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "region_hash", "d", "first", "bits"])
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            yield flush()
        if held:
            close()
            yield flush()

    return dealt.mapInArrow(run, "anchor long, region_hash long, d long, first long, bits long")


def _verdicts_by_content(distinct: DataFrame, length: int) -> DataFrame:
    """As _verdicts, for anchors of any number of regions: each window is compared by its own words."""
    words = distinct.withColumn("words", F.split(F.col("region").cast("string"), " "))
    spread = words.select(
        "anchor", "region_hash", "d", "first", "n",
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.md5(F.array_join(F.slice("words", i, length), " ")))).alias("i", "window"),
    )
    place = F.struct("d", (F.col("first") + F.col("i")).alias("start"))
    least = spread.groupBy("anchor", "window").agg(F.min(place).alias("least"))
    marked = spread.join(least, ["anchor", "window"]).withColumn("bit", F.when(place > F.col("least"), F.expr("shiftleft(1L, i)")).otherwise(F.lit(0).cast("long")))
    return marked.groupBy("anchor", "region_hash", "d", "first").agg(F.bit_or("bit").alias("bits"), F.max("n").alias("n")).filter("bits <> 0 or n > 1").drop("n")


def find_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """d, tag, marks (at, bits) by document: the windows of each run that occur earlier. docs: d, tag, text."""
    if not 1 <= length <= 120:
        raise ValueError("length is 1 to 120 words")
    scratch = Scratch(docs.sparkSession)
    runs = scratch.save(_occurrences(docs, length), "runs")
    twice = runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    # the counts are a table of their own, so that the join can split an anchor that holds many of the runs
    again = scratch.save(runs.join(scratch.save(twice, "twice"), "anchor", "left_semi"), "again")
    scratch.drop("runs")
    scratch.drop("twice")
    regions = scratch.save(_regions(docs, again, length).withColumn("region_hash", F.xxhash64("region")), "regions")
    scratch.drop("again")
    first = F.shiftrightunsigned("at", 8).bitwiseAND(F.lit(0xFFFFFFFF))
    distinct = regions.groupBy("anchor", "region", "region_hash").agg(F.min(F.struct("d", first.alias("first"))).alias("m"), F.count("*").alias("n"))
    distinct = scratch.save(distinct.select("anchor", "region", "region_hash", "m.d", "m.first", "n"), "distinct")
    large = scratch.save(distinct.groupBy("anchor").agg(F.count("*").alias("held")).filter(F.col("held") > GROUP).select("anchor"), "large")
    verdicts = _verdicts(distinct.join(large, "anchor", "left_anti"), length)
    if not large.isEmpty():
        verdicts = verdicts.unionByName(_verdicts_by_content(distinct.join(large, "anchor", "left_semi"), length))
    verdicts = scratch.save(verdicts.withColumnsRenamed({"d": "vd", "first": "vf"}), "verdicts")
    every = F.expr("shiftleft(1L, cast(at & 255 as int)) - 1")
    bits = F.when((F.col("d") == F.col("vd")) & (first == F.col("vf")), F.col("bits")).otherwise(every)
    marked = regions.select("anchor", "region_hash", "d", "at").join(verdicts, ["anchor", "region_hash"]).select("d", "at", bits.alias("bits")).filter("bits <> 0")
    return scratch.save(_of_rows(marked, "at", "bits", name="marks"), "marks")


def _covered(at: np.ndarray, bits: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n words a marked window covers."""
    edge = np.zeros(n + 1, np.int64)
    first = ((at >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for i in range(int((at & np.uint64(255)).max(initial=0))):
        start = first[(bits >> np.uint64(i)) & np.uint64(1) == 1] + i
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:n]) > 0


_ADDED = [StructField("__n_words", LongType()), StructField("__n_removed", LongType()), StructField("__kept", StringType()), StructField("__text", StringType()), StructField("__spans", ArrayType(ArrayType(LongType())))]


def _stripped(docs: DataFrame, length: int) -> DataFrame:
    """ROW and the added columns of remove_repeats()."""
    keyed = _keyed(docs)
    marks = find_repeats(keyed, length)
    both = _keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)).drop("text").join(marks, ["d", "tag"], "left").select(ROW, "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("substring")
        for whole in batches:
            for start in range(0, len(whole), 500):
                batch = whole.slice(start, 500)
                out: list[list] = [[], [], [], [], []]
                for text, marks in zip(texts(batch.column(0)).to_pylist(), batch.column(1), strict=True):
                    words = split(text)
                    gone = np.zeros(len(words), bool)
                    if marks.is_valid:
                        at, bits = (marks.values.field(i).to_numpy().view(np.uint64) for i in (0, 1))
                        gone = _covered(at, bits, len(words), length)
                    removed, kept, left, spans = int(gone.sum()), words, text, []
                    if removed:
                        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                        spans = edge.reshape(-1, 2).tolist()
                        left = _without(text.encode("utf-8", "surrogatepass"), spans).decode("utf-8", "surrogatepass")
                    for column, value in zip(out, (len(words), removed, b" ".join(kept).decode("utf-8", "surrogatepass"), left, spans), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64())))
                made = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[ROW, *(f.name for f in _ADDED)])

    return both.mapInArrow(run, StructType([both.schema[ROW], *_ADDED]))


def remove_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """The columns of docs with what is left of each text.

    Removed is every word covered by a window of `length` consecutive words whose
    words also start earlier: in a smaller doc_id, or earlier in the same
    document; windows are judged on the texts as given. Added columns, which
    replace columns of these names: __n_words, __n_removed, __kept (kept words
    joined by one space), __text (the text without the removed spans; unchanged if
    there are none; null stays null) and __spans (pairs of first and last-plus-one
    word removed).

    A null or empty text has no words; a long text is one row of up to 2**32
    words, used whole. Rows without doc_id come after all others, in the order of
    their text's hash. Rows that share a doc_id are one place: a window is no
    repeat of itself in a repeated row, each of which gives a row; such rows are
    told apart by 24 bits of their text's hash. An empty table gives no rows.
    """
    found = _stripped(docs, length)
    return found.select(*returned(found, *[f.name for f in _ADDED]))


def strip(docs: DataFrame, length: int = 20) -> DataFrame:
    """The rows of docs with their texts less the repeats, found as in remove_repeats(); a row that was nothing else goes.

    n_chars, if there is such a column, follows the text where that changed. All
    other columns return as they are, whatever their names. Null and empty texts
    stay. An empty table gives no rows.
    """
    found = _stripped(docs, length)
    changed = F.col("__n_removed") > 0
    found = found.filter(~changed | (F.col("__n_removed") < F.col("__n_words")))
    kinds = {f.name.lower(): f.dataType for f in docs.schema.fields}
    new = {"text": F.col("__text").cast(kinds["text"])}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(changed, F.length("__text")).otherwise(F.col(ROW).getField("n_chars")).cast(kinds["n_chars"])
    return found.select(*[new.get(c.lower(), F.col(ROW).getField(c)).alias(c) for c in docs.columns])


def _without(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words of the spans; what stood on either side is joined by one space."""
    words = [m.span() for m in _WORD.finditer(text)]
    pieces, at = [], 0
    for first, stop in spans:
        if first > at:
            pieces.append(text[words[at][0] : words[first - 1][1]])
        at = stop
    if at < len(words):
        pieces.append(text[words[at][0] : words[-1][1]])
    return b" ".join(pieces)
