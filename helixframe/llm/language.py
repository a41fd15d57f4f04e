"""Language identification by bit-sliced Bloom filters over letter trigrams.

One slot array serves all languages: bit l of a slot is the Bloom bit of language
l, so ANDing the slots of a trigram returns at once the bitmask of all languages
that may contain it. A document's per-language popcounts over its trigrams,
corrected for each language's false-positive rate, decide.

The slots are sized by the trigrams that the languages keep. An array of bounded
size is a shard, and trigrams are dealt to shards by a hash. One shard goes to
every task; of several, each streams into the tasks that it is dealt to, ahead of the documents'
trigrams that fall to it, and a document's counts of all shards add up.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from helixframe.llm import worker
from helixframe.llm.rows import ROW, carried, returned, texts
from helixframe.session import Scratch

#: Least slots of a filter (a power of two), slots that a trigram sets, and the false-positive rate that a filter may have for a language.
SLOTS, HASHES, FALSE = 1 << 20, 3, 0.02
#: 64-bit words of the largest shard of a filter.
WORDS = 1 << 22
#: A trigram belongs to a language if its rate there is at least this part of its highest rate.
SHARE = 0.5
NONE = "und"
#: Trigrams of a language that a task holds before it counts them.
PIECE = 1 << 20
#: Slots of a shard in a row, trigrams of a text in a row, trigrams in a batch, and texts that a task remembers to have sent.
CHUNK, LONG, BATCH, SEEN = 1 << 12, 1 << 16, 1 << 20, 1 << 16

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def trigrams(text: str | None) -> np.ndarray:
    """64-bit codes of the trigrams of letters, lower-cased, each run of other characters as one blank; none without a letter.

    Texts of one or two letters give trigrams too, as a blank stands at either end.
    """
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letter_table()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint64)
    blank = codes == 0
    codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
    grams = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    return grams[codes[1:-1] != 0]


def slots(grams: np.ndarray, of: int) -> list[np.ndarray]:
    """The slot numbers, of so many, of each trigram, one array for each hash."""
    h = grams * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(of - 1)).astype(np.int64) for i in range(HASHES)]


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """The shard, of a power of two, of each trigram; its hash is not that of the slots."""
    h = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    return ((h >> np.uint64(32)) & np.uint64(shards - 1)).astype(np.int32)


def slots_needed(most: int) -> int:
    """Slots (a power of two) that hold so many trigrams of a language at a false-positive rate of at most FALSE."""
    least = most * HASHES / -np.log1p(-(FALSE ** (1 / HASHES)))
    return max(SLOTS, 1 << int(np.ceil(np.log2(max(1.0, least)))))


@dataclass
class Model:
    """languages by bit, in order; filter: the mask of each slot, as 64-bit words.

    With over one shard there is no filter, but rows (shard, keys, values): slots and masks of a shard of `size` slots.
    """

    languages: list[str]
    filter: np.ndarray | None
    shards: int = 1
    size: int = 0
    rows: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.filter is not None:
            self.false = (self._bits(self.filter) / len(self.filter)) ** HASHES

    def _bits(self, masks: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        """Masks that have each language's bit, each counted n times."""
        has = ((masks[:, i // 64] & np.uint64(1 << i % 64)) != 0 for i in range(len(self.languages)))
        return np.array([np.count_nonzero(x) if n is None else n[x].sum() for x in has], dtype=float)

    def corrected(self, grams: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        """Trigrams, each counted n times, that each language contains, less the false positives to be expected; may be below 0."""
        a, *more = slots(grams, len(self.filter))
        mask = self.filter[a]
        for b in more:
            mask &= self.filter[b]
        full = self.false >= 1  # such a filter tells nothing
        total = len(grams) if n is None else n.sum()
        return np.where(full, 0, (self._bits(mask, n) - total * self.false) / np.where(full, 1, 1 - self.false))

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Trigrams that each language contains, corrected for false positives."""
        return np.clip(self.corrected(grams), 0, None)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score by the one filter."""
        grams = trigrams(text)
        return self.best(self.counts(grams), len(grams)) if len(grams) and self.languages else (NONE, 0.0)

    def best(self, counts: np.ndarray, n: float) -> tuple[str, float]:
        best = int(counts.argmax())  # ties: the first language
        return self.languages[best], float(min(1.0, counts[best] / n))


def held_out(docs: DataFrame):
    """crc32 of the doc_id as text, mod 4, is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Fit on text and lang of docs; rows with a null in either give nothing.

    All trigrams of all rows are counted. The driver gets one filter of at most
    WORDS words, whatever the corpus holds; several shards stay in a table.
    """

    def count(lang: str, grams: list[np.ndarray]) -> pa.RecordBatch:
        kinds, n = np.unique(np.concatenate(grams), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("language")
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            held: dict[str, int] = {}
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, grams = lang.as_py(), trigrams(text.as_py())
                by.setdefault(lang, []).append(grams)
                held[lang] = held.get(lang, 0) + len(grams)
                if held[lang] > PIECE:
                    yield count(lang, by.pop(lang))
                    held[lang] = 0
            for lang, grams in by.items():
                yield count(lang, grams)

    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = docs.filter("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    words = max(1, -(-len(languages) // 64))
    if not languages:
        return Model(languages, np.zeros((SLOTS, words), np.uint64))
    each = spark.createDataFrame([(lang, i, float(max(1, totals[lang]))) for i, lang in enumerate(languages)], "lang string, bit int, total double")
    rated = counts.join(F.broadcast(each), "lang").select("gram", "bit", (F.col("n") / F.col("total")).alias("rate"), "n")
    best = rated.groupBy("gram").agg(F.collect_list(F.struct("bit", "rate")).alias("all"), F.max("rate").alias("most"), F.sum("n").alias("n"))
    kept = best.select("gram", "n", F.expr(f"transform(filter(all, x -> x.rate >= {SHARE} * most), x -> x.bit)").alias("bits"))
    mask = F.array(*[F.expr(f"aggregate(filter(bits, x -> x div 64 = {w}), 0L, (m, x) -> m | shiftleft(1L, x % 64))") for w in range(words)])
    masks = scratch.save(kept.select("gram", "n", mask.alias("mask"), "bits"), "trigrams")
    scratch.drop("counts")
    of = slots_needed(masks.select(F.explode("bits").alias("bit")).groupBy("bit").count().agg(F.max("count")).first()[0] or 0)
    shards = 1
    while of * words > WORDS * shards and shards < of:
        shards *= 2
    size = of // shards

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy().view(np.uint64)
            shard = pa.array(shard_of(grams, shards))
            for at in slots(grams, size):
                yield pa.RecordBatch.from_arrays([shard, pa.array(at), *batch.columns[1:]], names=["shard", "slot", *names])

    names = [f"mask{w}" for w in range(words)]
    parts = masks.select("gram", *[F.col("mask")[w].alias(name) for w, name in enumerate(names)])
    slotted = parts.mapInArrow(put, "shard int, slot long, " + ", ".join(f"{name} long" for name in names)).groupBy("shard", "slot").agg(*[F.bit_or(name).alias(name) for name in names])
    if shards > 1:
        rows = slotted.groupBy("shard", F.floor(F.col("slot") / CHUNK).alias("chunk")).agg(F.collect_list(F.struct("slot", F.array(*names).alias("mask"))).alias("all"))
        rows = scratch.save(rows.select("shard", F.col("all.slot").alias("keys"), F.flatten("all.mask").alias("values")), "filters")
        scratch.drop("trigrams")
        return Model(languages, None, shards, size, rows)
    filter_ = np.zeros((of, words), np.uint64)
    for batch in slotted.toArrow().to_batches():
        for w in range(words):
            filter_[batch.column(1).to_numpy(), w] |= batch.column(2 + w).to_numpy().view(np.uint64)
    return Model(languages, filter_)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found).view(np.int64)))


def _sharded_counts(docs: DataFrame, model: Model) -> DataFrame:
    """mark and parts: for each part of a text, in a shard, its corrected count of each language and its number of trigrams. docs: mark, text.

    A shard's slots come first into each of its tasks, so a task holds one shard and
    one batch. The number of tasks is spark.sql.shuffle.partitions, and a shard is
    dealt to several where there are fewer shards.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, size, languages = model.shards, model.size, model.languages
    salts, words = max(1, -(-tasks // shards)), max(1, -(-len(languages) // 64))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("language")
        seen: set[str] = set()
        held: list[tuple[int, str, np.ndarray, np.ndarray]] = []
        n_held = 0

        def batch_of() -> pa.RecordBatch:
            shard, mark, grams, n = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(mark), pa.array([int(g.view(np.int64)[0]) for g in grams], pa.int64()), _lists(grams), _lists(n)], names=["shard", "mark", "first", "keys", "values"])

        for batch in batches:
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if mark is None or mark in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(mark)
                grams, n = np.unique(trigrams(text.as_py()), return_counts=True)
                shard = shard_of(grams, shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                for own in np.split(order, cuts) if len(order) else ():
                    for at in range(0, len(own), LONG):
                        some = own[at : at + LONG]
                        held.append((int(shard[some[0]]), mark, grams[some], n[some].astype(np.int64)))
                        n_held += len(some)
                if n_held > BATCH:
                    yield batch_of()
                    held, n_held = [], 0
        if held:
            yield batch_of()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("language")
        at, last, filter_, own = None, None, None, None
        for batch in batches:
            marks, made = [], []
            columns = [batch.column(name).to_pylist() for name in ("shard", "salt", "kind", "mark", "first")]
            for i, (shard, salt, kind, mark, first) in enumerate(zip(*columns, strict=True)):
                if at != (shard, salt):
                    at, filter_, own = (shard, salt), np.zeros((size, words), np.uint64), None
                keys, values = (batch.column(name)[i].values.to_numpy() for name in ("keys", "values"))
                if kind == 0:
                    filter_[keys] = values.view(np.uint64).reshape(-1, words)
                elif (mark, first) != last:  # copies of a text lie side by side
                    own, last = own or Model(languages, filter_), (mark, first)
                    marks.append(mark)
                    made.append([*own.corrected(keys.view(np.uint64), values).tolist(), float(values.sum())])
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array(made, pa.list_(pa.float64()))], names=["mark", "counts"])

    sent = docs.mapInArrow(send, "shard int, mark string, first long, keys array<long>, values array<long>")
    slots_ = model.rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit("").alias("mark"), F.lit(0).cast("long").alias("first"), "keys", "values")
    both = slots_.unionByName(sent.select("shard", F.pmod(F.xxhash64("mark"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "mark", "first", "keys", "values"))
    dealt = both.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "mark", "first")
    return dealt.mapInArrow(count, "mark string, counts array<double>").groupBy("mark").agg(F.collect_list("counts").alias("parts"))


def _judged(docs: DataFrame, model: Model) -> DataFrame:
    """ROW, __lang and __score of each row."""
    text = F.col("text").cast("string")
    if model.shards == 1:
        kept, sent = carried(docs), docs.sparkSession.sparkContext.broadcast((model.languages, model.filter))

        def judge(own: Model, batch: pa.RecordBatch) -> list[tuple[str, float]]:
            return [own.predict(t.as_py()) for t in texts(batch.column(0))]
    else:
        mark = F.md5(text.cast("binary")).alias("mark")
        kept = carried(docs, mark).join(_sharded_counts(docs.select(mark, text.alias("text")), model), "mark", "left").select(ROW, "parts")
        sent = docs.sparkSession.sparkContext.broadcast((model.languages, None))

        def judge(own: Model, batch: pa.RecordBatch) -> list[tuple[str, float]]:
            sums = [[math.fsum(x) for x in zip(*parts, strict=True)] if parts else None for parts in batch.column(1).to_pylist()]  # exact, so that the order of parts doesn't matter
            return [own.best(np.clip(x[:-1], 0, None), x[-1]) if x else (NONE, 0.0) for x in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("language")
        own = Model(*sent.value)
        for batch in batches:
            made = judge(own, batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.float64())], names=[ROW, "__lang", "__score"])

    return kept.mapInArrow(run, StructType([kept.schema[ROW], StructField("__lang", StringType()), StructField("__score", DoubleType())]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs with __lang and __score, which replace columns of these names.

    A null or empty text, or one without a letter, is und with score 0. Ties go to
    the first language in code point order. Texts are used whole, however long.
    Repeated rows are judged alike; an empty table gives no rows.
    """
    found = _judged(docs, model)
    return found.select(*returned(found, "__lang", "__score"))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, and predict every one, as predict() does.

    Rows with a null text or lang teach nothing; a null doc_id is not held out.
    """
    return predict(docs, train(docs.filter(~held_out(docs))))


def known(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of docs, as they are, whose best language holds at least that part of their trigrams; judged as in identify().

    A null or empty text, or one without a letter, goes. All columns return
    whatever their names; repeated rows stay or go together; an empty table, and
    one without any labelled text, gives no rows.
    """
    found = _judged(docs, train(docs.filter(~held_out(docs)))).filter((F.col("__lang") != NONE) & (F.col("__score") >= least_score))
    return found.select(*returned(found))
