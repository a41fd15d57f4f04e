"""Search of notes: stems, positional postings kept in segments that are merged, phrases and ranks.

An index is a row for the newest change of each note, with its stems, their counts
and places; `postings` (term, id, seq, n, positions, size) and `heads` (id, seq,
live, size) are views of it. A batch of changes makes an index of its own; merge()
puts indexes together and lets only each note's newest change live, so a note is
updated or deleted by adding a change, and no posting is ever rewritten in place.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from helixframe.session import Scratch

#: Suffixes and what takes their place, steps 2 to 4 of Porter's stemmer (fixed values).
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Weights of term frequency and of length, and the least weight of a term (fixed values of the ranking).
K1, B, LEAST = 1.2, 0.75, 1e-6

#: Words of a shard of notes, and different queries of a block, that a search holds at once.
SHARD, BLOCK = 1 << 22, 1 << 16

TOKEN = r"([\p{L}\p{N}]+)"


class Index(NamedTuple):
    entries: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(term, id, seq, n, positions, size): each stem of each live note."""
        each = F.explode(F.arrays_zip("terms", "counts", "places")).alias("e")
        return self.entries.filter("live").select("id", "seq", "size", each).select(F.col("e.terms").alias("term"), "id", "seq", F.col("e.counts").alias("n"), F.col("e.places").alias("positions"), "size")

    @property
    def heads(self) -> DataFrame:
        """(id, seq, live, size): the newest change of each note."""
        return self.entries.select("id", "seq", "live", "size")

    def saved(self, scratch: Scratch) -> Index:
        """The same index, written once to be read several times."""
        return Index(scratch.save(self.entries, "index"))


V, K = "[aeiouy]", "[^aeiouy]"
OVER0, OVER1, JUST1, SHORT = (re.compile(p) for p in (f"{K}*{V}+{K}", f"{K}*{V}+{K}+{V}+{K}", f"{K}*{V}+{K}+{V}*$", f".*{K}{V}[^aeiouywxY]$"))


@functools.lru_cache(1 << 16)
def stem(word: str | None) -> str | None:
    """Porter's stem of a lower-case word. Words of under three letters, and words with other characters than a to z, are their own stems.

    A y that is a consonant is written Y on the way, so that a class of letters tells vowels.
    """
    if word is None or not re.fullmatch("[a-z]{3,}", word):
        return word
    w = re.sub(f"(^|{V})y", r"\1Y", word)

    def parted(suffixes) -> tuple[str, str]:
        end = max((s for s in suffixes if w.endswith(s)), key=len, default="")
        return w[: len(w) - len(end)], end

    t, s = parted(("sses", "ies", "ss", "s"))
    w = t + {"sses": "ss", "ies": "i", "ss": "ss"}.get(s, "")
    t, s = parted(("eed", "ed", "ing"))
    if s == "eed":
        w = t + "ee" if OVER0.match(t) else w
    elif s and re.search(V, t):
        if t.endswith(("at", "bl", "iz")) or (JUST1.match(t) and SHORT.match(t)):
            w = t + "e"
        else:
            w = t[:-1] if re.search(r"([^aeiouylsz])\1$", t) else t
    if w[-1:] in ("y", "Y") and re.search(V, w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        t, s = parted(table)
        if s and OVER0.match(t):
            w = t + table[s]
    t, s = parted(STEP4)
    if s and OVER1.match(t) and (s != "ion" or t.endswith(("s", "t"))):
        w = t
    t = w[:-1]
    if w.endswith("e") and (OVER1.match(t) or (JUST1.match(t) and not SHORT.match(t))):
        w = t
    if w.endswith("ll") and OVER1.match(w):
        w = w[:-1]
    return w.lower()


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stemmed(words: DataFrame, word: str, name: str = "stem") -> DataFrame:
    """words with the stem of a column of lower-case words; null stays null."""
    return words.withColumn(name, _stems(F.col(f"`{word}`")))


def terms(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, position, term) of each word: runs of letters and digits, lower-case, as stems. A null or wordless text gives none."""
    words = F.posexplode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), 1))
    return stemmed(texts.select(*keys, words.alias("position", "word")), "word", "term").select(*keys, "position", "term")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, seq, live, size, and the stems of each note with their counts and places, from (id, seq, live, words)."""
    for batch in batches:
        words = batch.column(3)
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
        code = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        note = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = note * max(len(stems.dictionary), 1) + code
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        bounds = np.append(first, len(key)).astype(np.int32)
        held = np.concatenate([[0], np.cumsum(np.bincount(note[order][first], minlength=len(sizes)))]).astype(np.int32)
        lists = [stems.dictionary.take(pa.array(code[order][first])), pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(bounds, pa.array(at[order].astype(np.int32)))]
        columns = [*batch.columns[:3], pa.array(sizes), *[pa.ListArray.from_arrays(held, x) for x in lists]]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "seq", "live", "size", "terms", "counts", "places"])


def build(changes: DataFrame) -> Index:
    """The index of a batch of changes (id, seq, op, text); op is insert, update or delete, and of a note's changes that of highest seq counts.

    Rows without id or seq are left out. Changes that agree in id and seq are one
    change: a deletion before others, then the greatest text. A note's words are
    stemmed and gathered where its text is, so they are never shuffled one by one.
    """
    known = changes.filter("id is not null and seq is not null")
    ranked = known.groupBy("id").agg(F.max(F.struct("seq", (F.col("op") == "delete").alias("gone"), "text")).alias("r"))
    newest = ranked.select("id", "r.seq", (~F.coalesce("r.gone", F.lit(False))).alias("live"), "r.text")
    words = F.when(F.col("live"), F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 1))
    schema = f"id {dict(known.dtypes)['id']}, seq {dict(known.dtypes)['seq']}, live boolean, size long, terms array<string>, counts array<long>, places array<array<int>>"
    return Index(newest.select("id", "seq", "live", words.alias("words")).mapInArrow(_entries, schema))


def merge(*parts: Index, compact: bool = False) -> Index:
    """One index of several, in any order; compact forgets deleted notes, so do it only with all segments that hold them."""
    entries = parts[0].entries
    for p in parts[1:]:
        entries = entries.unionByName(p.entries)
    newest = F.max_by(F.struct("terms", "counts", "places"), F.struct("seq", "live", "size")).alias("e")
    merged = entries.groupBy("id").agg(F.max(F.struct("seq", "live", "size")).alias("r"), newest).select("id", "r.*", "e.*")
    return Index(merged.filter("live") if compact else merged)


def _weight(total: int, df: Column) -> Column:
    idf = F.ln((total - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(F.lit(LEAST))


def _asked(queries: DataFrame, every: Callable[[str], Column], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(query_id, units) of each query with a word, and (ask, units) of the different ones: queries that ask alike are searched once."""
    asked = scratch.save(every(terms(queries, ["query_id"], "text")), "asked")
    return asked, scratch.save(asked.select("units").distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")


def _answers(best: DataFrame, asks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, hits, score of the k best of (ask, id, hits, score), for each query that asks so."""
    order = Window.partitionBy("ask").orderBy("score", "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asks, "ask").join(asked, "units").select("query_id", "rank", "id", "hits", "score")


def _cell(total: int, words: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best notes of a shard (id, size, terms, counts) for each ask (ask, units, weights): ask, id, hits, score; smaller is better."""

    def run(asks: pa.Table, notes: pa.Table) -> pa.Table:
        notes = notes.take(pc.sort_indices(notes.column("id"))).combine_chunks()  # so that the order of rows is that of ids
        ids = notes.column("id").combine_chunks()
        held = pc.list_value_length(notes.column("terms")).to_numpy()
        coded = pc.dictionary_encode(pc.list_flatten(notes.column("terms")).combine_chunks())
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
        note, tf = np.repeat(np.arange(len(held)), held)[order], pc.list_flatten(notes.column("counts")).to_numpy()[order]
        length = K1 * (1 - B + B * notes.column("size").to_numpy() * total / words)
        number = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        out: list[tuple[np.ndarray, ...]] = []
        for ask, units, weights in zip(*(asks.column(c).to_pylist() for c in ("ask", "units", "weights")), strict=True):
            codes = [number.get(u, -1) for u in units]
            if min(codes) < 0:
                continue
            spans = sorted((ends[c] - (ends[c - 1] if c else 0), ends[c - 1] if c else 0, ends[c], w) for c, w in zip(codes, weights, strict=True))
            found = note[spans[0][1] : spans[0][2]]
            for _, s, e, _ in spans[1:]:
                at = np.minimum(np.searchsorted(note[s:e], found), e - s - 1)
                found = found[note[s:e][at] == found]
            if not len(found):
                continue
            score, hits = np.zeros(len(found)), np.zeros(len(found), np.int64)
            for _, s, e, w in spans:
                n = tf[s:e][np.searchsorted(note[s:e], found)]
                score += w * n * (K1 + 1) / (n + length[found])
                hits += n
            score = -np.floor(score * 1e9 + 0.5) / 1e9
            if len(found) > k:
                near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
                near = near[np.lexsort((found[near], score[near]))[:k]]
                found, score, hits = found[near], score[near], hits[near]
            out.append((np.full(len(found), ask), found, hits, score))
        ask, found, hits, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"ask": ask, "id": ids.take(pa.array(found)), "hits": hits, "score": score})

    return run


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best notes that hold every stem of each query (query_id, text): query_id, rank, id, hits, score. A wordless query finds none.

    Notes are dealt into shards of some SHARD words and the different queries into
    blocks of BLOCK; each pair of them is one group, which gives a query's k best
    of its notes, so what a query meets is never a row each.
    """
    scratch = Scratch(queries.sparkSession)
    index = index.saved(scratch)
    asked, asks = _asked(queries, lambda t: t.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("units")), scratch)
    live = index.entries.filter("live")
    total, words = live.agg(F.count("*"), F.sum("size")).first()
    df = live.select(F.explode("terms").alias("unit")).groupBy("unit").agg(F.count("*").alias("df"))
    each = asks.select("ask", F.size("units").alias("n"), F.explode("units").alias("unit")).join(df, "unit")
    pair = F.struct("unit", _weight(total, F.col("df")).alias("weight"))
    weighed = each.groupBy("ask", "n").agg(F.array_sort(F.collect_list(pair)).alias("u")).filter("size(u) = n")
    shards, blocks = -(-(words or 0) // SHARD) or 1, -(-asks.count() // BLOCK) or 1
    dealt = weighed.select("ask", F.col("u.unit").alias("units"), F.col("u.weight").alias("weights"), F.pmod(F.xxhash64("ask"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    notes = live.filter("size > 0").select("id", "size", "terms", "counts", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    cells = dealt.groupBy("shard", "block").cogroup(notes.groupBy("shard", "block"))
    best = cells.applyInArrow(_cell(total, words, k), f"ask long, id {dict(live.dtypes)['id']}, hits long, score double")
    return _answers(best, asks, asked, k)


def _grams(lengths: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """gram, id, size, tf: the runs of each of the lengths in a note's stems, joined by spaces, from (id, size, terms, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            begin = np.cumsum(sizes) - sizes
            coded = batch.column(2).flatten().dictionary_encode()
            entry = np.repeat(np.arange(len(sizes)), pc.list_value_length(batch.column(2)).to_numpy())
            places = batch.column(3).flatten()
            times = pc.list_value_length(places).to_numpy()
            row = np.zeros(int(sizes.sum()), np.int64)
            row[np.repeat(begin[entry], times) + places.flatten().to_numpy()] = np.repeat(coded.indices.to_numpy().astype(np.int64), times)
            note, left = np.repeat(np.arange(len(sizes)), sizes), np.repeat(begin + sizes, sizes) - np.arange(len(row))
            kinds = row  # the number of each run of n stems among those of the batch
            for n in range(1, max(lengths, default=0) + 1):
                starts = np.flatnonzero(left >= n)
                if n > 1:
                    pairs = kinds[starts] * (len(coded.dictionary) + 1) + row[starts + n - 1]
                    kinds = np.zeros(len(row), np.int64)
                    kinds[starts] = np.unique(pairs, return_inverse=True)[1]
                if n not in lengths or not len(starts):
                    continue
                key = note[starts] * (int(kinds[starts].max()) + 1) + kinds[starts]
                _, first, tf = np.unique(key, return_index=True, return_counts=True)
                first = starts[first]
                text = pc.binary_join_element_wise(*[coded.dictionary.take(pa.array(row[first + i])) for i in range(n)], " ")
                yield pa.RecordBatch.from_arrays([text, batch.column(0).take(pa.array(note[first])), pa.array(sizes[note[first]]), pa.array(tf)], names=["gram", "id", "size", "tf"])

    return run


def phrases(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """As search(), for notes that hold a query's stems one after another, each phrase counted as one unit.

    A place of a note begins one run of each length, so what the different phrases
    meet is bounded by the words of all notes.
    """
    scratch = Scratch(queries.sparkSession)
    index = index.saved(scratch)
    row = F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda x: x["term"])
    asked, asks = _asked(queries, lambda t: t.groupBy("query_id").agg(F.array_join(row, " ").alias("units")), scratch)
    lengths = sorted(r[0] for r in asks.select(F.size(F.split("units", " "))).distinct().collect())  # a number for each length of a query
    live = index.entries.filter("live")
    total, words = live.agg(F.count("*"), F.sum("size")).first()
    grams = live.filter("size > 0").select("id", "size", "terms", "places").mapInArrow(_grams(lengths), f"gram string, id {dict(live.dtypes)['id']}, size long, tf long")
    found = scratch.save(grams.join(asks, F.col("gram") == F.col("units")).select("ask", "id", "size", "tf"), "found")
    df = found.groupBy("ask").agg(F.count("*").alias("df"))
    score = _weight(total, F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") * (total or 0) / (words or 1)))
    best = found.join(df, "ask").select("ask", "id", F.col("tf").alias("hits"), F.round(-score, 9).alias("score"))
    return _answers(best, asks, asked, k)
