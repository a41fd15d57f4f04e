"""Token counts by rank-synchronous merging of arrays.

A byte-level vocabulary merges the bytes of a pre-token pair by pair, the pair of
lowest rank first. Here the pre-tokens of a batch of texts stand one behind the
other in one array of symbols. In every step each pre-token that can still merge
names its lowest rank, and all pairs of that rank in it merge at once, in all
pre-tokens of the batch; what is left when none can merge is counted. That gives
the tokenizer's own result: a pair that a merge makes has a later rank than the
merge itself, so nothing of a lower rank can turn up among the pairs of one step.

A worker counts each different piece of text between spaces, newlines and stops
once, as long as it remembers it, and a text is the sum of its pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import packing, worker
from helixframe.llm.rows import ROW, carried, returned, texts

#: Bytes of pre-tokens that are merged together, unless one pre-token has more; pieces that a worker remembers.
BATCH_BYTES, KNOWN = 1 << 20, 400_000
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones of Latin-1 stand for themselves, the others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The merges of a vocabulary as sorted arrays, and what they leave of many pre-tokens."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.width = max(vocabulary.values()) + 1
        self.byte = np.zeros(256, np.int64)
        for c, b in byte_symbols().items():
            self.byte[b] = vocabulary[c]
        first: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            first.setdefault(vocabulary[a] * self.width + vocabulary[b], (rank, vocabulary[a + b]))
        self.pairs = np.array(sorted(first), np.int64)
        self.ranks = np.array([first[k][0] for k in self.pairs.tolist()], np.int64)
        self.made = np.array([first[k][1] for k in self.pairs.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (_NONE: it never merges) and the symbol it makes."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        found = self.pairs[at] == key
        return np.where(found, self.ranks[at], _NONE), self.made[at]

    def counts(self, flat: bytes, size: np.ndarray) -> np.ndarray:
        """Surviving symbols of each word; flat has the bytes of the words, one behind the other."""
        out = np.zeros(len(size), np.int64)
        if not len(self.pairs):
            return size
        live = np.flatnonzero(size > 0)
        size = size[live]
        symbols = self.byte[np.frombuffer(flat, np.uint8)]
        last = np.cumsum(size) - 1
        # the pair of a symbol and its right neighbour; the last symbol of a word has none
        rank, made = self.rank(symbols, np.append(symbols[1:], 0))
        rank[last] = _NONE
        while len(live):
            start = last - size + 1
            least = np.minimum.reduceat(rank, start)
            done = least == _NONE
            out[live[done]] = size[done]
            at = np.flatnonzero((rank == np.repeat(least, size)) & (rank != _NONE))
            # of pairs that overlap (they are of one symbol) every second merges, from the left of their run
            fresh = np.diff(at, prepend=-2) > 1
            at = at[(at - at[fresh][np.cumsum(fresh) - 1]) % 2 == 0] if len(at) else at
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            lost = np.zeros(len(symbols), np.int64)
            lost[at + 1] = 1
            size = size - np.add.reduceat(lost, start)
            keep &= np.repeat(~done, last - start + 1)
            symbols, rank, made, changed = symbols[keep], rank[keep], made[keep], changed[keep]
            live, size = live[~done], size[~done]
            last = np.cumsum(size) - 1
            # only pairs with a symbol that is new have another rank now
            again = np.flatnonzero(changed | np.append(changed[1:], False))
            rank[again], made[again] = self.rank(symbols[again], symbols[np.minimum(again + 1, len(symbols) - 1)])
            rank[last] = _NONE
        return out


class Counter:
    """Number of ids of whole texts, as Tokenizer.encode(text, add_special_tokens=False) gives them, for a byte-level tokenizers file.

    Added tokens in a text are one id each. Other kinds of files are refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        form = json.loads(Tokenizer.from_file(path).to_str())
        model, before = form["model"], form["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and form["normalizer"] is None
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        trims = [t["content"] for t in form["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model["type"] != "BPE" or not plain or odd or trims:
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.added = sorted((t["content"] for t in form["added_tokens"]), key=len, reverse=True)
        self.merger = Merger(model["vocab"], [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.byte = {ord(c): b for c, b in byte_symbols().items()}
        self.space = next(c for c, b in byte_symbols().items() if b == 32)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _cut(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all pieces and how many each piece has, as the library cuts them.

        A piece of ASCII letters, with or without a space before them, is one pre-token.
        """
        words, n = [], np.ones(len(pieces), np.int64)
        for i, p in enumerate(pieces):
            bare = p[1:] if p[:1] == " " else p
            if bare.isascii() and bare.isalpha():
                words.append(p if bare is p else self.space + bare)
            else:
                own = [w for w, _ in self.split(p)]
                n[i] = len(own)
                words += own
        return words, n

    def _count(self, pieces: list[str]) -> np.ndarray:
        """Ids of each piece."""
        words, n = self._cut(pieces)
        coded = pa.array(words, pa.string()).dictionary_encode()
        different = coded.dictionary.to_pylist()
        size = np.fromiter(map(len, different), np.int64, len(different))
        found, at, held = [], 0, np.concatenate([[0], np.cumsum(size)])
        while at < len(different):
            stop = max(at + 1, int(np.searchsorted(held, held[at] + BATCH_BYTES, "right")) - 1)
            found.append(self.merger.counts("".join(different[at:stop]).translate(self.byte).encode("latin-1"), size[at:stop]))
            at = stop
        each = np.concatenate([*found, np.zeros(0, np.int64)])[coded.indices.to_numpy()] if found else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        stop = np.cumsum(n)
        return total[stop] - total[stop - n]

    def _whole(self, text: str) -> int:
        """Ids of a text that may hold added tokens."""
        parts, n = [text], 0
        for token in self.added:
            cut = [p.split(token) for p in parts]
            n += sum(len(c) - 1 for c in cut)
            parts = [x for c in cut for x in c]
        return n + int(self._count([p for p in parts if p]).sum())

    def counts(self, column: pa.Array) -> np.ndarray:
        """Ids of each text; none for null."""
        column = pc.fill_null(column, "")
        out = np.zeros(len(column), np.int64)
        risky = pc.match_substring_regex(column, packing._RISKY).to_numpy(zero_copy_only=False)
        for token in self.added:
            risky = risky | pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(risky).tolist():
            out[i] = self._whole(column[i].as_py())
        even = np.flatnonzero(~risky)
        if not len(even):
            return out
        cut = pc.replace_substring_regex(column.take(pa.array(even)), packing._STOP, "\\1\0\\2\\3")
        parts = pc.split_pattern(pc.replace_substring(pc.replace_substring(cut, " ", "\0 "), "\n", "\0\n\0"), "\0")
        offsets = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.known) > KNOWN // 2:  # what isn't met again goes at the next turn
            self.known, self.older = {}, self.known
        fresh = []
        for p in pieces:
            if p not in self.known:
                if (n := self.older.get(p)) is None:
                    fresh.append(p)
                else:
                    self.known[p] = n
        self.known.update(zip(fresh, self._count(fresh).tolist(), strict=True))
        each = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        total = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])])
        out[even] = total[offsets[1:]] - total[offsets[:-1]]
        return out


def counter(path: str) -> Counter:
    """The worker's counter for a file; it outlives a task."""
    worker.enter("tokencount")
    return worker.keep("tokencount", path, lambda: Counter(path))


def count(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """All columns of docs, then __n_bytes (of the text in UTF-8), __n_tokens (long each) and __over_limit (more tokens than limit).

    docs has text; a null text counts as an empty one, 0 bytes and 0 tokens. Texts
    are counted whole, however long; repeated rows each for itself; an empty table
    gives no rows. There is no order, so no ties. Columns of docs stay whatever their
    names, but for those with the names of the added ones, which are replaced.
    No row leaves its task, so nothing is shuffled. A task holds an Arrow batch.
    """
    rows = carried(docs)
    of = F.col(f"{ROW}.text").cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer).counts
        for batch in batches:
            column = texts(batch.column(0))
            n = np.concatenate([counts(s.column(0)) for s in packing._slices(pa.record_batch([column, column], names=["text", "of"]))]) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=[ROW, "n"])

    schema = rows.select(ROW, F.lit(0).cast("long").alias("n")).schema
    found = rows.mapInArrow(run, schema)
    size = F.coalesce(F.octet_length(of).cast("long"), F.lit(0).cast("long"))
    return found.select(*returned(found, size.alias("__n_bytes"), F.col("n").alias("__n_tokens"), (F.col("n") > limit).alias("__over_limit")))
