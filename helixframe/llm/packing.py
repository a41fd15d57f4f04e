"""Packing token sequences by Karmarkar-Karp multiway differencing.

The tokens of a document are cut into full windows, which need no packing, and a
remainder. Remainders, in pieces of bounded length, are gathered in the order of
the input into groups of bounded size; each group is divided among windows by
multiway differencing: partial partitions (one sum for each window) are merged,
the two of largest imbalance first, the large sums of one with the small sums of
the other. If a window exceeds the capacity, the window count rises by one and
the group is divided again. No row leaves its task, so nothing is shuffled.
"""

from __future__ import annotations

import heapq
import itertools
import json
from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import worker

END = 1
#: Windows of a group, and the longest piece of a remainder as a part of a window.
GROUP_WINDOWS, PIECES = 128, 4
#: Pieces of words whose ids a Python worker keeps, and bytes of text that are encoded at once.
CACHE_WORDS, SLICE_BYTES = 400_000, 6_000_000
_SPACE = r"\t\n\x0b\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts in which a space or newline stands beside white space, or that hold the separator: they are encoded whole.
_RISKY = rf"[ \n][ {_SPACE}]|[{_SPACE}][ \n]|\x00"
#: A full stop or comma between a letter and a space, a newline or the end.
_STOP = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,])([ \n]|$)"


def differencing(sizes: Sequence[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp division of item numbers among windows; near-equal sums. Returns one list for each window in use."""
    # A partition is (-imbalance, number, slots); slots are its non-empty windows as (sum, number, tree), ascending.
    heap = [(-n, i, [(n, i, i)]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        free = windows - len(a)
        rest = b[::-1]  # the largest of b go to the windows that are empty in a, the others to the smallest of a
        alone, paired = rest[:free], rest[free:]
        low, a = a[: len(paired)], a[len(paired) :]
        for (n, _, tree), (m, _, other) in zip(low, paired, strict=True):
            number += 1
            insort(a, (n + m, number, (tree, other)))
        for slot in alone:
            insort(a, slot)
        number += 1
        heapq.heappush(heap, (-(a[-1][0] - (a[0][0] if len(a) == windows else 0)), number, a))
    return [_leaves(tree) for _, _, tree in heap[0][2]] if heap else []


def _leaves(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            todo += t[::-1]
        else:
            out.append(t)
    return out


def divide(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """differencing() with the least window count, from the sum upwards, that exceeds the capacity nowhere."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        packed = differencing(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in packed):
            return packed
        windows += 1


class Encoder:
    """Ids of whole texts from a tokenizers file, as Tokenizer.encode(text, add_special_tokens=False) gives them.

    A byte-level vocabulary never joins what stands on either side of a space
    that follows a word, of a lone newline, or of a full stop or comma between a
    letter and white space. So a text is cut there and each distinct piece is
    encoded once. Encoded whole are texts with a space or newline beside other
    white space, texts that hold an added token (which is then that token), and
    all texts where the vocabulary isn't byte-level.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        before = form["pre_tokenizer"] or {}
        self.cut = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and form["normalizer"] is None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.starts[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.newline = vocabulary.get("Ċ", -1)
        self.added = [t["content"] for t in form["added_tokens"]]
        self._clear()

    def _clear(self) -> None:
        """Piece 0 is the empty one, piece 1 a newline."""
        self.known: dict[str, int] = {"": 0, "\n": 1}
        self.ids = np.array([self.newline], np.uint32)
        self.ends = np.array([0, 0, 1], np.int64)  # piece i has ids[ends[i] : ends[i + 1]]
        self.used = np.ones(2, bool)

    def _forget(self) -> None:
        """Drop the pieces that weren't met again since the last time; all, if that leaves most of them."""
        self.used[:2] = True
        keep = np.flatnonzero(self.used)
        if len(keep) > CACHE_WORDS // 2:
            return self._clear()
        words = list(self.known)
        size = np.diff(self.ends)[keep]
        ends = np.concatenate([[0], np.cumsum(size)])
        self.ids = self.ids[np.arange(ends[-1]) + np.repeat(self.ends[keep] - ends[:-1], size)]
        self.known, self.ends = {words[k]: i for i, k in enumerate(keep.tolist())}, ends
        self.used = np.zeros(len(keep), bool)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Encode pieces, many in one text: a token that starts with a space starts a piece; other pieces stand between newlines."""
        flats, sizes, names = [], [], []
        for spaced in (True, False):
            own = [w for w in words if (w[0] == " ") == spaced]
            for at in range(0, len(own), 2000):
                some = own[at : at + 2000]
                flat = self._plain([("" if spaced else "\n").join(some)])[0]
                first = np.flatnonzero(self.starts[flat] if spaced else flat == self.newline)
                if spaced and len(first) == len(some):
                    size = np.diff(np.append(first, len(flat)))
                elif not spaced and len(first) == len(some) - 1:
                    size = np.diff(np.concatenate([[-1], first, [len(flat)]])) - 1
                    flat = np.delete(flat, first)
                else:
                    each = self._plain(some)
                    flat, size = np.concatenate(each), np.array([len(x) for x in each])
                flats.append(flat)
                sizes.append(size)
                names += some
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))
        self.ids = np.concatenate([self.ids, *flats])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])
        self.used = np.concatenate([self.used, np.zeros(len(names), bool)])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; none for null."""
        texts = pc.fill_null(texts, "")
        if not self.cut:
            return self._plain(texts.to_pylist())
        risky = pc.match_substring_regex(texts, _RISKY).to_numpy(zero_copy_only=False)
        for token in self.added:
            risky = risky | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        odd = np.flatnonzero(risky).tolist()
        for i, ids in zip(odd, self._plain([texts[i].as_py() for i in odd]), strict=True):
            out[i] = ids
        even = np.flatnonzero(~risky)
        if not len(even):
            return out
        plain = texts.take(pa.array(even)) if len(odd) else texts
        plain = pc.replace_substring_regex(plain, _STOP, "\\1\0\\2\\3")
        parts = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0"), "\0")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = parts.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) > CACHE_WORDS:
            self._forget()
        place = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(place < 0)
        self.used[place[place >= 0]] = True
        if len(fresh):
            new = [words[i] for i in fresh.tolist()]
            self._learn(new)
            place[fresh] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        begin, size = self.ends[place][codes], np.diff(self.ends)[place][codes]
        stop = np.concatenate([[0], np.cumsum(size)])
        body = self.ids[np.arange(stop[-1]) + np.repeat(begin - stop[:-1], size)]
        cut = stop[offsets].tolist()
        for i, first, last in zip(even.tolist(), cut, cut[1:], strict=False):
            out[i] = body[first:last]
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it outlives a task."""
    worker.enter("packing")
    return worker.keep("packing", path, lambda: Encoder(path))


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most SLICE_BYTES of text, or one row."""
    text = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(text, (text[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def pack(docs: DataFrame, tokenizer: str, length: int = 2048) -> DataFrame:
    """Pieces of documents and where they lie: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document's ids are those of its text (null: empty) and then id 1. ids holds
    a piece's ids as little-endian unsigned 32-bit numbers; start counts its
    document's ids before it; a sequence's pieces lie from offset 0 without gaps
    and fill at most length ids. sequence_id is the task's number and a count.
    Repeated rows are packed each for itself; a null doc_id stays null; an empty
    table gives no rows. Long texts are cut into pieces and none is left out;
    pieces of one length are alike, so ties only decide which stands where. Other
    columns than doc_id and text are not read, so none can clash. A task holds one
    group of remainders and one Arrow batch.
    """
    step, group = -(-length // PIECES), GROUP_WINDOWS * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer).encode
        task, count = TaskContext.get(), 0
        base = (task.partitionId() if task else 0) << 36
        rows: list[tuple] = []
        waiting: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal count, held
            for window in divide([len(x[2]) for x in waiting], length):
                at = 0
                for i in window:
                    doc, start, ids, total = waiting[i]
                    rows.append((doc, start, len(ids), ids.tobytes(), total, base + count, at))
                    at += len(ids)
                count += 1
            waiting.clear()
            held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                rows.clear()

        for whole in batches:
            for batch in _slices(whole):
                for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    total, start = len(ids), 0
                    while total - start >= length:
                        rows.append((doc, start, length, ids[start : start + length].tobytes(), total, base + count, 0))
                        count += 1
                        start += length
                    for s in range(start, total, step):
                        waiting.append((doc, s, ids[s : s + step], total))
                    held += total - start
                    if held >= group:
                        close()
                yield from flush()
        close()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
