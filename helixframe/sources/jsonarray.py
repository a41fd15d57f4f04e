"""One JSON array file as a partitioned source: elements are found by offset, not by loading the file.

Where an element begins depends on all that stands before it: whether a byte is
inside a string, and how deep. A stretch of the file changes that state in a way
that can be told without knowing it: for each of the three ways in which it may
begin (outside a string, inside, inside behind a backslash) how it ends and by how
much the depth changes. So the stretches are read by many tasks, their few numbers
put together in order, and then each task gives the elements that begin in its
stretch, reading on until the last of them ends.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.archives import store

#: Bytes of a stretch, and bytes that are read at once beyond it.
STRETCH, MORE = 8 << 20, 1 << 16
OUT, IN, ESCAPED = 0, 1, 2
_OUTSIDE, _INSIDE = re.compile(rb'["\[\]{}]'), re.compile(rb'["\\]')
_SPACE = b" \t\r\n"


def effect(data: bytes, state: int) -> tuple[int, int]:
    """(state, change of depth) after some bytes that begin in a state."""
    at, depth = 0, 0
    if state == ESCAPED and data:
        at, state = 1, IN
    while at < len(data):
        if state == OUT:
            m = _OUTSIDE.search(data, at)
            if not m:
                break
            at = m.end()
            if m[0] == b'"':
                state = IN
            else:
                depth += 1 if m[0] in b"[{" else -1
        else:
            m = _INSIDE.search(data, at)
            if not m:
                break
            at = m.end()
            if m[0] == b'"':
                state = OUT
            elif at == len(data):
                state = ESCAPED
            else:
                at += 1
    return state, depth


def _file_bytes(path: str, start: int, stop: int | None) -> bytes:
    fs, name = store(path)
    with fs.open_input_file(name) as f:
        f.seek(start)
        return f.read() if stop is None else f.read(stop - start)


def elements(path: str, start: int, stop: int, state: int, depth: int, size: int) -> Iterator[tuple[int, str]]:
    """(offset, text) of the elements that begin in [start, stop); state and depth are those at start. Raises where the file is no array of elements."""
    fs, name = store(path)
    with fs.open_input_file(name) as f:
        f.seek(start)
        data, base = f.read(stop - start), start
        at, begun = 0, None  # places in data

        def fail(place: int, what: str) -> None:
            raise ValueError(f"{path}: {what} at byte {base + place}")

        while True:
            if at >= len(data):
                if base + at >= stop and (begun is None or base + at >= size):
                    break
                if begun is None:
                    data, base, at = b"", base + len(data), 0
                elif begun:
                    data, base, at, begun = data[begun:], base + begun, at - begun, 0
                more = f.read(MORE)
                if not more:
                    break
                data += more
                continue
            c = data[at : at + 1]
            if state == ESCAPED:
                state, at = IN, at + 1
            elif state == IN:
                m = _INSIDE.search(data, at)
                at = m.end() if m else len(data)
                if m:
                    state = OUT if m[0] == b'"' else ESCAPED
            elif depth == 1 and c in b",]":
                if begun is not None:
                    yield base + begun, data[begun:at].decode().strip()
                    begun = None
                if c == b"]":
                    depth = 0
                if base + at + 1 >= stop and c == b",":
                    break
                at += 1
            elif depth == 0:
                if c not in _SPACE and not (c == b"[" and base + at == _first(f, size)):
                    fail(at, "something outside the array")
                depth += c == b"["
                at += 1
            else:
                if depth == 1 and begun is None and c not in _SPACE:
                    if base + at >= stop:
                        break
                    begun = at
                if depth == 1 and begun is None:
                    at += 1
                elif c == b'"':
                    state, at = IN, at + 1
                elif c in b"[{":
                    depth, at = depth + 1, at + 1
                elif c in b"]}":
                    depth, at = depth - 1, at + 1
                else:
                    m = re.compile(rb'[",\[\]{}]' if depth == 1 else rb'["\[\]{}]').search(data, at + 1)
                    at = m.start() if m else len(data)
        if base + at >= size and (begun is not None or depth != 0 or state != OUT):
            fail(len(data), "the array doesn't end")


def _first(f, size: int) -> int:
    """Offset of the first byte that is no white space."""
    here = f.tell()
    f.seek(0)
    head = f.read(min(size, 4096))
    f.seek(here)
    return len(head) - len(head.lstrip(_SPACE))


def read(spark: SparkSession, path: str, schema: str, stretch: int = STRETCH) -> DataFrame:
    """The objects of one JSON array file, as many tasks as it has stretches.

    An element that is no object or no JSON fails the read with its offset, as does
    whatever stands outside the array, and an array that doesn't end. A null is no
    object.
    """
    fs, name = store(path)
    size = fs.get_file_info(name).size
    spans = [(i, at, min(at + stretch, size)) for i, at in enumerate(range(0, size, stretch))]
    if not spans:
        raise ValueError(f"{path} is empty")

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = _file_bytes(path, start, stop)
                found = [effect(data, s) for s in (OUT, IN, ESCAPED)]
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([[x[0] for x in found]]), pa.array([[x[1] for x in found]])], names=["i", "states", "depths"])

    dealt = spark.createDataFrame(spans, "i long, start long, stop long").repartition(len(spans), "i")
    told = {r.i: r for r in dealt.mapInArrow(effects, "i long, states array<long>, depths array<long>").collect()}  # three pairs of numbers a stretch
    begins, state, depth = [], OUT, 0
    for i, start, stop in spans:
        begins.append((start, stop, state, depth))
        state, depth = told[i].states[state], depth + told[i].depths[state]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple[int, str]] = []
                for at, text in elements(path, *span, size):
                    if not text.startswith("{"):
                        raise ValueError(f"{path}: the element at byte {at} is no object")
                    try:
                        json.loads(text)
                    except ValueError as e:
                        raise ValueError(f"{path}: the element at byte {at} is no JSON: {e}") from None
                    rows.append((at, text))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["at", "text"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["at", "text"])

    found = spark.createDataFrame(begins, "start long, stop long, state int, depth int").repartition(len(begins), "start").mapInArrow(parts, "at long, text string")
    return found.select(F.from_json("text", schema).alias("e")).select("e.*")


def write(rows: DataFrame, path: str) -> None:
    """rows as one JSON array in one file: tasks write their elements, and one task copies them into the file, block by block."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(f"{path}.parts")

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, root = store(path)
            parts = [p for p in sorted(f.path for f in fs.get_file_info(pf.FileSelector(f"{root}.parts"))) if "/part-" in p]
            with fs.open_output_stream(f"{root}.writing", compression=None) as out:
                separator = b"[\n"
                for part in parts:
                    with fs.open_input_file(part) as f:
                        for line in io.BufferedReader(f, MORE):
                            out.write(separator + line.rstrip(b"\n"))
                            separator = b",\n"
                out.write(b"\n]\n" if separator[:1] == b"," else b"[]\n")
            fs.move(f"{root}.writing", root)
            fs.delete_dir(f"{root}.parts")
            yield batch

    rows.sparkSession.range(1).repartition(1).mapInArrow(copied, "id long").write.format("noop").mode("overwrite").save()
