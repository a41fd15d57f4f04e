"""Block gzip: VCF files written by many tasks, their block index, and reads of regions by offset.

A block-gzip file is a chain of small gzip members, each with its own length in
its header, so parts written by different tasks make one file when they stand one
behind the other. The index has a row for each block in which a record begins,
with the first and last position there, and is a table like any other: which
blocks a set of regions needs is a join, and neighbouring blocks are one read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from helixframe.operators import intervals, scan
from helixframe.session import Scratch
from helixframe.sources.archives import store
from helixframe.sources.files import END_BLOCK

#: Bytes of text in a block, and how often a read is begun anew after a failure.
TEXT, ATTEMPTS = 60_000, 5
#: A row of the index: where the block and the next one begin, where in its text its first record begins, records that begin in it, their first and last place.
INDEX = "file string, offset long, next long, within long, records long, chrom string, first long, last long"
_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("next", pa.int64()), ("within", pa.int64()), ("records", pa.int64()), ("chrom", pa.string()), ("first", pa.int64()), ("last", pa.int64())])


def block(text: bytes) -> bytes:
    """One block of at most 65,280 bytes of text."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def blocks(file, start: int, stop: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(offset, offset of the next, text) of the blocks from an offset on; a file that ends within a block raises."""
    file.seek(start)
    at = start
    while stop is None or at < stop:
        head = file.read(12)
        if not head:
            return
        if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
            raise OSError(f"no block at {at}")
        more = file.read(struct.unpack("<H", head[10:])[0])
        size, i = None, 0
        while i + 4 <= len(more):
            length = struct.unpack("<H", more[i + 2 : i + 4])[0]
            if more[i : i + 2] == b"BC":
                size = struct.unpack("<H", more[i + 4 : i + 6])[0] + 1
            i += 4 + length
        if size is None:
            raise OSError(f"no block size at {at}")
        rest = file.read(size - 12 - len(more))
        if len(rest) < size - 12 - len(more):
            raise OSError(f"the block at {at} is cut off")
        try:
            text = zlib.decompress(rest[:-8], -15)
        except zlib.error as e:
            raise OSError(f"the block at {at} is damaged") from e
        if (zlib.crc32(text), len(text)) != struct.unpack("<II", rest[-8:]):
            raise OSError(f"the block at {at} is damaged")
        yield at, at + size, text
        at += size


def place(line: bytes) -> tuple[str, int]:
    chrom, pos, _ = line.split(b"\t", 2)
    return chrom.decode(), int(pos)


def indexed(file, name: str) -> Iterator[tuple]:
    """Rows of the index of an open file. A record belongs to the block in which it begins, wherever it ends; a block with records of two chromosomes has a row for each."""
    held, begun = b"", None  # the text of a record that isn't complete yet, and where it begins
    rows: dict[int, tuple[int, int]] = {}
    order: list[int] = []
    found: dict[tuple[int, str], list[int]] = {}

    def put(line: bytes, at: tuple[int, int]) -> None:
        if line and not line.startswith(b"#"):
            chrom, pos = place(line)
            row = found.setdefault((at[0], chrom), [at[1], 0, pos, pos])
            row[1] += 1
            row[2], row[3] = min(row[2], pos), max(row[3], pos)

    for offset, after, text in blocks(file, 0):
        rows[offset] = (after, len(text))
        order.append(offset)
        cut, start = text.split(b"\n"), 0
        for i, piece in enumerate(cut):
            if begun is None:
                begun, held = (offset, start), b""
            held += piece
            if i < len(cut) - 1:
                put(held, begun)
                begun = None
            elif not held:
                begun = None
            start += len(piece) + 1
        for key in [k for k in found if k[0] != offset and (begun is None or k[0] != begun[0])]:
            within, records, first, last = found.pop(key)
            yield (name, key[0], rows[key[0]][0], within, records, key[1], first, last)
    if begun is not None:
        put(held, begun)
    for key, (within, records, first, last) in found.items():
        yield (name, key[0], rows[key[0]][0], within, records, key[1], first, last)


@dataclass
class Parts(WriterCommitMessage):
    """(file, number of the task, part, records, bytes) of what a task has written."""

    parts: list[tuple[str, int, str, int, int]]


class PartWriter(DataSourceArrowWriter):
    """Rows (file, line), in the order of the whole output, as block-gzip parts: one for each file that a task has rows of.

    At commit the list of parts is written, in order; parts that it doesn't name, of
    failed or repeated tasks, are not part of anything.
    """

    def __init__(self, options: dict):
        self.uri, self.run = options["path"], options["run"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Parts:
        from pyspark import TaskContext

        fs, path = store(self.uri)
        number, done = TaskContext.get().partitionId(), []
        fs.create_dir(f"{path}/{self.run}", recursive=True)
        now, out, text, name, records = None, None, bytearray(), "", 0

        def close() -> None:
            if out is not None:
                if text:
                    out.write(block(bytes(text)))
                size = out.tell()
                out.close()
                done.append((now, number, name, records, size))

        for batch in batches:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != now or out is None:
                    close()
                    now, name, records, text = file, uuid.uuid4().hex, 0, bytearray()
                    out = fs.open_output_stream(f"{path}/{self.run}/{name}", compression=None)
                data = line.encode() + b"\n"
                if text and len(text) + len(data) > TEXT:
                    out.write(block(bytes(text)))
                    text = bytearray()
                while len(data) > TEXT:  # a record longer than a block lies in several
                    out.write(block(data[:TEXT]))
                    data = data[TEXT:]
                text += data
                records += 1
        close()
        return Parts(done)

    def commit(self, messages: list[Parts | None]) -> None:
        fs, path = store(self.uri)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: (p[0], p[1]))
        with fs.open_output_stream(f"{path}/{self.run}/parts.json", compression=None) as out:
            out.write(json.dumps(parts).encode())

    def abort(self, messages: list[Parts | None]) -> None:
        fs, path = store(self.uri)
        if fs.get_file_info(f"{path}/{self.run}").type == pf.FileType.Directory:
            fs.delete_dir(f"{path}/{self.run}")


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_parts"

    def writer(self, schema: StructType, overwrite: bool) -> PartWriter:
        return PartWriter(self.options)


def write(rows: DataFrame, path: str, file: str, order: list[str], line: str, header: dict[str, str], provenance: dict) -> dict:
    """Writes `<path>/<value of file>.vcf.gz` for each value, its index beside it, and last of all manifest.json, which is returned.

    Rows are dealt by range of (file, order), so no file is one task's work; tasks
    write parts, and one task a file then copies the compressed parts behind the
    header and before the end block. header has each file's header lines; a file
    without one is refused. The manifest has the records of each file, their total
    and the provenance, keys sorted; where it stands, the output is complete.
    """
    spark, run = rows.sparkSession, f"_writing-{uuid.uuid4().hex}"
    spark.dataSource.register(BlockSource)
    keys = [F.col(file), *[F.col(o) for o in order]]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.col(file).cast("string").alias("file"), F.col(line).alias("line"))
    dealt.write.format("block_parts").mode("append").option("run", run).save(path)
    fs, root = store(path)
    with fs.open_input_file(f"{root}/{run}/parts.json") as f:
        parts = json.loads(f.read())
    by_file: dict[str, list] = {}
    for name, _, part, records, _ in parts:
        by_file.setdefault(name, []).append((part, records))
    if lost := [x for x in by_file if x not in header]:
        raise ValueError(f"no header for {lost}")
    todo = [(name, header[name], [p for p, _ in own]) for name, own in sorted(by_file.items())]
    if todo:
        files = spark.createDataFrame(todo, "file string, header string, parts array<string>").repartition(len(todo), "file")
        files.mapInArrow(_assembled(path, run), "file string").write.format("noop").mode("overwrite").save()
    counts = {name: sum(n for _, n in own) for name, own in by_file.items()}
    manifest = provenance | {"records": counts, "total": sum(counts.values()), "files": sorted(counts)}
    with fs.open_output_stream(f"{root}/{run}/manifest.json", compression=None) as out:
        out.write(json.dumps(manifest, indent=2, sort_keys=True).encode())
    fs.move(f"{root}/{run}/manifest.json", f"{root}/manifest.json")
    fs.delete_dir(f"{root}/{run}")
    return manifest


def _assembled(path: str, run: str):
    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(path)
        for batch in batches:
            for row in batch.to_pylist():
                to = f"{root}/{run}/{uuid.uuid4().hex}"
                with fs.open_output_stream(to, compression=None) as out:
                    out.write(block(row["header"].encode()))
                    for part in row["parts"]:
                        with fs.open_input_stream(f"{root}/{run}/{part}", compression=None) as f:
                            while data := f.read(4 << 20):
                                out.write(data)
                    out.write(bytes.fromhex(END_BLOCK))
                fs.move(to, f"{root}/{row['file']}.vcf.gz")
            yield batch.select(["file"])

    return copy


def index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The index of block-gzip VCF files, a task for each file. Write it once; it is what reads of regions start from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = store(name)
                with fs.open_input_file(path) as f:
                    rows: list[tuple] = []
                    for row in indexed(f, name):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)

    files = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths)), "file")
    return files.mapInArrow(run, INDEX)


def needed(index_: DataFrame, regions: DataFrame) -> DataFrame:
    """(file, offset, next, within) of the blocks in which a record of some region (chrom, start, end) may begin."""
    rows = index_.select("file", "offset", "next", "within", "chrom", "first", "last")
    starts = regions.select("chrom", F.col("start").alias("__p")).distinct()
    holding = intervals.points_in_intervals(starts, rows, "__p", "first", "last").select("file", "offset", "next", "within")
    inside = intervals.points_in_intervals(rows, regions.select("chrom", "start", "end"), "first", "start", "end").select("file", "offset", "next", "within")
    both = holding.unionByName(inside)
    return both.groupBy("file", "offset", "next").agg(F.min("within").alias("within"))


def ranges(found: DataFrame) -> DataFrame:
    """(file, start, stop, within, n_blocks): neighbouring blocks joined into one read.

    Blocks are numbered in the order of their offsets; a read begins where the
    block before isn't its neighbour. Runs of any length, by the prefix scan.
    """
    scratch = Scratch(found.sparkSession)
    dealt = scan.deal(found, ["file"], ["offset"], scratch, "blocks")
    ends = dealt.groupBy(scan.RANGE, "file").agg(F.max("next").alias("__next"))
    ends = ends.select(scan.RANGE, "file", F.lag("__next").over(Window.partitionBy("file").orderBy(scan.RANGE)).alias("__before")).filter("__before is not null")
    met = scan.with_carries(dealt, ends, ["file"])
    before = F.coalesce(F.lag("next").over(scan.within(["file"])), F.col("__before"))
    flagged = met.withColumn("begins", F.when(before == F.col("offset"), 0).otherwise(1).cast("long")).select("file", "offset", "next", "within", "begins")
    numbered = scan.running(flagged, ["offset"], ["file"], run="begins")
    return numbered.groupBy("file", "run").agg(F.min("offset").alias("start"), F.max("next").alias("stop"), F.min_by("within", "offset").alias("within"), F.count("*").alias("n_blocks")).drop("run")


RECORDS = "file string, at long, chrom string, pos long, value string"
_RECORDS = pa.schema([("file", pa.string()), ("at", pa.int64()), ("chrom", pa.string()), ("pos", pa.int64()), ("value", pa.string())])


def reads(file_range: tuple[str, int, int, int], opened=None) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, line) of the records that begin in a range of blocks.

    A virtual offset is the block's offset times 65,536 and the place in its text.
    After a failure the file is opened anew, ATTEMPTS times in all, and what was
    given before is read over: only records beyond the last offset are given.
    """
    name, start, stop, within = file_range
    last, failure = -1, None
    for _ in range(ATTEMPTS):
        try:
            for at, line in _records((opened or _open)(name), start, stop, within):
                if at > last:
                    yield at, line
                    last = at
            return
        except OSError as e:
            failure = e
    raise OSError(f"{name}: blocks from {start} to {stop} can't be read") from failure


def _open(name: str):
    fs, path = store(name)
    return fs.open_input_file(path)


def _records(file, start: int, stop: int, within: int) -> Iterator[tuple[int, bytes]]:
    held, begun = b"", None
    with file:
        for offset, _, text in blocks(file, start):
            if offset >= stop and begun is None:
                return
            at = within if offset == start else 0
            cut = text[at:].split(b"\n")
            for i, piece in enumerate(cut):
                if begun is None:
                    if offset >= stop:
                        return
                    begun, held = (offset << 16) + at, b""
                held += piece
                if i < len(cut) - 1:
                    if held and not held.startswith(b"#"):
                        yield begun, held
                    begun = None
                elif not held:
                    begun = None
                at += len(piece) + 1
        if held and begun is not None and not held.startswith(b"#"):
            yield begun, held


def records(spans: DataFrame) -> DataFrame:
    """The records that begin in ranges of blocks, each once: file, at (virtual offset), chrom as in the file, pos, value (the line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in batch.to_pylist():
                rows: list[tuple] = []
                for at, line in reads((span["file"], span["start"], span["stop"], span["within"])):
                    rows.append((span["file"], at, *place(line), line.decode()))
                    if len(rows) == 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)

    return spans.select("file", "start", "stop", "within").repartition("file", "start").mapInArrow(run, RECORDS)


def in_regions(index_: DataFrame, regions: DataFrame) -> DataFrame:
    """Records of indexed files whose position lies in a region (chrom, start, end; coalesced, so that none overlap), each once. Only blocks that may hold one are read."""
    found = records(ranges(needed(index_, regions)))
    return intervals.points_in_intervals(found, regions.select("chrom", "start", "end"), "pos", "start", "end").drop("start", "end")
