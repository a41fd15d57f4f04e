"""Delimited members of ZIP, TAR and gzip files as a Spark data source, for reading and writing.

Reading plans one task for each member: the driver reads a ZIP's central
directory or a TAR's headers, never the data, and a task opens its member where it
begins and parses it block by block. A compressed TAR has no index, so it is one
task that streams the archive once. Only the columns of the asked schema are
parsed out; a member that lacks one fails the read by name.

Paths are URIs of stores that pyarrow opens (file, s3, gs, abfs, hdfs); nothing is
unpacked to a disk.
"""

from __future__ import annotations

import csv
import gzip
import io
import re
import tarfile
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as compute
import pyarrow.csv as pc
import pyarrow.fs as pf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

#: Bytes of a member that are parsed at once, and of a TAR member that a writer holds in memory.
BLOCK, SPOOL = 4 << 20, 8 << 20
#: Kinds of archives by the end of their names, the longer ends first.
KINDS = {".tar.gz": "tar.gz", ".tgz": "tar.gz", ".tar": "tar", ".zip": "zip", ".gz": "gz"}


def store(uri: str) -> tuple[pf.FileSystem, str]:
    """File system and path of a URI; Spark writes local ones with one slash."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pf.FileSystem.from_uri(uri) if "://" in uri else (pf.LocalFileSystem(), uri)


def kind_of(name: str) -> str | None:
    return next((kind for end, kind in KINDS.items() if name.lower().endswith(end)), None)


def archives_at(fs: pf.FileSystem, path: str) -> list[str]:
    """The archive at a path, or those below a folder; names that begin with _ or . are left out."""
    if fs.get_file_info(path).type == pf.FileType.File:
        return [path]
    found = fs.get_file_info(pf.FileSelector(path, recursive=True))
    hidden = re.compile(r"/[_.][^/]*(/|$)")
    return sorted(f.path for f in found if f.type == pf.FileType.File and kind_of(f.path) and not hidden.search(f.path[len(path) :]))


@dataclass
class Member(InputPartition):
    """A member to read; name is None where the archive has to be streamed, offset and size are set in a plain TAR."""

    archive: str
    kind: str
    name: str | None = None
    offset: int = 0
    size: int = 0


class _Part(io.RawIOBase):
    """size bytes of a file from an offset."""

    def __init__(self, file, offset: int, size: int):
        file.seek(offset)
        self.file, self.left = file, size

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read(min(len(into), self.left))
        into[: len(data)] = data
        self.left -= len(data)
        return len(data)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.uri, self.sep = options["path"], options.get("sep", "\t")
        self.header = options.get("header", "true").lower() == "true"
        self.wanted = re.compile(options.get("member", ""))
        self.names = schema.names

    def partitions(self) -> list[Member]:
        fs, path = store(self.uri)
        out: list[Member] = []
        for archive in archives_at(fs, path):
            kind = kind_of(archive)
            if kind == "zip":
                with fs.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                    out += [Member(archive, kind, m.filename) for m in z.infolist() if not m.is_dir() and self.wanted.search(m.filename)]
            elif kind == "tar":
                with fs.open_input_file(archive) as f, tarfile.open(fileobj=f, mode="r:") as t:
                    out += [Member(archive, kind, m.name, m.offset_data, m.size) for m in t if m.isfile() and self.wanted.search(m.name)]
            else:
                out.append(Member(archive, kind))
        return out

    def read(self, part: Member) -> Iterator[pa.RecordBatch]:
        fs, _ = store(self.uri)
        if part.kind == "tar.gz":
            with fs.open_input_file(part.archive) as f, tarfile.open(fileobj=f, mode="r|gz") as t:
                for m in t:
                    if m.isfile() and self.wanted.search(m.name):
                        yield from self._parsed(t.extractfile(m), part.archive, m.name)
        elif part.kind == "zip":
            with fs.open_input_file(part.archive) as f, zipfile.ZipFile(f) as z, z.open(part.name) as data:
                yield from self._parsed(data, part.archive, part.name)
        elif part.kind == "tar":
            with fs.open_input_file(part.archive) as f:
                yield from self._parsed(io.BufferedReader(_Part(f, part.offset, part.size)), part.archive, part.name)
        else:
            with fs.open_input_file(part.archive) as f, gzip.GzipFile(fileobj=f) as data:
                yield from self._parsed(data, part.archive, part.archive)

    def _parsed(self, data, archive: str, name: str) -> Iterator[pa.RecordBatch]:
        """The wanted columns of a member as text, an empty field as null; a row of another number of fields fails the read."""
        first = data.readline()
        if not first:
            if self.header:
                raise ValueError(f"{archive}: {name} has no header")
            return
        cells = next(csv.reader([first.decode("utf-8-sig").rstrip("\r\n")], delimiter=self.sep))
        columns = cells if self.header else [f"_c{i}" for i in range(len(cells))]
        if lost := [c for c in self.names if c not in columns]:
            raise ValueError(f"{archive}: {name} lacks columns {lost}")
        body = io.BufferedReader(_Rest(b"" if self.header else first, data), BLOCK)
        if not body.peek(1):
            return
        read = pc.ReadOptions(column_names=columns, block_size=BLOCK, use_threads=False)
        convert = pc.ConvertOptions(column_types={c: pa.string() for c in columns}, include_columns=self.names, strings_can_be_null=True, null_values=[""])
        with pc.open_csv(body, read, pc.ParseOptions(delimiter=self.sep), convert) as rows:
            for batch in rows:
                yield batch


class _Rest(io.RawIOBase):
    """What was read already, and then the rest of a stream."""

    def __init__(self, first: bytes, data):
        self.first, self.data = first, data

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.first[: len(into)] or self.data.read(len(into))
        self.first = self.first[len(data) :]
        into[: len(data)] = data
        return len(data)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, list[tuple]]]:
    """A member's name, in the first column, and its rows, run by run of a batch."""
    for b in batches:
        code = compute.fill_null(b.column(0).dictionary_encode().indices, -1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s < e:
                yield b.column(0)[s].as_py(), list(zip(*(c.slice(s, e - s).to_pylist() for c in b.columns[1:]), strict=True))


class ArchiveWriter(DataSourceArrowWriter):
    """One archive for each task (of gzip, which has no members, a file for each), written beside the others and moved into place when all tasks are done.

    Rows have their member's name first and come member by member. A failed or
    repeated task leaves nothing: only the files that committed tasks name are moved.
    """

    def __init__(self, options: dict, schema: StructType):
        self.uri, self.sep, self.kind = options["path"], options.get("sep", "\t"), options.get("kind", "zip")
        self.header = options.get("header", "true").lower() == "true"
        self.names = schema.names[1:]
        self.attempt = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, path = store(self.uri)
        rows = runs(batches)
        row, files = next(rows, None), []
        while row:
            fs.create_dir(f"{path}/{self.attempt}", recursive=True)
            files.append(f"part-{uuid.uuid4().hex}.{self.kind}")
            with fs.open_output_stream(f"{path}/{self.attempt}/{files[-1]}", compression=None) as out:
                row = self._write(out, row, rows)
        return Written(files)

    def _write(self, out, row, rows):
        """Writes one archive; returns the run of rows after it, which only gzip files leave."""
        if self.kind == "gz":
            with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as body:
                return self._member(body, row, rows)
        elif self.kind == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                while row:
                    with z.open(row[0], "w", force_zip64=True) as body:
                        row = self._member(body, row, rows)
        else:
            with tarfile.open(fileobj=out, mode="w|gz" if self.kind == "tar.gz" else "w|") as t:
                while row:
                    info = tarfile.TarInfo(row[0])
                    with tempfile.SpooledTemporaryFile(SPOOL) as body:
                        row = self._member(body, row, rows)
                        info.size = body.tell()
                        body.seek(0)
                        t.addfile(info, body)
        return None

    def _member(self, body, row, rows):
        """Writes the runs of one member; returns the first of the next."""
        name, text = row[0], io.TextIOWrapper(body, "utf-8", newline="", write_through=False)
        lines = csv.writer(text, delimiter=self.sep, lineterminator="\n")
        if self.header:
            lines.writerow(self.names)
        while row and row[0] == name:
            lines.writerows(row[1])
            row = next(rows, None)
        text.flush()
        text.detach()
        return row

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = store(self.uri)
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{path}/{self.attempt}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = store(self.uri)
        if fs.get_file_info(f"{path}/{self.attempt}").type == pf.FileType.Directory:
            fs.delete_dir(f"{path}/{self.attempt}")


class ArchiveSource(DataSource):
    """Format `archive`. Options: path, member (a pattern that a member's name must match), sep, header; for writing also kind."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        raise ValueError("an archive is read with a schema: the columns that its members must have")

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, schema)


def read(spark: SparkSession, path: str, columns: list[str], member: str = "", sep: str = "\t", header: bool = True) -> DataFrame:
    """The named columns of all members whose name matches, as text; without a header columns are _c0, _c1 and so on. Any member that lacks one of them fails the read."""
    spark.dataSource.register(ArchiveSource)
    schema = StructType()
    for c in columns:
        schema.add(c, StringType())
    return spark.read.format("archive").schema(schema).option("member", member).option("sep", sep).option("header", header).load(path)


def write(rows: DataFrame, member: Column, path: str, kind: str, sep: str = "\t", header: bool = True) -> None:
    """rows as text in archives of a kind (zip, tar, tar.gz, gz), one for each task; a member is in one archive, or is a gzip file."""
    rows.sparkSession.dataSource.register(ArchiveSource)
    text = rows.select(member.cast("string").alias("member"), *[F.col(f"`{c}`").cast("string") for c in rows.columns])
    dealt = text.repartition("member").sortWithinPartitions("member")
    dealt.write.format("archive").mode("append").option("kind", kind).option("sep", sep).option("header", header).save(path)
