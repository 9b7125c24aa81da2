"""Mail files as a Spark data source: byte ranges of .mbox files, members of .zip files and bundles of .eml files are its
partitions, so that one large mailbox is read by many tasks."""

from __future__ import annotations

import json
import os
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = (".eml", ".mbox", ".zip")
#: Bytes of a partition, about; bytes that a mailbox is read by, and rows of a batch.
SPLIT, CHUNK, ROWS = 32 << 20, 1 << 20, 256
SCHEMA = "path string, at bigint, source_file string, content binary"
#: A separator line stands at the top of the file or after a blank line, and holds a sender and a date, which begins with a weekday.
_FROM_LINE = re.compile(rb"(?:(?<=\n\n)|(?<=\r\n\r\n))From \S+ +(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\b[^\n]*\n")


def split_mbox(file, start: int, end: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(place of its separator, content) of each message whose separator line begins in [start, end) of an open file. The last one
    is read to its end, wherever that is; memory holds one message and a chunk."""
    at = max(0, start - 4)
    file.seek(at)
    buf = b""
    if at == 0:
        buf, at = b"\n\n", -2  # the top counts as after a blank line
    own = begun = None  # where the message now open has its separator, and its first byte in buf
    pos, more = 0, True
    while more:
        data = file.read(chunk)
        more = bool(data)
        buf += data
        for m in _FROM_LINE.finditer(buf, pos):
            line = at + m.start()
            pos = m.end()
            if begun is not None:
                yield own, buf[begun : m.start() - 1]
                begun = None
            if line >= end:
                return
            if line >= start:
                own, begun = line, m.end()
        pos = max(pos, buf.rfind(b"\n") + 1)  # a line that isn't whole yet is looked at again
        if begun is None and at + pos >= end:
            return
        keep = max(0, (pos if begun is None else min(begun, pos)) - 4)
        buf, at, pos, begun = buf[keep:], at + keep, pos - keep, None if begun is None else begun - keep
    if begun is not None:
        yield own, buf[begun:]


def _kind(path: str, kind: str | None) -> str:
    return kind or os.path.splitext(path.lower())[1].lstrip(".")


def _members(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """The messages of a zip by name; zips within zips stay closed."""
    return sorted((i for i in z.infolist() if i.filename.lower().endswith(".eml")), key=lambda i: i.filename)


class _Part(InputPartition):
    """Pieces (path, kind, from, to): bytes of a .mbox, numbers of a zip's members, all of a .eml."""

    def __init__(self, pieces: list[tuple[str, str, int, int]]):
        self.pieces = pieces


class MailReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int, kind: str | None):
        self.paths, self.split, self.kind = paths, split, kind

    def _files(self) -> Iterator[tuple[str, int]]:
        """(path or address, size) of all mail files below the paths, by name; hidden ones are passed over."""
        for path in self.paths:
            path = path.rstrip("/")
            fs, inner = file_system(path)
            info = fs.get_file_info(inner)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            infos = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
            head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
            for i in sorted(infos, key=lambda i: i.path):
                shown = not any(p.startswith((".", "_")) for p in i.path[len(inner) :].split("/") if p)
                if i.type == pafs.FileType.File and shown and (self.kind or f".{_kind(i.path, None)}" in SUFFIXES):
                    yield f"{head}{i.path}", i.size

    def _pieces(self) -> Iterator[tuple[tuple[str, str, int, int], int]]:
        for path, size in self._files():
            kind = _kind(path, self.kind)
            if kind == "mbox":
                for start in range(0, size, self.split):
                    yield (path, kind, start, min(size, start + self.split)), min(self.split, size - start)
            elif kind == "zip":
                fs, inner = file_system(path)
                with fs.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                    first, held = 0, 0
                    members = _members(z)
                    for k, m in enumerate(members):
                        held += m.file_size
                        if held >= self.split or k == len(members) - 1:
                            yield (path, kind, first, k + 1), held
                            first, held = k + 1, 0
            else:
                yield (path, kind, 0, size), size

    def partitions(self) -> list[InputPartition]:
        """Pieces in order of their paths, bundled up to the size of a partition."""
        out, pieces, held = [], [], 0
        for piece, size in self._pieces():
            if pieces and held + size > self.split:
                out.append(_Part(pieces))
                pieces, held = [], 0
            pieces.append(piece)
            held += size
        return [*out, _Part(pieces)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row in self._messages(partition):
            rows.append(row)
            held += len(row[3])
            if len(rows) >= ROWS or held >= self.split:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _messages(self, partition: _Part) -> Iterator[tuple[str, int, str, bytes]]:
        for path, kind, start, end in partition.pieces:
            fs, inner = file_system(path)
            with fs.open_input_file(inner) as f:
                if kind == "mbox":
                    for at, content in split_mbox(f, start, end):
                        yield path, at, f"{path}#{at}", content
                elif kind == "zip":
                    with zipfile.ZipFile(f) as z:
                        for k, m in enumerate(_members(z)[start:end], start):
                            yield path, k, f"{path}/{m.filename}", z.read(m)
                else:
                    yield path, 0, path, f.read()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, at, name, content = zip(*rows)
    return pa.RecordBatch.from_pydict({"path": path, "at": pa.array(at, pa.int64()), "source_file": name, "content": pa.array(content, pa.binary())})


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or address and the path within it."""
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def reachable(path: str) -> bool:
    """Whether Python itself can open the store of a path; other ones only Spark's readers reach."""
    try:
        file_system(path)
        return True
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False


class MailFiles(DataSource):
    """``spark.read.format("mailfiles")``: raw messages (path, at, source_file, content). Options: paths, a JSON list (or
    ``load(path)``); splitBytes; kind, mbox, zip or eml, for files whose names don't tell."""

    @classmethod
    def name(cls) -> str:
        return "mailfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MailReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return MailReader(paths, int(self.options.get("splitBytes", SPLIT)), self.options.get("kind"))


def raw_messages(spark: SparkSession, *paths: str, split: int = SPLIT, kind: str | None = None) -> DataFrame:
    """(path, at, source_file, content) of every message under the paths: at is a message's byte in its .mbox, or its number among
    the names of its .zip. kind: what all files are, whatever their names."""
    spark.dataSource.register(MailFiles)
    reader = spark.read.format("mailfiles").option("paths", json.dumps(list(paths))).option("splitBytes", split)
    return (reader.option("kind", kind) if kind else reader).load()
