"""Formats for ``spark.read`` and ``spark.readStream``: documents, sidecars and page caches.

    formats.register(spark)
    spark.read.format("lodestone_documents").load("file:///corpus")
    spark.readStream.format("lodestone_sidecar").load("file:///corpus/sidecar")

The path is a file or a folder on any file system that Arrow can open; names that begin with ``_`` or ``.`` are
passed over.  Files of lines are split by bytes (option ``splitBytes``), page files are dealt together up
to that size, so a task reads about as much whatever the files' sizes.  What cannot be read is a row with an ``error`` and nulls.
With ``.schema(...)`` only the columns named there are made; pages are not even decompressed if nothing asks for it.

A stream takes files in the order of their times of change (ties by name), each once; files are to be moved in whole,
and none that is older than those already taken.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import DOC_ID

SPLIT_BYTES = 64 * 1024 * 1024
BATCH_ROWS, BATCH_BYTES = 1000, 8 * 1024 * 1024
LARGEST = 2**64 - 1


@dataclass
class Pieces(InputPartition):
    """Parts of files: ``(path, start, end)`` in bytes."""

    pieces: list[tuple[str, int, int]]


def _listed(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    system, base = fs.FileSystem.from_uri(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return system, [info]
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    inside = lambda f: f.path[len(base) :].strip("/").split("/")
    return system, [f for f in found if f.type == fs.FileType.File and not any(n[0] in "_." for n in inside(f))]


class _Format:
    """What batch and stream readers share; subclasses say which ``COLUMNS`` there are and make rows of a piece."""

    COLUMNS: dict[str, T.DataType]
    SPLITS = True
    SUFFIX = ""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a path is needed")
        for field in schema:
            if self.COLUMNS.get(field.name) != field.dataType:
                raise ValueError(f"there is no column {field.name} of type {field.dataType.simpleString()}")
        self.columns, self.path = [f.name for f in schema], options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        if self.split < 1:
            raise ValueError("splitBytes must be 1 or more")

    def files(self) -> list[fs.FileInfo]:
        return [f for f in _listed(self.path)[1] if f.path.endswith(self.SUFFIX)]

    def pieces(self, files: list[fs.FileInfo]) -> list[Pieces]:
        if self.SPLITS:
            return [Pieces([(f.path, at, min(at + self.split, f.size))]) for f in files for at in range(0, f.size, self.split)]
        out, held = [], 0
        for f in sorted(files, key=lambda f: f.path):
            if not out or held + f.size > self.split:
                out.append(Pieces([]))
                held = 0
            out[-1].pieces.append((f.path, 0, f.size))
            held += f.size
        return out

    def rows(self, system: fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[dict, int]]:
        """Rows, each with its size in bytes."""
        raise NotImplementedError

    def batches(self, part: Pieces) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0]
        kinds = {n: pa.decimal128(20, 0) if t == DOC_ID else pa.int64() if t == T.LongType() else pa.string() for n, t in self.COLUMNS.items()}
        rows, held = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[n]) for n in self.columns], names=self.columns)

        for piece in part.pieces:
            for row, size in self.rows(system, *piece):
                rows.append(row)
                held += size
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield made()
                    rows, held = [], 0
        if rows:
            yield made()


class _Lines(_Format):
    """JSON lines; a line belongs to the piece in which it begins, ``position`` is its first byte."""

    PARSED: dict[str, T.DataType]
    PLACE = {"source_file": T.StringType(), "position": T.LongType(), "error": T.StringType()}

    def rows(self, system, path, start, end):
        with io.BufferedReader(system.open_input_file(path), 1 << 20) as f:
            if start:
                f.seek(start - 1)
                start += len(f.readline()) - 1
            while start < end:
                line = f.readline()
                if line.strip(b" \r\n"):
                    row = self.parsed(line) or {"error": "not a record of the format"}
                    yield row | {"source_file": path, "position": start}, len(line)
                start += len(line)
                if not line:
                    break

    def parsed(self, line: bytes) -> dict | None:
        """The values of a line, or nothing where one is missing or of another type."""
        try:
            found = json.loads(line, parse_float=Decimal)
        except (ValueError, RecursionError):
            return None
        if not isinstance(found, dict):
            return None
        out = {}
        for name, kind in self.PARSED.items():
            value = found.get(name)
            if kind == DOC_ID:
                if type(value) not in (int, Decimal) or not 0 <= value <= LARGEST or value != int(value):
                    return None
                out[name] = Decimal(int(value))
            elif isinstance(value, str):
                out[name] = value.encode("utf-8", "replace")
            else:
                return None
        return out


class _Documents(_Lines):
    PARSED = {"doc_id": DOC_ID, "text": T.StringType()}
    COLUMNS = PARSED | _Lines.PLACE


class _Sidecar(_Lines):
    PARSED = {"doc_id": DOC_ID, "number": T.StringType(), "title": T.StringType(), "file": T.StringType()}
    COLUMNS = PARSED | _Lines.PLACE


class _Pages(_Format):
    """One row for each compressed page; one that cannot be decompressed has an ``error`` and no ``html``."""

    COLUMNS = {"path": T.StringType(), "html": T.StringType(), "error": T.StringType()}
    SPLITS, SUFFIX = False, ".zst"

    def rows(self, system, path, start, end):
        import zstandard

        row = {"path": path}
        if "html" in self.columns or "error" in self.columns:
            with system.open_input_stream(path, compression=None) as f:
                raw = f.read()
            try:
                row["html"] = zstandard.ZstdDecompressor().decompressobj().decompress(raw).decode("utf-8", "replace")
            except zstandard.ZstdError as e:
                row["error"] = str(e)
        yield row, len(row.get("html", "")) + len(path)


class _Reader(DataSourceReader):
    def __init__(self, form: _Format):
        self.form = form

    def partitions(self) -> list[Pieces]:
        return self.form.pieces(self.form.files()) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return self.form.batches(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets name the last file taken, by its time of change and its path."""

    def __init__(self, form: _Format):
        self.form = form

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((f.mtime_ns or 0, f.path) for f in self.form.files()), default=(-1, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return self.form.pieces([f for f in self.form.files() if after < (f.mtime_ns or 0, f.path) <= upto]) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return self.form.batches(partition)

    def commit(self, end: dict) -> None:
        pass


class _Source(DataSource):
    FORM: type[_Format]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in self.FORM.COLUMNS.items()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.FORM(schema, {k.lower(): v for k, v in self.options.items()}))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self.FORM(schema, {k.lower(): v for k, v in self.options.items()}))


class DocumentSource(_Source):
    """``lodestone_documents``: JSON lines ``{"doc_id", "text"}``, ids of 64 bits without a sign."""

    FORM = _Documents

    @classmethod
    def name(cls) -> str:
        return "lodestone_documents"


class SidecarSource(_Source):
    """``lodestone_sidecar``: JSON lines ``{"doc_id", "number", "title", "file"}`` that go with documents."""

    FORM = _Sidecar

    @classmethod
    def name(cls) -> str:
        return "lodestone_sidecar"


class PageSource(_Source):
    """``lodestone_pages``: a folder of pages compressed by zstandard."""

    FORM = _Pages

    @classmethod
    def name(cls) -> str:
        return "lodestone_pages"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (DocumentSource, SidecarSource, PageSource):
        spark.dataSource.register(source)
