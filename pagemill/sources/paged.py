"""Paginated documents as a Spark data source: spark.read.format("paged_documents").

Options: path (a file or a folder, searched with its subfolders), parser ("module:function"), split_bytes, and
output: `pages` (a row for each page), `lines` (a row for each line with its box) or `documents` (one row). A
schema given to the reader chooses columns; a parser is asked only for what they need. A large file is read by
several tasks, each of which takes a range of its pages, small files share a task; conditions on pdf_id and
page_number leave out what can't fit before it is parsed.

A parser takes a file's bytes and gives a Document. plain() is one, for text files with form feeds. A path that
isn't there is an error when the query is planned; a file that can't be parsed fails the query with its name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SPLIT_BYTES = 32 << 20
ROWS = 1 << 12
SCHEMAS = {
    "documents": "pdf_id string, pdf_path string, page_count int",
    "pages": "pdf_id string, pdf_path string, page_count int, page_number int, width double, height double, page_text string",
    "lines": "pdf_id string, page_number int, line int, x0 double, y0 double, x1 double, y1 double, text string",
}


@dataclass
class Line:
    x0: float
    y0: float
    x1: float
    y1: float
    text: str


@dataclass
class Document:
    """What a parser gives: how many pages there are, the size of page i (from 0) and its lines."""

    page_count: int
    size: Callable[[int], tuple[float, float]]
    lines: Callable[[int], list[Line]]


def plain(data: bytes) -> Document:
    """Text in UTF-8 whose pages end with form feeds: lines of 12 points from the top, 6 points a character, on
    pages of 595 by 842 points or of the size that a first line `%size width height` says."""
    pages = data.decode().split("\f")
    if len(pages) > 1 and not pages[-1].strip():
        pages.pop()

    def size(i: int) -> tuple[float, float]:
        first = pages[i].lstrip("\n").split("\n", 1)[0].split()
        return (float(first[1]), float(first[2])) if len(first) == 3 and first[0] == "%size" else (595.0, 842.0)

    def lines(i: int) -> list[Line]:
        out = []
        for k, text in enumerate(pages[i].lstrip("\n").split("\n")):
            if text.strip() and not text.startswith("%size "):
                left = 6.0 * (len(text) - len(text.lstrip()))
                out.append(Line(left, 12.0 * k, 6.0 * len(text.rstrip()), 12.0 * k + 10, text.strip()))
        return out

    return Document(len(pages), size, lines)


@dataclass
class Split(InputPartition):
    """Files (path, part, of): part `part` of `of` of each file's pages."""

    files: list[tuple[str, int, int]]


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.columns = schema, schema.names
        self.output = options.get("output", "pages")
        self.path, self.parser = options["path"], options.get("parser", "pagemill.sources.paged:plain")
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.names: set[str] | None = None
        self.first, self.last = 1, 1 << 62
        store, at = _store(self.path)
        self.files = sorted((f.path, f.size) for f in _files(store, at, self.path))

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("pdf_id",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            elif name == ("page_number",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.last = min(self.last, f.value - isinstance(f, LessThan))
            yield f  # Spark tests each row again

    def partitions(self) -> list[Split]:
        out: list[Split] = []
        held, size = [], 0
        for path, n in self.files:
            if self.names is not None and PurePosixPath(path).stem not in self.names:
                continue
            parts = max(1, -(-n // self.split_bytes)) if self.output != "documents" else 1
            if parts > 1:
                out += [Split([(path, k, parts)]) for k in range(parts)]
                continue
            if held and size + n > self.split_bytes:
                out.append(Split(held))
                held, size = [], 0
            held.append((path, 0, 1))
            size += n
        return out + [Split(held)] * bool(held)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        module, name = self.parser.split(":")
        parse = getattr(import_module(module), name)
        store, _ = _store(self.path)
        held: list[tuple] = []
        for path, part, of in partition.files:
            with store.open_input_stream(path) as f:
                data = f.read()
            try:
                document = parse(data)
                for row in self._rows(path, document, part, of):
                    held.append(row)
                    if len(held) >= ROWS:
                        yield self._batch(held)
                        held = []
            except Exception as e:
                raise ValueError(f"{path} can't be read: {e}") from e
        if held:
            yield self._batch(held)

    def _rows(self, path: str, document: Document, part: int, of: int) -> Iterator[tuple]:
        n, wanted = document.page_count, set(self.columns)
        known = {"pdf_id": PurePosixPath(path).stem, "pdf_path": path, "page_count": n}
        if self.output == "documents":
            yield tuple(known[c] for c in self.columns)
            return
        for i in range(max(n * part // of, self.first - 1), min(n * (part + 1) // of, self.last)):
            own = known | {"page_number": i + 1}
            if self.output == "pages":
                if wanted & {"width", "height"}:
                    own["width"], own["height"] = document.size(i)
                if "page_text" in wanted:
                    own["page_text"] = "\n".join(x.text for x in document.lines(i))
                yield tuple(own[c] for c in self.columns)
            else:
                for k, x in enumerate(document.lines(i)):
                    line = own | {"line": k, "x0": x.x0, "y0": x.y0, "x1": x.x1, "y1": x.y1, "text": x.text}
                    yield tuple(line[c] for c in self.columns)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(zip(*rows), self.schema)], self.columns)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(store: fs.FileSystem, at: str, path: str) -> list[fs.FileInfo]:
    found = store.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no such document: {path}")
    if found.type == fs.FileType.File:
        return [found]
    return [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]


class PagedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_documents"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("output", "pages")]

    def reader(self, schema: StructType) -> Reader:
        known = {tuple(c.split(" ")) for c in self.schema().split(", ")}
        if odd := [f.name for f in schema if (f.name, f.dataType.simpleString()) not in known]:
            raise ValueError(f"no such columns: {', '.join(odd)}")
        return Reader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark hand conditions to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedDocuments)
