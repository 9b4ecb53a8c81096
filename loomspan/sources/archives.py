"""Workbooks and zip archives as data sources of Spark (inventory A16, A33).

``spark.dataSource.register(WorkbookSource)`` (or ``register(spark)``), then ``spark.read.format("workbook").load(path)``: one
partition for each sheet, which streams the rows of its XML; ``format("archive")``: partitions of entries of the central
directory, of about ``partitionBytes`` each.  ``path`` is a file, or a folder whose files with the fitting ending are taken.
Files are opened on the executors through Arrow's file systems (local, hdfs, s3, gs), which seek, so a partition reads
its own entries only.  The standard library reads zip and XML; cells hold text as it is stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree
from zipfile import BadZipFile, ZipFile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: What opening a damaged or missing part of a file may raise.
_BAD = (BadZipFile, zlib.error, EOFError, KeyError, NotImplementedError, RuntimeError, ElementTree.ParseError, OSError, pa.ArrowException)


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str, endings: tuple[str, ...]) -> list[str]:
    """The file itself, or those below a folder, as paths of the same file system."""
    system, name = _located(path)
    if system.get_file_info(name).type == fs.FileType.File:
        return [name]
    found = system.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(endings))


class _Opened:
    """A zip file that is read by seeking."""

    def __init__(self, root: str, name: str):
        self.file = _located(root)[0].open_input_file(name)
        self.zip = ZipFile(self.file)

    def __enter__(self) -> ZipFile:
        return self.zip

    def __exit__(self, *_) -> None:
        self.zip.close()
        self.file.close()


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _streamed(zip_: ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one name, each forgotten once it has been used."""
    with zip_.open(name) as f:
        root = None
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if root is None:
                root = e
            if event == "end" and _tag(e) == tag:
                yield e
                root.clear()


def _sheets(zip_: ZipFile) -> list[tuple[str, str]]:
    """(name, entry) of the sheets of a workbook, in its order."""
    targets = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(zip_.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for e in ElementTree.fromstring(zip_.read("xl/workbook.xml")).iter():
        if _tag(e) == "sheet":
            target = targets[e.get(_REL)]
            out.append((e.get("name", ""), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _column(reference: str, after: int) -> int:
    """Position of a cell from its reference (B7 is 1); cells without one follow each other."""
    letters = "".join(c for c in reference if c.isalpha()).upper()
    at = 0
    for c in letters:
        at = at * 26 + ord(c) - 64
    return at - 1 if letters else after


def _text(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if _tag(t) == "t")


class _Strings:
    """Strings that cells share, read when first needed."""

    def __init__(self, zip_: ZipFile):
        self.zip, self.all = zip_, None

    def __getitem__(self, i: int) -> str:
        if self.all is None:
            self.all = [_text(e) for e in _streamed(self.zip, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in self.zip.namelist() else []
        return self.all[i] if 0 <= i < len(self.all) else ""


def _cells(row: ElementTree.Element, strings: _Strings) -> list[str]:
    out: list[str] = []
    for c in row:
        if _tag(c) != "c":
            continue
        kind = c.get("t")
        value = next((x.text or "" for x in c if _tag(x) == "v"), "")
        text = strings[int(value)] if kind == "s" and value else _text(c) if kind == "inlineStr" else {"1": "true", "0": "false"}.get(value, value) if kind == "b" else value
        at = _column(c.get("r", ""), len(out))
        out += [""] * (at - len(out) + 1)
        out[at] = text
    return out


class _Sheet(InputPartition):
    def __init__(self, file: str, number: int, name: str, entry: str, fault: str | None = None):
        self.file, self.number, self.name, self.entry, self.fault = file, number, name, entry, fault


def _sheet_batches(rows: Iterator[tuple], most: int = 4096) -> Iterator[pa.RecordBatch]:
    names = ["file", "sheet", "sheet_name", "row", "cells", "fault"]
    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)

    for r in rows:
        held.append(r)
        if len(held) == most:
            yield batch()
            held = []
    if held:
        yield batch()


class _WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Sheet]:
        out = []
        for file in _files(self.path, (".xlsx", ".xlsm")):
            try:
                with _Opened(self.path, file) as z:
                    out += [_Sheet(file, i, name, entry) for i, (name, entry) in enumerate(_sheets(z))]
            except _BAD as e:
                out.append(_Sheet(file, -1, "", "", f"unreadable: {type(e).__name__}"))
        return out or [_Sheet("", -1, "", "")]

    def _rows(self, p: _Sheet) -> Iterator[tuple]:
        if p.fault:
            yield p.file, p.number, p.name, None, None, p.fault
        if p.number < 0:
            return
        header, number = None, 0
        try:
            with _Opened(self.path, p.file) as z:
                strings = _Strings(z)
                for row in _streamed(z, p.entry, "row"):
                    number = int(row.get("r") or number + 1)
                    cells = _cells(row, strings)
                    if header is None:
                        header = [c.strip() for c in cells]
                    elif any(c.strip() for c in cells):
                        # of two columns with one header the first counts
                        known = dict(reversed([(h, cells[i] if i < len(cells) else "") for i, h in enumerate(header) if h]))
                        yield p.file, p.number, p.name, number, known, None
        except _BAD as e:
            yield p.file, p.number, p.name, number, None, f"unreadable: {type(e).__name__}"

    def read(self, partition: _Sheet) -> Iterator[pa.RecordBatch]:
        yield from _sheet_batches(self._rows(partition))


class WorkbookSource(DataSource):
    """Rows of all sheets of a workbook: file, sheet (its position), sheet_name, row (its number), cells by header, fault.

    The first row of a sheet names its columns, whatever their order; rows without text are left out.  A sheet, or a
    workbook, that cannot be read gives one row with a fault after the rows that could.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, sheet int, sheet_name string, row long, cells map<string,string>, fault string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WorkbookReader(self.options["path"])


class _Entry(NamedTuple):
    file: str
    name: str
    bytes: int
    fault: str | None


class _Entries(InputPartition):
    def __init__(self, entries: list[_Entry]):
        self.entries = entries


class _ArchiveReader(DataSourceReader):
    def __init__(self, path: str, most: int, share: int):
        self.path, self.most, self.share = path, most, share

    def _listed(self) -> Iterator[_Entry]:
        for file in _files(self.path, (".zip",)):
            try:
                with _Opened(self.path, file) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            yield _Entry(file, i.filename, i.file_size, "too_large" if i.file_size > self.most else None)
            except _BAD:
                yield _Entry(file, "", 0, "bad_archive")

    def partitions(self) -> list[_Entries]:
        out, held, size = [], [], 0
        for e in self._listed():
            if held and size + e.bytes > self.share:
                out.append(_Entries(held))
                held, size = [], 0
            held.append(e)
            size += e.bytes
        return [*out, _Entries(held)]

    def read(self, partition: _Entries) -> Iterator[tuple]:
        opened: tuple[str, _Opened] | None = None
        try:
            for e in partition.entries:
                content, fault = None, e.fault
                if fault is None:
                    try:
                        if opened is None or opened[0] != e.file:
                            if opened:
                                opened[1].__exit__()
                            opened = e.file, _Opened(self.path, e.file)
                        content = opened[1].zip.read(e.name)
                    except _BAD:
                        fault = "damaged"
                yield e.file, e.name, e.bytes, content, fault
        finally:
            if opened:
                opened[1].__exit__()


class ArchiveSource(DataSource):
    """Entries of zip archives: file, name, bytes, content, fault (bad_archive, too_large, damaged or null).

    Options: ``mostBytes``, above which an entry is reported and not read (50 MB), and ``partitionBytes`` (64 MB).
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "file string, name string, bytes long, content binary, fault string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArchiveReader(self.options["path"], int(self.options.get("mostBytes", 50 << 20)), int(self.options.get("partitionBytes", 64 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(ArchiveSource)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("workbook").load(path)


def read_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("archive").options(**options).load(path)


def workbook_fields(rows: DataFrame, headers: dict[str, str], statuses: tuple[str, ...], key) -> DataFrame:
    """Cells by field: file, sheet, row and a map ``fields``.

    ``headers`` gives the field of a header as ``key`` folds it.  Where no column of a sheet is the status, a sheet that is
    called like one of the ``statuses`` gives it.
    """
    names = F.create_map(*(F.lit(x) for kv in headers.items() for x in kv))
    known = F.filter(F.map_entries("cells"), lambda e: names[key(e["key"])].isNotNull())
    found = F.transform(known, lambda e: F.struct(names[key(e["key"])].alias("key"), e["value"].alias("value")))
    # of several headers of one field the last counts, as in reading from left to right
    distinct = F.aggregate(found, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    titled = F.when(F.lower(F.trim("sheet_name")).isin(*statuses), F.col("sheet_name"))
    fields = F.when(titled.isNotNull() & ~F.map_contains_key(F.col("fields"), "status"), F.map_concat("fields", F.create_map(F.lit("status"), titled))).otherwise(F.col("fields"))
    return rows.where("fault IS NULL").withColumn("fields", distinct).select("file", "sheet", "row", fields.alias("fields"))


def resolve_references(references: DataFrame, entries: DataFrame, name: str = "ref") -> DataFrame:
    """``references`` (file, ref and more) with ``entry``: the entry of the same archive at that very path, else the last one with
    the same base name, else null and ``missing`` true (A33).  Damaged entries resolve nothing."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    whole = entries.where("fault IS NULL").select("file", F.col("name").alias("entry"))
    by_path = whole.withColumn(name, F.col("entry"))
    by_base = whole.groupBy("file", base(F.col("entry")).alias("_base")).agg(F.max("entry").alias("_near"))
    out = references.join(by_path, ["file", name], "left").withColumn("_base", base(F.col(name))).join(by_base, ["file", "_base"], "left")
    entry: Column = F.coalesce("entry", "_near")
    return out.withColumn("entry", entry).withColumn("missing", entry.isNull()).drop("_base", "_near")
