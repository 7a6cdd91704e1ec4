"""Workbooks (XLSX, first sheet) as a Spark data source: one task per file of a folder."""

from __future__ import annotations

import datetime
import json
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from plumbline.session import InputError, ship
from plumbline.sources.arrow import Stretch, files_under, open_file
from plumbline.sources.listing import headers, listed, merged, plain_path, tasks_for

ship(__name__)

# Fixed values of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_STYLES = {*range(14, 23), 45, 46, 47}
EPOCH = datetime.datetime(1899, 12, 30)
ROWS = 2000               # rows of one Arrow batch


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets/{MAIN}sheet")
    for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == sheet.get(REL):
            return "xl/" + rel.get("Target").removeprefix("/xl/").removeprefix("xl/")
    raise InputError("the workbook has no first sheet")


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t"))
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Positions of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt")
           if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode").lower()))}
    styles = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId", 0)) in DATE_STYLES | own}


def _column(reference: str) -> int:
    at = 0
    for letter in re.match("[A-Z]+", reference).group():
        at = at * 26 + ord(letter) - 64
    return at - 1


def _text(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    value = cell.find(f"{MAIN}v")
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind is None and int(cell.get("s", 0)) in dates:
        return (EPOCH + datetime.timedelta(days=float(value.text))).isoformat(sep=" ")
    return value.text


def sheet_rows(path: str):
    """The rows of the first sheet as lists of texts, read as a stream."""
    with open_file(path) as handle, zipfile.ZipFile(handle) as book:
        shared, dates = _shared_texts(book), _date_styles(book)
        with book.open(_first_sheet(book)) as sheet:
            table = None
            for event, element in ElementTree.iterparse(sheet, ("start", "end")):
                if event == "start":
                    table = element if element.tag == f"{MAIN}sheetData" else table
                    continue
                if element.tag != f"{MAIN}row":
                    continue
                row: list[str | None] = []
                for i, cell in enumerate(element.iter(f"{MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else i
                    row += [None] * (at + 1 - len(row))
                    row[at] = _text(cell, shared, dates)
                (element if table is None else table).clear()          # else all rows stay, emptied
                yield row


def column_names(header: list[str | None]) -> list[str]:
    """A name for every column: nameless ones by place, repeated ones by number."""
    names: list[str] = []
    for i, name in enumerate(header):
        base = name or f"column_{i}"
        name, n = base, 2
        while name in names:
            name, n = f"{base}_{n}", n + 1
        names.append(name)
    return names


def _header(path: str) -> tuple[bytes, int]:
    return json.dumps(column_names(next(sheet_rows(path), []))).encode(), 1


def _united(headers: list[bytes]) -> bytes:
    """All names in the order they are met."""
    return json.dumps(list(dict.fromkeys(name for h in headers for name in json.loads(h)))).encode()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of all workbooks under a path as texts, with the columns of
    all of them. Tasks read the headers and then the rows, a workbook each."""
    import pyarrow as pa

    found = headers(listed(spark, path, (".xlsx",)), _header, "workbook_headers")
    whole = merged(found, _united)
    names = json.loads(whole) if whole is not None else []
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    if not names:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                rows = WorkbookReader(path, names).read(Stretch(plain_path(at), 0, None))
                while some := list(islice(rows, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], names=names)

    return found.select("path").repartition(tasks_for(spark, found, found.count()), "path").mapInArrow(read, schema)


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self):
        return [Stretch(path, 0, None) for path, _ in files_under(self.path, (".xlsx",))]

    def read(self, part):
        rows = sheet_rows(part.path)
        header = column_names(next(rows, []))
        at = [header.index(n) if n in header else None for n in self.names]
        for row in rows:
            if any(v is not None for v in row):
                yield tuple(row[i] if i is not None and i < len(row) else None for i in at)


class Workbooks(DataSource):
    """The columns are those of all files together, in the order they are met."""

    @classmethod
    def name(cls):
        return "plumbline_workbooks"

    def schema(self):
        names: dict[str, None] = {}
        for path, _ in files_under(self.options["path"], (".xlsx",)):
            names.update(dict.fromkeys(column_names(next(sheet_rows(path), []))))
        return T.StructType([T.StructField(name, T.StringType()) for name in names])

    def reader(self, schema):
        return WorkbookReader(self.options["path"], schema.names)
