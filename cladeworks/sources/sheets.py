"""Workbooks as a data source: `spark.read.format("sheets")`.

After `register(spark)`, a path, a list of paths by commas, a folder's pattern or an http(s) address is read by tasks, each of which takes some rows of one sheet.
A task scans the sheet as a stream up to its rows and parses only those, so it holds a row at a time besides the workbook's table of strings.

Options: sheets (names or numbers from 1, comma-separated; all of them by default), headers (a JSON list: the headers of the schema's columns in order; by default the columns' own names),
rows (rows of a task, 20,000 by default), tries (downloads are tried so often). With a schema only its columns are read; without one there are all headers of the first sheet, as strings.
A header that a sheet doesn't have is an error; a value that its type can't hold is null. The column `_sheet`, if the schema has it, is the name of the sheet.
"""

from __future__ import annotations

import glob
import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cladeworks.sources.artifacts import fetch

ROWS = 20_000
READ = 1 << 20
ROW = re.compile(rb"<((?:\w+:)?)row\b(?:[^>]*/>|.*?</\1row>)", re.S)
TAG = re.compile(r"^\{[^}]*\}")
SHEET = "_sheet"


@dataclass
class Rows(InputPartition):
    path: str
    part: str
    sheet: str
    first: int  # rows behind the header
    last: int


def opened(path: str, tries: int) -> zipfile.ZipFile:
    """A workbook, from an address, from the machine's files or from a store that pyarrow knows."""
    if re.match("https?://", path):
        return zipfile.ZipFile(io.BytesIO(fetch(path, tries)))
    if re.match(r"\w+://", path):
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(path)
        return zipfile.ZipFile(io.BytesIO(store.open_input_stream(inside).read()))
    return zipfile.ZipFile(path)


def _plain(element: ElementTree.Element) -> str:
    return TAG.sub("", element.tag)


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part of the archive) of the sheets in the workbook's order."""
    names = book.namelist()
    numbered = sorted((x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.search(r"\d+", x)[0]))
    if "xl/workbook.xml" not in names:
        return [(f"sheet{i + 1}", x) for i, x in enumerate(numbered)]
    sheets = [x for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _plain(x) == "sheet"]
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            target = x.get("Target", "")
            targets[x.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    out = []
    for i, x in enumerate(sheets):
        link = next((v for k, v in x.attrib.items() if TAG.sub("", k) == "id"), None)
        out.append((x.get("name", f"sheet{i + 1}"), targets.get(link) or numbered[i]))
    return out


def strings_of(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    shared = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in x.iter() if _plain(t) == "t") for x in shared if _plain(x) == "si"]


def raw_rows(book: zipfile.ZipFile, part: str) -> Iterator[bytes]:
    """The rows of a sheet as they are written, one after the other."""
    held = b""
    with book.open(part) as stream:
        while piece := stream.read(READ):
            held += piece
            end = 0
            for m in ROW.finditer(held):
                yield m[0]
                end = m.end()
            held = held[end:]


def cells(raw: bytes, strings: list[str]) -> dict[str, str]:
    """Column letters and values of a row."""
    text = re.sub(rb"(</?)\w+:", rb"\1", raw)  # prefixes have no meaning outside of the document
    text = re.sub(rb"\s\w+:\w+=\"[^\"]*\"", b"", text)
    out = {}
    for cell in ElementTree.fromstring(text).iter("c"):
        letters = re.match("[A-Z]+", cell.get("r", "A"))[0]
        value = cell.find("v")
        if cell.get("t") == "inlineStr":
            out[letters] = "".join(x.text or "" for x in cell.iter("t"))
        elif value is not None and value.text is not None:
            out[letters] = strings[int(value.text)] if cell.get("t") == "s" else value.text
    return out


def typed(text: str | None, kind: T.DataType):
    """A value of a type, null where the text is none."""
    if text is None:
        return None
    try:
        if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
            number = float(text)
            return int(number) if number == int(number) else None
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(text)
        if isinstance(kind, T.BooleanType):
            return {"1": True, "true": True, "0": False, "false": False}.get(text.strip().lower())
    except (ValueError, OverflowError):
        return None
    return text


class SheetReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.wanted = options, schema

    def _headers(self) -> list[str]:
        names = [f.name for f in self.wanted.fields if f.name != SHEET]
        headers = json.loads(self.options["headers"]) if "headers" in self.options else names
        if len(headers) != len(names):
            raise ValueError("headers must name a header for each column")
        return headers

    def partitions(self) -> list[Rows]:
        out = []
        step = int(self.options.get("rows", ROWS))
        for path in paths(self.options):
            with opened(path, int(self.options.get("tries", 3))) as book:
                for name, part in chosen(book, self.options):
                    n = max(0, sum(1 for _ in raw_rows(book, part)) - 1)
                    out += [Rows(path, part, name, a, min(a + step, n)) for a in range(0, n, step)] or [Rows(path, part, name, 0, 0)]
        return out

    def read(self, partition: Rows) -> Iterator[tuple]:
        with opened(partition.path, int(self.options.get("tries", 3))) as book:
            strings = strings_of(book)
            rows = raw_rows(book, partition.part)
            at = {text: letters for letters, text in cells(next(rows, b"<row/>"), strings).items()}
            headers = self._headers()
            missing = sorted(set(headers) - set(at))
            if missing:
                raise ValueError(f"columns {missing} are not in sheet {partition.sheet!r} of {partition.path}")
            of = dict(zip([f.name for f in self.wanted.fields if f.name != SHEET], headers))
            for number, raw in enumerate(rows):
                if number >= partition.last:
                    return
                if number >= partition.first:
                    row = cells(raw, strings)
                    yield tuple(partition.sheet if f.name == SHEET else typed(row.get(at[of[f.name]]), f.dataType) for f in self.wanted.fields)


def paths(options: dict) -> list[str]:
    out = []
    for path in options.get("path", "").split(","):
        found = sorted(glob.glob(path)) if path and not re.match(r"\w+://", path) else [path]
        if not path or not found:
            raise FileNotFoundError(f"no workbook at {path!r}")
        out += found
    return out


def chosen(book: zipfile.ZipFile, options: dict) -> list[tuple[str, str]]:
    sheets = sheet_parts(book)
    if "sheets" not in options:
        return sheets
    named = dict(sheets)
    out = []
    for want in options["sheets"].split(","):
        if want.isdigit() and want not in named and 1 <= int(want) <= len(sheets):
            out.append(sheets[int(want) - 1])
        elif want in named:
            out.append((want, named[want]))
        else:
            raise ValueError(f"sheet {want!r} is not in the workbook, which has {sorted(named)}")
    return out


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> T.StructType:
        with opened(paths(self.options)[0], int(self.options.get("tries", 3))) as book:
            sheets = chosen(book, self.options)
            header = cells(next(raw_rows(book, sheets[0][1]), b"<row/>"), strings_of(book)) if sheets else {}
        return T.StructType([T.StructField(name, T.StringType()) for name in header.values()])

    def reader(self, schema: T.StructType) -> SheetReader:
        return SheetReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SheetSource)
