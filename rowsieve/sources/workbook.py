"""Workbooks (.xlsx, .xlsm): sheets listed and read by one task per sheet."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, types as T

from rowsieve.sources.csv import usable_header
from rowsieve.sources.files import open_input, task_count

BATCH_ROWS = 4096
ROW_BITS = 33
SHEETS_SCHEMA = (
    "path string, file_ord int, sheet string, sheet_ord int, member string, "
    "header array<string>, error string"
)

# Built-in number formats that show a date or time, and format letters that do.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DATE_LETTERS = re.compile(r"[dmyhs]", re.I)
FORMAT_LITERALS = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')


def tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def elements(book: zipfile.ZipFile, member: str, *wanted: str):
    """Elements of a zip member as they are completed, each taken out of its parent, so
    that what was handled is freed."""
    if member not in book.namelist():
        return
    with book.open(member) as xml:
        above = []
        for event, element in iterparse(xml, ("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if tag(element) in wanted:
                yield element
                if above:
                    above[-1].remove(element)


def sheet_members(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, zip member) in tab order."""
    targets = {
        r.get("Id"): r.get("Target") for r in elements(book, "xl/_rels/workbook.xml.rels", "Relationship")
    }
    out = []
    for sheet in elements(book, "xl/workbook.xml", "sheet"):
        ids = [v for k, v in sheet.attrib.items() if k.endswith("}id")]
        target = targets[ids[0]]
        out.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else "xl/" + target))
    return out


def text_in(element) -> str:
    """Text of a rich or plain string, without phonetic hints."""
    if tag(element) == "rPh":
        return ""
    own = element.text or "" if tag(element) == "t" else ""
    return own + "".join(text_in(child) for child in element)


def date_styles(book: zipfile.ZipFile) -> set[int]:
    custom, styles = set(), set()
    for element in elements(book, "xl/styles.xml", "numFmt", "cellXfs"):
        if tag(element) == "numFmt":
            if DATE_LETTERS.search(FORMAT_LITERALS.sub("", element.get("formatCode") or "")):
                custom.add(int(element.get("numFmtId")))
        else:
            ids = [int(xf.get("numFmtId") or 0) for xf in element]
            styles = {i for i, n in enumerate(ids) if n in DATE_FORMATS or n in custom}
    return styles


def number_text(raw: str, is_date: bool, epoch: datetime) -> str:
    value = float(raw)
    if is_date:
        # Days 1 to 59 count from a day later: the format knows a 29 February 1900.
        shift = 1 if epoch.year == 1899 and value < 60 else 0
        at = epoch + timedelta(days=shift, seconds=round(value * 86400))
        return at.strftime("%Y-%m-%d" if value == int(value) else "%Y-%m-%d %H:%M:%S")
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def column_index(ref: str) -> int:
    index = 0
    for ch in ref:
        if not ch.isalpha():
            break
        index = index * 26 + ord(ch.upper()) - 64
    return index - 1


class Sheet:
    """Cell texts of one sheet, row by row."""

    def __init__(self, book: zipfile.ZipFile, member: str):
        self.book, self.member = book, member
        properties = list(elements(book, "xl/workbook.xml", "workbookPr"))
        dates_1904 = any(p.get("date1904") in ("1", "true") for p in properties)
        self.epoch = datetime(1904, 1, 1) if dates_1904 else datetime(1899, 12, 30)
        self.dates = date_styles(book)
        self._shared: list[str] | None = None

    @property
    def shared(self) -> list[str]:
        if self._shared is None:
            self._shared = [text_in(si) for si in elements(self.book, "xl/sharedStrings.xml", "si")]
        return self._shared

    def cell(self, c) -> str | None:
        kind = c.get("t") or "n"
        if kind == "inlineStr":
            return "".join(text_in(child) for child in c)
        raw = next((child.text for child in c if tag(child) == "v"), None)
        if raw is None:
            return None
        if kind == "s":
            return self.shared[int(raw)]
        if kind == "b":
            return "True" if raw == "1" else "False"
        if kind == "n":
            return number_text(raw, int(c.get("s") or 0) in self.dates, self.epoch)
        return raw

    def rows(self) -> Iterator[dict[int, str]]:
        for row in elements(self.book, self.member, "row"):
            cells, at = {}, -1
            for c in row:
                at = column_index(c.get("r")) if c.get("r") else at + 1
                value = self.cell(c)
                if value is not None:
                    cells[at] = value
            if cells:
                yield cells


def header_of(rows: Iterator[dict[int, str]]) -> list[str]:
    first = next(rows, {})
    return [first.get(i) or "" for i in range(max(first, default=-1) + 1)]


def list_sheets(spark: SparkSession, files: DataFrame, count: int) -> DataFrame:
    """One row per file and sheet with its header; a file that cannot be read gives one
    row with ``error``."""

    def inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "file_ord", "sheet", "sheet_ord", "member", "header", "error"]
        for batch in batches:
            for path, file_ord in zip(batch["path"], batch["file_ord"]):
                out = []
                try:
                    with open_input(path) as stream, zipfile.ZipFile(stream) as book:
                        for i, (name, member) in enumerate(sheet_members(book)):
                            out.append((path, file_ord, name, i, member, header_of(Sheet(book, member).rows()), None))
                except Exception as e:  # reported as this file's outcome
                    out = [(path, file_ord, None, None, None, None, f"{type(e).__name__}: {e}")]
                frame = pd.DataFrame(out, columns=columns)
                yield frame.astype({"sheet_ord": "Int32"})

    spread = files.select("path", "file_ord").repartition(task_count(spark, count))
    return spread.mapInPandas(inspect, SHEETS_SCHEMA)


def read_sheets(spark: SparkSession, sheets: DataFrame, columns: list[str], count: int) -> DataFrame:
    """Rows of the given sheets with lineage, under ``columns``; all cells are text.

    A sheet is opened by its own task, which reads that sheet's part of the
    workbook only and passes rows on in batches. Where decoding fails, the last row
    of the sheet holds nothing but ``_error``.
    """
    lineage = ["_error", "_file", "_file_ord", "_sheet", "_sheet_ord", "_row"]
    positions = {c.lower(): i for i, c in enumerate(columns)}
    schema = T.StructType(
        [
            T.StructField("_error", T.StringType()),
            T.StructField("_file", T.StringType()), T.StructField("_file_ord", T.IntegerType()),
            T.StructField("_sheet", T.StringType()), T.StructField("_sheet_ord", T.IntegerType()),
            T.StructField("_row", T.LongType()), *[T.StructField(c, T.StringType()) for c in columns],
        ]
    )

    def decode_sheet(s) -> Iterator[list]:
        origin = [s.path, s.file_ord, s.sheet, s.sheet_ord]
        n = 0
        try:
            with open_input(s.path) as stream, zipfile.ZipFile(stream) as book:
                rows = Sheet(book, s.member).rows()
                places = [(i, positions[n.lower()]) for i, n in usable_header(header_of(rows))]
                for n, cells in enumerate(rows):
                    values = [None] * len(columns)
                    for i, at in places:
                        values[at] = cells.get(i)
                    yield [None, *origin, (s.sheet_ord << ROW_BITS) | n, *values]
        except Exception as e:  # reported as this file's outcome
            yield [f"{type(e).__name__}: {e}", *origin, (s.sheet_ord << ROW_BITS) | n, *[None] * len(columns)]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples(index=False):
                rows = decode_sheet(s)
                while out := list(islice(rows, BATCH_ROWS)):
                    yield pd.DataFrame(out, columns=lineage + columns)

    spread = sheets.select("path", "file_ord", "sheet", "sheet_ord", "member").repartition(
        task_count(spark, count), "path", "sheet_ord"
    )
    return spread.mapInPandas(decode, schema)
