"""CSV files with differing headers."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowsieve.functions.text import UNICODE_SPACE
from rowsieve.operators.small import join_small
from rowsieve.operators.columns import AUDIT, header_key, merge_headers, quoted
from rowsieve.sources.files import open_input, plain_path, task_count
from rowsieve.sources.records import cells_of, find_records

HEAD_BYTES = 1 << 16
MAX_HEAD = 1 << 26
HEADER_SCHEMA = "path string, file_ord int, header array<string>, error string"


def first_record(stream) -> list[str]:
    """The first non-empty record, known to be whole once another one follows it.

    Each turn doubles what is read; a record that does not end within ``MAX_HEAD`` bytes is
    an error.
    """
    head = b""
    while True:
        more = stream.read(max(HEAD_BYTES, len(head)))
        head += more
        text = io.StringIO(head.decode("utf-8-sig", errors="ignore"), newline="")
        records = (r for r in csv.reader(text) if r)
        first, following = next(records, []), next(records, None)
        if following is not None or not more:
            return first
        if len(head) >= MAX_HEAD:
            raise ValueError(f"the first record does not end within {MAX_HEAD} bytes")


def read_headers(spark: SparkSession, files: DataFrame, count: int) -> DataFrame:
    """Header of every file, read by tasks that open each file's beginning only."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, file_ord in zip(batch["path"], batch["file_ord"]):
                header, error = [], None
                try:
                    with open_input(path) as stream:
                        header = first_record(stream)
                except Exception as e:  # reported as this file's outcome
                    error = f"{type(e).__name__}: {e}"
                out.append((path, file_ord, header, error))
            yield pd.DataFrame(out, columns=["path", "file_ord", "header", "error"])

    spread = files.select("path", "file_ord").repartition(task_count(spark, count))
    return spread.mapInPandas(heads, HEADER_SCHEMA)


def usable_header(header) -> list[tuple[int, str]]:
    """(position, trimmed name) of the columns that count: named, first of their name."""
    seen, out = set(), []
    for i, raw in enumerate(header):
        name = (raw or "").strip(UNICODE_SPACE)
        if name and name.lower() not in AUDIT and name.lower() not in seen:
            seen.add(name.lower())
            out.append((i, name))
    return out


def read_csv(spark: SparkSession, files: DataFrame, headers: DataFrame, shapes) -> tuple[DataFrame, DataFrame, str]:
    """(all CSV files of ``files`` as one frame with lineage, broken files, the staged copy it reads).

    ``headers`` come from ``read_headers``, ``shapes`` are the distinct ones with the
    first ``file_ord`` of each: they decide the columns. Columns are read by position
    and named afterwards, so headers that differ in case or repeat never confuse the
    reader. One scan serves all files, whatever their size: it finds records by many
    tasks, parses each at about the width of its own header and then takes each cell from
    the place that the header gives. All cells are text. Broken files (``_file_ord``,
    ``_broken``) give no rows.
    """
    ordered = [h["header"] for h in sorted(shapes, key=lambda h: h["file_ord"])]
    columns = merge_headers(ordered)
    at = {header_key(c): j for j, c in enumerate(columns)}
    places = []
    for header in ordered:
        place = [0] * len(columns)  # 1-based; 0 for a column the file lacks
        for i, name in usable_header(header):
            place[at[header_key(name)]] = i + 1
        places.append((header, place))
    shape = spark.createDataFrame(places, "header array<string>, _places array<int>").withColumn("_width", F.size("header"))
    placed = headers.join(shape, "header").select(
        plain_path(F.col("path")).alias("_file"), F.col("file_ord").alias("_file_ord"), "_places", "_width"
    )
    paths = [r["path"] for r in files.join(headers.select("file_ord"), "file_ord", "left_semi").select("path").collect()]
    records, broken, staged = find_records(spark, paths)
    cells = cells_of(join_small(records, placed, "_file"), map(len, ordered))
    rows = cells.selectExpr(
        "_file", "_file_ord", "'' AS _sheet", "0 AS _sheet_ord", "_row",
        *[f"get(_cells, get(_places, {j}) - 1) AS {quoted(c)}" for j, c in enumerate(columns)],
    )
    return rows, placed.join(broken, "_file").select("_file_ord", "_broken"), staged
