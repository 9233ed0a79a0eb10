"""Reading files of all kinds into one frame with lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowsieve.functions.names import extension
from rowsieve.functions.text import utrim
from rowsieve.operators.small import join_small
from rowsieve.operators.columns import check_names, merge_headers, quoted
from rowsieve.operators.dedup import order_key
from rowsieve.session import checkpointed, scratch_path, stage
from rowsieve.sources.csv import read_csv, read_headers
from rowsieve.sources.files import CSV_EXTENSIONS, SAME_NAME, list_files, plain_path
from rowsieve.sources.sheets import select_sheets
from rowsieve.sources.workbook import ROW_BITS, list_sheets, read_sheets
from rowsieve.spec import CleanseSpec

LINEAGE_COLUMNS = ("_file", "_file_ord", "_sheet", "_sheet_ord", "_row")


@dataclass
class Sources:
    """Files found, what each offers, and their rows."""

    rows: DataFrame | None
    outcomes: DataFrame  # file, error, note, sheets_selected
    columns: list[str]
    headers: DataFrame  # _file_ord, _sheet_ord, _pos, header
    sheets: DataFrame  # _file, _file_ord, _sheet, _row: where each sheet read begins
    nbytes: int  # size of all files
    scratch: list[str]  # staged copies that ``rows`` reads


def scan_headers(headers: DataFrame) -> DataFrame:
    """Distinct headers (trimmed, without case) with the file and place (``first_at``)
    where each was first met; sorting by the place gives the order of encounter."""
    place = order_key(headers, ["_file_ord", "_sheet_ord", "_pos"])
    spellings = (
        headers.filter(F.col("header") != "")
        .select("header", "_file_ord", place.alias("_at"))
        .groupBy("header")
        .agg(F.min("_at").alias("_at"), F.min("_file_ord").alias("_file_ord"))
    )
    return spellings.groupBy(F.lower("header").alias("_key")).agg(
        F.min_by("header", "_at").alias("header"),
        F.min("_file_ord").alias("file_ord"),
        F.min("_at").alias("first_at"),
    ).drop("_key")


def read_sources(spark: SparkSession, paths: list[str], spec: CleanseSpec = CleanseSpec()) -> Sources:
    """All admitted files under ``paths``: CSV files and the selected sheets of workbooks.

    File lists and distinct headers are read first; they are plan input.
    Missing and unreadable files are reported and give no rows.
    """
    files, left = list_files(spark, paths)
    found = files.collect()
    is_csv = extension(F.col("path")).isin(*CSV_EXTENSIONS)
    csv_files, books = files.filter(is_csv), files.filter(~is_csv)
    n_csv = sum(r["path"].lower().endswith(CSV_EXTENSIONS) for r in found)

    csv_heads = checkpointed(read_headers(spark, csv_files, n_csv))
    csv_good = csv_heads.filter(F.col("error").isNull())
    csv_bad = csv_heads.filter(F.col("error").isNotNull()).collect()
    shapes = csv_good.groupBy("header").agg(F.min("file_ord").alias("file_ord")).collect()
    sheets = list_sheets(spark, books, len(found) - n_csv).collect() if n_csv < len(found) else []
    schema = "path string, file_ord int, sheet string, sheet_ord int, member string, header array<string>, error string"
    chosen = []
    if any(s["error"] is None for s in sheets):
        listed = spark.createDataFrame([s for s in sheets if s["error"] is None], schema)
        picked = select_sheets(listed, spec, "file_ord", "sheet", "sheet_ord")
        chosen = sorted(picked.collect(), key=lambda s: (s["file_ord"], s["sheet_ord"]))

    heads = sorted(
        [(h["file_ord"], 0, h["header"]) for h in shapes]
        + [(s["file_ord"], s["sheet_ord"], s["header"]) for s in chosen],
        key=lambda h: h[:2],
    )
    errors = {h["file_ord"]: h["error"] for h in [*csv_bad, *sheets] if h["error"] is not None}
    scratch = []
    columns = merge_headers(h[2] for h in heads)
    check_names(columns)
    rows, broken_csv = None, {}
    if shapes:
        rows, broken, staged = read_csv(spark, csv_files, csv_good, shapes)
        scratch.append(staged)
        broken_csv = {b["_file_ord"]: b["_broken"] for b in broken.collect()}
        errors |= broken_csv
    if chosen:
        own = merge_headers(s["header"] for s in chosen)
        frame = read_sheets(spark, spark.createDataFrame(chosen, schema), own, len(chosen))
        # Decoding is dear: it happens once. A file with an unreadable sheet gives no rows.
        scratch.append(scratch_path(spark, "workbooks"))
        decoded = stage(frame, scratch[-1])
        broken = decoded.filter(F.col("_error").isNotNull()).groupBy("_file_ord").agg(F.min("_error").alias("_broken"))
        found_broken = broken.collect()
        if found_broken:
            decoded = join_small(decoded, broken, "_file_ord").filter(F.col("_broken").isNull()).drop("_broken")
        errors |= {b["_file_ord"]: b["_broken"] for b in found_broken}
        frame = decoded.drop("_error").withColumn("_file", plain_path(F.col("_file")))
        rows = frame if rows is None else rows.unionByName(frame, allowMissingColumns=True)
    if rows is not None:
        by_key = {c.lower(): c for c in rows.columns}
        rows = rows.selectExpr(*LINEAGE_COLUMNS, *[f"{quoted(by_key[c.lower()])} AS {quoted(c)}" for c in columns])

    picked_per_file: dict[int, int] = {}
    for s in chosen:
        picked_per_file[s["file_ord"]] = picked_per_file.get(s["file_ord"], 0) + 1
    outcome = [
        (r["path"], errors.get(r["file_ord"]), None,
         int(r["file_ord"] not in broken_csv) if r["path"].lower().endswith(CSV_EXTENSIONS) else picked_per_file.get(r["file_ord"], 0))
        for r in found
    ]
    # A file that another one hides was never tried; all others that are left out have failed.
    outcome += [(p, None, why, 0) if why == SAME_NAME else (p, why, None, 0) for p, why in left.items()]
    outcomes = spark.createDataFrame(outcome, "file string, error string, note string, sheets_selected int")
    outcomes = outcomes.withColumn("file", plain_path(F.col("file")))
    # The scan for headers falls back to a workbook's first sheet if none was selected.
    shown = [(s["file_ord"], s["sheet_ord"], s["header"]) for s in chosen] + [
        (s["file_ord"], s["sheet_ord"], s["header"])
        for s in sheets
        if s["error"] is None and s["sheet_ord"] == 0 and s["file_ord"] not in picked_per_file
    ]
    of_sheets = spark.createDataFrame(shown, "_file_ord int, _sheet_ord int, header array<string>")
    all_heads = of_sheets.unionByName(
        csv_good.select(F.col("file_ord").alias("_file_ord"), F.lit(0).alias("_sheet_ord"), "header")
    )
    headers = all_heads.select("_file_ord", "_sheet_ord", F.posexplode("header").alias("_pos", "header")).withColumn(
        "header", utrim(F.col("header"))
    )
    begins = [
        (s["path"], s["file_ord"], s["sheet"], s["sheet_ord"] << ROW_BITS) for s in chosen if s["file_ord"] not in errors
    ]
    csv_read = csv_good.filter(~F.col("file_ord").isin(*broken_csv)) if broken_csv else csv_good
    starts = spark.createDataFrame(begins, "_file string, _file_ord int, _sheet string, _row bigint").unionByName(
        csv_read.select(
            F.col("path").alias("_file"), F.col("file_ord").alias("_file_ord"),
            F.lit("").alias("_sheet"), F.lit(0).cast("bigint").alias("_row"),
        )
    )
    return Sources(rows, outcomes, columns, headers, starts, sum(r["length"] for r in found), scratch)
