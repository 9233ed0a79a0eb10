"""Names of sheets, files and runs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rowsieve.functions.text import is_blank, or_empty, utrim

# Limits and characters not allowed in sheet and file names.
SHEET_NAME_MAX = 31
SHEET_NAME_INVALID = "\\/?*[]:"
FILE_NAME_INVALID = r'["<>|:*?\\/\x00-\x1f]'


def clean_sheet_name(name: Column) -> Column:
    kept = F.translate(utrim(or_empty(name)), SHEET_NAME_INVALID, "_" * len(SHEET_NAME_INVALID))
    return F.when(is_blank(name), F.lit("Sheet")).otherwise(F.left(kept, F.lit(SHEET_NAME_MAX)))


def clean_file_name(name: Column) -> Column:
    return F.when(is_blank(name), F.lit("sheet")).otherwise(
        F.regexp_replace(name, FILE_NAME_INVALID, "_")
    )


def base_name(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def run_name(at: Column) -> Column:
    return F.concat(F.lit("Processed_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def two_digits(n: Column) -> Column:
    """At least two digits, never cut."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(2)), F.lit("0"))
