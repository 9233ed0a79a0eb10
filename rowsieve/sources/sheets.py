"""Which sheets of a file are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowsieve.functions.text import UNICODE_SPACE
from rowsieve.spec import CleanseSpec, SheetMode


def matches_pattern(name: Column, pattern: str) -> Column:
    """Without case; ``*`` stands for any text, every other character for itself."""
    pattern = pattern.strip(UNICODE_SPACE)
    if "*" not in pattern:
        return F.lower(name) == F.lower(F.lit(pattern))
    literal = [p.replace("\\E", "\\E\\\\E\\Q") for p in pattern.split("*")]
    return name.rlike("(?iu)^" + ".*".join(f"\\Q{p}\\E" if p else "" for p in literal) + "$")


def matches_any(name: Column, patterns) -> Column:
    used = [p for p in patterns if p.strip(UNICODE_SPACE)]
    tests = [matches_pattern(name, p) for p in used]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def select_sheets(sheets: DataFrame, spec: CleanseSpec, file: str, sheet: str, ord_col: str) -> DataFrame:
    """The sheets ``spec`` asks for, out of one row per file and sheet."""
    if spec.sheets is SheetMode.ALL:
        return sheets
    by_file = Window.partitionBy(file).orderBy(ord_col)
    if spec.sheets is SheetMode.FIRST_N:
        kept = sheets.withColumn("_n", F.row_number().over(by_file)).filter(F.col("_n") <= max(1, spec.first_n))
        return kept.drop("_n")
    named = sheets.filter(matches_any(F.col(sheet), spec.sheet_patterns))
    once = Window.partitionBy(file, F.lower(sheet)).orderBy(ord_col)
    return named.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
