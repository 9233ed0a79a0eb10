"""Row hygiene before validation: blank rows and multi-value cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rowsieve.functions.text import utrim
from rowsieve.operators.columns import blank_test, col_ref, find_column, is_text, text_of

PART = "_part"


def drop_blank_rows(df: DataFrame, columns) -> DataFrame:
    """Keep rows in which at least one of ``columns`` holds more than white space.

    Columns that are not text come first: a look at one of them mostly settles it.
    """
    filled = [~blank_test(df, c) for c in sorted(columns, key=lambda c: is_text(df, find_column(df, c)))]
    return df.filter(reduce(lambda a, b: a | b, filled)) if filled else df


def delimiter_class(delimiters: str) -> str:
    """Regular-expression class of the given characters, each taken literally."""
    return "[" + "".join(d if d.isalnum() else "\\" + d for d in delimiters) + "]"


def explode_multi(df: DataFrame, column: str, delimiters: str) -> DataFrame:
    """One row per non-blank part of ``column``; ``_part`` counts them from 0.

    A cell with fewer than two parts keeps its row and its value as they are.
    """
    found = find_column(df, column)
    if found is None or not delimiters:
        return df.withColumn(PART, F.lit(0))
    text = text_of(df, found)
    parts = F.filter(
        F.transform(F.split(text, delimiter_class(delimiters)), utrim), lambda p: p != ""
    )
    cells = df.withColumn("_parts", parts).withColumn(
        "_parts", F.when(F.size("_parts") > 1, F.col("_parts")).otherwise(F.array(text))
    )
    rest = [col_ref(c) for c in df.columns if c != found]
    return cells.select(*rest, F.posexplode("_parts").alias(PART, found)).select(
        *[col_ref(c) for c in df.columns], PART
    )
