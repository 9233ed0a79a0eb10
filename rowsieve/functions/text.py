"""Text functions shared by all operators; every one is a built-in expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

# The Unicode White_Space characters.
UNICODE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def utrim(c: Column) -> Column:
    """Strip Unicode white space at both ends (Spark's plain trim knows only U+0020)."""
    return F.btrim(c, F.lit(UNICODE_SPACE))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return utrim(or_empty(c)) == ""


def canon_str(c: Column, dtype: T.DataType) -> Column:
    """A cell as text: whole floating-point numbers print without a fraction."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def norm_key(c: Column, case_sensitive: bool = False) -> Column:
    trimmed = utrim(or_empty(c))
    return trimmed if case_sensitive else F.lower(trimmed)


def compact_key(key: Column) -> Column:
    """Same grouping as ``key`` with 32 bytes to shuffle, however long it is."""
    return F.unhex(F.sha2(key, 256))


def parse_list(text: str) -> list[str]:
    """Names typed as one text: split on comma, semicolon and line ends."""
    return [part for part in (p.strip(UNICODE_SPACE) for p in re.split(r"[,;\n\r]", text)) if part]


def parse_delimiters(text: str) -> str:
    """Delimiters typed as one text: white space between them does not count."""
    return "".join(ch for ch in text if ch not in UNICODE_SPACE)
