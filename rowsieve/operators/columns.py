"""Column lookup by name and projection onto a common column list."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowsieve.functions.text import UNICODE_SPACE, canon_str, is_blank
from rowsieve.spec import Lineage, SpecError

log = logging.getLogger(__name__)

# Names of the audit columns; input columns of these names are dropped.
SOURCE, REASON = "_Source", "_Reason"
AUDIT = frozenset({SOURCE.lower(), REASON.lower()})

# Names the library gives to columns while it works; no input column may have one.
INTERNAL = frozenset(
    "_at _base _bit _bits _block _bucket _bucket_key _bucket_name _bucket_pos _cells _chunk _competes _error _file _file_ord "
    "_first _from _given _key _kind _line _n _part _parts _path_key _pid _piece _pos _rank _read _rid _rn _row _run "
    "_salt _scope _scope_file _sheet _sheet_key _sheet_ord _shift _status _stem".split()
)


def check_names(columns) -> None:
    """Refuse names that would be lost or mixed up on the way."""
    taken = sorted({c for c in columns if header_key(c) in INTERNAL or re.fullmatch("_k[0-9]+|_in[0-9]+", header_key(c))})
    if taken:
        raise SpecError(f"columns {taken} are reserved; rename them first")


def header_key(name: str) -> str:
    return name.strip(UNICODE_SPACE).lower()


def quoted(name: str) -> str:
    """``name`` in SQL text. Thousands of columns are selected as text: each ``Column`` takes milliseconds."""
    return "`" + name.replace("`", "``") + "`"


def col_ref(name: str) -> Column:
    return F.col(quoted(name))


def find_column(df: DataFrame, name: str) -> str | None:
    """The frame's own spelling of ``name``: exact first, else trimmed and without case."""
    if not name:
        return None
    if name in df.columns:
        return name
    key = header_key(name)
    return next((c for c in df.columns if header_key(c) == key), None)


def resolve(df: DataFrame, name: str) -> Column:
    """The column called ``name``, or null (with a warning) where there is none."""
    found = find_column(df, name)
    if found is None:
        log.warning("column %r not found; its values count as empty", name)
        return F.lit(None).cast("string")
    return col_ref(found)


def text_of(df: DataFrame, name: str) -> Column:
    found = find_column(df, name)
    if found is None:
        return resolve(df, name)
    return canon_str(col_ref(found), df.schema[found].dataType)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def blank_test(df: DataFrame, name: str) -> Column:
    """Does the column hold nothing but white space? Only text can, unless it is null."""
    found = find_column(df, name)
    if found is None or is_text(df, found):
        return is_blank(text_of(df, name))
    return col_ref(found).isNull()


def drop_reserved(df: DataFrame) -> DataFrame:
    return df.drop(*[col_ref(c) for c in df.columns if header_key(c) in AUDIT])


def data_columns(df: DataFrame, lineage: Lineage) -> list[str]:
    hidden = set(lineage.columns)
    return [c for c in df.columns if c not in hidden]


def merge_headers(headers) -> list[str]:
    """Union of headers in first-encounter order, first spelling, blank names left out."""
    names: dict[str, str] = {}
    for header in headers:
        for name in header:
            trimmed = (name or "").strip(UNICODE_SPACE)
            if trimmed and trimmed.lower() not in AUDIT:
                names.setdefault(trimmed.lower(), trimmed)
    return list(names.values())


def conform(df: DataFrame, columns, keep=()) -> DataFrame:
    """``keep`` as it is, then exactly ``columns``, null where the frame lacks one."""
    return df.select(
        *[col_ref(c) for c in keep],
        *[
            (col_ref(found) if (found := find_column(df, c)) else F.lit(None).cast("string")).alias(c)
            for c in columns
        ],
    )


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """One frame over sources with differing headers; missing values are null."""
    columns = merge_headers(df.columns for df in frames)
    spelling = {header_key(c): c for c in columns}
    out = None
    for df in frames:
        own: dict[str, str] = {}
        for c in df.columns:
            if header_key(c) in spelling:
                own.setdefault(header_key(c), c)
        renamed = df.select(*[col_ref(c).alias(spelling[k]) for k, c in own.items()])
        out = renamed if out is None else out.unionByName(renamed, allowMissingColumns=True)
    return out.select(*[col_ref(c) for c in columns])


def with_types_as_text(df: DataFrame, columns) -> DataFrame:
    """``columns`` as text, so that sources of different types can be united."""
    wanted = set(columns)
    return df.select(
        *[
            canon_str(col_ref(f.name), f.dataType).alias(f.name)
            if f.name in wanted and not isinstance(f.dataType, T.StringType)
            else col_ref(f.name)
            for f in df.schema
        ]
    )
