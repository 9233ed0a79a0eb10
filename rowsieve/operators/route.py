"""Routing of every row into the unique, duplicate or invalid bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowsieve.functions.rules import reason
from rowsieve.operators.buckets import attach_bucket_names, source_buckets, with_bucket
from rowsieve.operators.columns import REASON, SOURCE, check_names, col_ref, data_columns, drop_reserved, text_of
from rowsieve.operators.dedup import keep_first, library_made, mark_first, repeated, winners, with_keys
from rowsieve.operators.hygiene import PART, drop_blank_rows, explode_multi
from rowsieve.spec import CleanseSpec, KeyMode, Lineage

UNIQUE, DUPLICATE, INVALID = "unique", "duplicate", "invalid"
STATUS = "_status"
BUCKET = "_bucket"


def prepare(df: DataFrame, spec: CleanseSpec, lineage: Lineage, rules=(), blank_rows: bool = False) -> DataFrame:
    """Rows as read, without blank ones, exploded, labelled and checked.

    Adds ``_bucket``, ``_part`` and ``_Reason`` (null for a valid row). With
    ``blank_rows`` they stay in, for a caller that drops them in another way.
    """
    spec.check()
    rows = drop_reserved(df)
    columns = data_columns(rows, lineage)
    check_names(columns)
    if lineage.blank_rows and not blank_rows:
        rows = drop_blank_rows(rows, columns)
    if explodes(spec):
        rows = explode_multi(rows, spec.key_columns[0], spec.delimiters)
    else:
        rows = rows.withColumn(PART, F.lit(0))
    rows = with_bucket(rows, spec, lineage)
    target = spec.effective_validation_column
    if not (spec.validation or rules):
        return rows.withColumn(REASON, F.lit(None).cast("string"))
    return rows.withColumn(REASON, reason(text_of(rows, target), target, spec.validation, rules))


def explodes(spec: CleanseSpec) -> bool:
    return (
        spec.explode_multi
        and spec.key_mode in (KeyMode.SINGLE, KeyMode.MULTIPLE)
        and bool(spec.key_columns)
        and bool(spec.delimiters)
    )


def row_order(spec: CleanseSpec, lineage: Lineage) -> tuple[str, ...]:
    return (*lineage.order, PART) if explodes(spec) else tuple(lineage.order)


def scope_columns(spec: CleanseSpec, lineage: Lineage) -> dict:
    """Within what a key must be unique: sheet, file, both or nothing."""
    scope = {}
    if spec.keep_sheets:
        scope["_scope"] = F.lower(F.col(BUCKET))
    if spec.per_file and lineage.file:
        scope["_scope_file"] = F.col(lineage.file)
    return scope


def with_groups(df: DataFrame, spec: CleanseSpec, lineage: Lineage, rules=(), blank_rows: bool = False):
    """(prepared rows with key and scope columns, names of these, which rows compete).

    Invalid rows and rows with an empty key do not compete.
    """
    rows = prepare(df, spec, lineage, rules, blank_rows)
    columns = [c for c in data_columns(df, lineage) if c in rows.columns]
    keyed, keys, empty = with_keys(rows, spec, columns)
    scope = scope_columns(spec, lineage) if keys else {}
    keyed = keyed.withColumns(scope) if scope else keyed
    return keyed, [*scope, *keys], F.col(REASON).isNull() & ~empty


def cleanse(df: DataFrame, spec: CleanseSpec, lineage: Lineage, rules=()) -> DataFrame:
    """Every row of ``df`` with its ``_status``, ``_Reason``, ``_bucket`` and ``_part``.

    Validation comes first, so an invalid row never claims a key. ``df`` is read
    twice: keys and positions only to find the winners, then whole rows.
    """
    rows, group, competes = with_groups(df, spec, lineage, rules)
    is_invalid = F.col(REASON).isNotNull()
    if not group:
        return rows.withColumn(STATUS, F.when(is_invalid, F.lit(INVALID)).otherwise(F.lit(UNIQUE)))
    order = row_order(spec, lineage)
    # A row with a single non-empty key is not blank: its other columns need not be read.
    single = spec.key_mode is KeyMode.SINGLE
    contenders, _, _ = with_groups(df, spec, lineage, rules, blank_rows=single)
    first = winners(contenders.filter(competes), group, order)
    if not library_made(lineage.order):
        first = first.unionByName(repeated(df, lineage.order, first))
    marked = mark_first(rows, first, order)
    status = (
        F.when(is_invalid, F.lit(INVALID))
        .when(F.col("_first") | ~competes, F.lit(UNIQUE))
        .otherwise(F.lit(DUPLICATE))
    )
    return marked.withColumn(STATUS, status).drop("_first", *group)


def unique_rows(df: DataFrame, spec: CleanseSpec, lineage: Lineage, rules=()) -> DataFrame:
    """Only the unique and invalid rows of ``cleanse``: duplicates never leave their map task."""
    rows, group, competes = with_groups(df, spec, lineage, rules)
    kept = rows
    if group:
        flagged = rows.withColumn("_competes", competes)
        kept = keep_first(flagged, group, row_order(spec, lineage), F.col("_competes"))
    status = F.when(F.col(REASON).isNotNull(), F.lit(INVALID)).otherwise(F.lit(UNIQUE))
    return kept.withColumn(STATUS, status).drop("_competes", *group)


def user_columns(routed: DataFrame, lineage: Lineage) -> list[str]:
    own = {BUCKET, PART, REASON, STATUS}
    return [c for c in data_columns(routed, lineage) if c not in own]


def audit(rows: DataFrame, df: DataFrame, spec: CleanseSpec, lineage: Lineage, lead) -> DataFrame:
    """``rows`` under the bucket they came from, in its first spelling."""
    columns = user_columns(rows, lineage)
    named = attach_bucket_names(rows, source_buckets(df, spec, lineage))
    return named.select(F.col(BUCKET).alias(SOURCE), *lead, *[col_ref(c) for c in columns])


def duplicates(df: DataFrame, spec: CleanseSpec, lineage: Lineage, rules=()) -> DataFrame:
    """Rows removed as duplicates, preceded by ``_Source``."""
    rows = cleanse(df, spec, lineage, rules).filter(F.col(STATUS) == DUPLICATE)
    return audit(rows, df, spec, lineage, [])


def invalid(df: DataFrame, spec: CleanseSpec, lineage: Lineage, rules=()) -> DataFrame:
    """Rows that failed validation, preceded by ``_Source`` and ``_Reason``; nothing is deduplicated."""
    rows = prepare(df, spec, lineage, rules).filter(F.col(REASON).isNotNull())
    return audit(rows, df, spec, lineage, [F.col(REASON)])
