"""Run reports: counts per run, bucket, file and reason.

Counts need keys only, never whole rows: distinct keys are the unique rows and
the rest are duplicates, so nothing wide is shuffled and no row order is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowsieve.operators.buckets import source_buckets
from rowsieve.operators.chunk import numbered
from rowsieve.operators.columns import REASON, data_columns
from rowsieve.operators.dedup import with_keys
from rowsieve.operators.hygiene import PART, drop_blank_rows
from rowsieve.operators.route import BUCKET, prepare, scope_columns
from rowsieve.spec import CleanseSpec, Lineage

COUNTS = ("rows_read", "unique_rows", "duplicate_rows", "invalid_rows")


def status_counts(df: DataFrame, spec: CleanseSpec, lineage: Lineage, by, rules=()) -> DataFrame:
    """``COUNTS`` per ``by`` (names of columns that are constant within a dedup scope)."""
    rows = prepare(df, spec, lineage, rules)
    columns = [c for c in data_columns(df, lineage) if c in rows.columns]
    keyed, keys, empty = with_keys(rows, spec, columns)
    # The sheet scope is a grouping even where nothing is deduplicated.
    scope = scope_columns(spec, lineage)
    keyed = keyed.withColumns(scope) if scope else keyed
    kind = F.when(F.col(REASON).isNotNull(), F.lit("invalid")).when(empty, F.lit("kept")).otherwise(F.lit("keyed"))
    # Rows without a key share one group here; each map task sends one row for it.
    slim = keyed.withColumn("_kind", kind).select(
        *dict.fromkeys([*by, *scope]),
        "_kind",
        *[F.when(F.col("_kind") == "keyed", F.col(k)).alias(k) for k in keys],
        (F.col(PART) == 0).cast("bigint").alias("_read"),
    )
    per_key = slim.groupBy(*[c for c in slim.columns if c != "_read"]).agg(
        F.count("*").alias("_n"), F.sum("_read").alias("_read")
    )
    n, kind = F.col("_n"), F.col("_kind")
    return per_key.groupBy(*by).agg(
        F.sum("_read").alias("rows_read"),
        F.coalesce(F.sum(F.when(kind == "kept", n).when(kind == "keyed", F.lit(1))), F.lit(0)).alias("unique_rows"),
        F.coalesce(F.sum(F.when(kind == "keyed", n - 1)), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(kind == "invalid", n)), F.lit(0)).alias("invalid_rows"),
    )


def numbered_counts(counts: DataFrame, buckets: DataFrame) -> DataFrame:
    """``counts`` (by ``_bucket_key``) for all ``buckets``, numbered in order of encounter."""
    return numbered(buckets.join(counts, "_bucket_key", "left"), ["_bucket_pos"]).select(
        F.col("_rn").alias("bucket_ord"),
        F.col("_bucket_name").alias("bucket"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in COUNTS],
    )


def bucket_counts(df: DataFrame, spec: CleanseSpec, lineage: Lineage, rules=(), buckets: DataFrame | None = None) -> DataFrame:
    """``bucket_ord``, ``bucket`` (first spelling) and ``COUNTS``, one row per bucket.

    ``buckets`` is a ``bucket_table``; by default it comes from the rows.
    """
    if buckets is None:
        buckets = source_buckets(df, spec, lineage)
    if spec.keep_sheets:
        counts = status_counts(df, spec, lineage, ["_scope"], rules).withColumnRenamed("_scope", "_bucket_key")
    else:
        key = F.lower(F.lit(spec.unique_name)).alias("_bucket_key")
        counts = status_counts(df, spec, lineage, [], rules).select(key, *COUNTS)
    return numbered_counts(counts, buckets)


def run_totals(df: DataFrame, spec: CleanseSpec, lineage: Lineage, rules=()) -> DataFrame:
    counts = status_counts(df, spec, lineage, [], rules)
    return counts.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in COUNTS])


def reason_counts(df: DataFrame, spec: CleanseSpec, lineage: Lineage, rules=()) -> DataFrame:
    """Invalid rows per bucket (first spelling) and reason."""
    rows = prepare(df, spec, lineage, rules).filter(F.col(REASON).isNotNull())
    counts = rows.groupBy(F.lower(BUCKET).alias("_bucket_key"), F.col(REASON).alias("reason")).agg(
        F.count("*").alias("n")
    )
    return counts.join(source_buckets(df, spec, lineage), "_bucket_key").select(
        F.col("_bucket_name").alias("bucket"), "reason", "n"
    )


def file_counts(df: DataFrame, lineage: Lineage, columns) -> DataFrame:
    """Rows and sheets read per file; the first grouping takes the load off a large file."""
    sheet = F.col(lineage.sheet) if lineage.sheet else F.lit("")
    per_sheet = (
        drop_blank_rows(df, columns)
        .groupBy(F.col(lineage.file).alias("file"), F.lower(sheet).alias("_sheet_key"))
        .agg(F.count("*").alias("_n"))
    )
    return per_sheet.groupBy("file").agg(
        F.sum("_n").alias("rows_read"), F.count("*").alias("sheets_read")
    )


def totals_by_file(df: DataFrame, spec: CleanseSpec, lineage: Lineage, rules=()) -> DataFrame:
    """``COUNTS`` of per-file runs and their sum (``file`` null)."""
    per_file = status_counts(df, spec, lineage, [lineage.file], rules)
    return per_file.rollup(F.col(lineage.file).alias("file")).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    )


def file_outcomes(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Status per admitted file.

    ``files`` has ``file``, ``error`` (null if readable), ``sheets_selected`` and, where
    there is something to say, ``note``;
    ``counts`` comes from ``file_counts``. Both hold one row per file.
    """
    status = (
        F.when(F.col("error").isNotNull(), F.lit("Failed"))
        .when(F.col("sheets_selected") == 0, F.lit("Skipped"))
        .otherwise(F.lit("Processed"))
    )
    note = F.col("note") if "note" in files.columns else F.lit(None).cast("string")
    message = F.coalesce(
        F.col("error"), note, F.when(F.col("sheets_selected") == 0, F.lit("No matching sheets")), F.lit("")
    )
    return files.join(counts.select("file", "rows_read"), "file", "left").select(
        "file",
        status.alias("status"),
        message.alias("message"),
        F.coalesce("rows_read", F.lit(0)).alias("rows_read"),
        F.col("sheets_selected").cast("bigint").alias("sheets_read"),
    )
