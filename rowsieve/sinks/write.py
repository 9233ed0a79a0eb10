"""Writing a cleansing run: buckets, chunks, manifest and counts."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, functions as F

from rowsieve.operators.buckets import attach_bucket_names, source_buckets
from rowsieve.operators.chunk import chunk_of, manifest, row_numbers, sorted_stage
from rowsieve.operators.columns import REASON, SOURCE, col_ref, find_column, with_types_as_text
from rowsieve.operators.hygiene import PART
from rowsieve.operators.names import sanitize_names
from rowsieve.operators.report import COUNTS, bucket_counts, numbered_counts
from rowsieve.operators.route import (
    BUCKET,
    DUPLICATE,
    INVALID,
    STATUS,
    UNIQUE,
    cleanse,
    prepare,
    row_order,
    unique_rows,
    user_columns,
)
from rowsieve.session import checkpointed, dropped, scratch_path
from rowsieve.spec import Chunking, CleanseSpec, KeyMode, Lineage, OutputFormat

# Cells are written as they are: without these options the writer trims them.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RunResult:
    """What a run did. It succeeded if no file failed; ``error`` is the first failure."""

    path: str
    rows_read: int
    unique_rows: int
    duplicate_rows: int
    invalid_rows: int
    success: bool = True
    error: str | None = None
    elapsed: float = 0.0  # seconds
    missing_columns: tuple[str, ...] = ()  # named in the options, found in no source


def write_rows(df: DataFrame, path: str, fmt: OutputFormat, partitions=(), mode="errorifexists") -> None:
    """``df`` sorted by its directory columns already, one directory level per column."""
    if fmt is OutputFormat.CSV:
        df = with_types_as_text(df, [c for c in df.columns if c not in partitions])
        df.write.mode(mode).options(**CSV_OPTIONS).partitionBy(*partitions).csv(path)
    else:
        df.write.mode(mode).partitionBy(*partitions).parquet(path)


def route_to_stage(
    df: DataFrame, spec: CleanseSpec, lineage: Lineage, buckets: DataFrame, path: str, rules=(), seen: Observation | None = None
) -> DataFrame:
    """Routed rows with first-spelling buckets, written once in output order.

    With duplicates all rows are kept, as they are counted from here. Else only
    what is to be written; duplicates are then dropped inside the map tasks. ``seen``
    counts the rows on their way.
    """
    if spec.emit_duplicates:
        rows = cleanse(df, spec, lineage, rules)
    else:
        wanted = [s for s, emit in ((UNIQUE, spec.emit_unique), (INVALID, spec.emit_invalid)) if emit]
        rows = unique_rows(df, spec, lineage, rules).filter(F.col(STATUS).isin(wanted))
    named = attach_bucket_names(rows, buckets, materialised=True)
    return sorted_stage(named, [STATUS, "_bucket_pos", *row_order(spec, lineage)], path, seen)


def staged_counts(staged: DataFrame, buckets: DataFrame) -> DataFrame:
    """``bucket_counts`` of a staged frame that holds all three statuses."""
    per_status = staged.groupBy(F.lower(BUCKET).alias("_bucket_key"), STATUS).agg(
        F.count("*").alias("_n"), F.count_if(F.col(PART) == 0).alias("_read")
    )

    def of(status):
        return F.coalesce(F.sum(F.when(F.col(STATUS) == status, F.col("_n"))), F.lit(0))

    counts = per_status.groupBy("_bucket_key").agg(
        F.sum("_read").alias("rows_read"),
        of(UNIQUE).alias("unique_rows"),
        of(DUPLICATE).alias("duplicate_rows"),
        of(INVALID).alias("invalid_rows"),
    )
    return numbered_counts(counts, buckets)


def cheap_counts(df, staged, spec: CleanseSpec, lineage: Lineage, buckets: DataFrame, rules=()) -> DataFrame:
    """``bucket_counts`` where the unique rows are staged: the rest needs no keys."""
    rows = prepare(df, spec, lineage, rules)
    invalid = F.count_if(F.col(REASON).isNotNull())
    totals = rows.groupBy(F.lower(BUCKET).alias("_bucket_key")).agg(
        F.count("*").alias("_n"), F.count_if(F.col(PART) == 0).alias("rows_read"), invalid.alias("invalid_rows")
    )
    unique = staged.filter(F.col(STATUS) == UNIQUE).groupBy(F.lower(BUCKET).alias("_bucket_key")).agg(
        F.count("*").alias("unique_rows")
    )
    counts = totals.join(unique, "_bucket_key", "left").withColumn("unique_rows", F.coalesce("unique_rows", F.lit(0)))
    duplicates = F.col("_n") - F.col("invalid_rows") - F.col("unique_rows")
    return numbered_counts(counts.withColumn("duplicate_rows", duplicates), buckets)


def audit_entries(totals, spec: CleanseSpec, listed: DataFrame, run: str) -> DataFrame:
    """Manifest rows of the audit tables: in CSV files of their own, else in the first file."""
    first = listed.orderBy("bucket_ord", "chunk").limit(1).collect() if spec.emit_unique else []
    rows = []
    for wanted, name, n in (
        (spec.emit_duplicates, spec.duplicates_name, totals["duplicate_rows"]),
        (spec.emit_invalid, spec.invalid_name, totals["invalid_rows"]),
    ):
        if wanted:
            csv = f"{run}_{name}.csv"
            file = csv if spec.format is OutputFormat.CSV else first[0]["file"] if first else run
            rows.append((2**62 + len(rows), None, 1, name, file, n))
    entries = listed.sparkSession.createDataFrame(
        rows, "bucket_ord bigint, bucket string, chunk bigint, name string, file string, rows bigint"
    )
    return listed.unionByName(entries) if spec.emit_unique else entries


def missing_columns(df: DataFrame, spec: CleanseSpec) -> tuple[str, ...]:
    """Columns that the options name and ``df`` lacks; their values count as empty."""
    keys = spec.key_columns if spec.key_mode in (KeyMode.SINGLE, KeyMode.MULTIPLE) else ()
    named = [*keys, spec.effective_validation_column] if spec.validation else keys
    return tuple(dict.fromkeys(n for n in named if n and find_column(df, n) is None))


def unique_output(staged: DataFrame, spec: CleanseSpec) -> tuple[DataFrame, list[str]]:
    """(unique rows with their directory columns, names of those columns)."""
    rows = staged.filter(F.col(STATUS) == UNIQUE)
    merged = spec.effective_chunking in (Chunking.MERGED_SHEETS, Chunking.SEPARATE_FILES)
    partitions = [] if merged or not spec.keep_sheets else [BUCKET]
    if spec.effective_chunking is not Chunking.NONE:
        numbered = row_numbers(rows, None if merged else BUCKET)
        rows = numbered.withColumn("_chunk", chunk_of(F.col("_rn"), spec.rows_per_chunk))
        partitions = [*partitions, "_chunk"]
    return rows.sortWithinPartitions(*partitions, "_rid"), partitions


def write_run(
    df: DataFrame,
    spec: CleanseSpec,
    lineage: Lineage,
    path: str,
    rules=(),
    mode="errorifexists",
    buckets: DataFrame | None = None,
    progress: Callable[[str, int], None] | None = None,
) -> RunResult:
    """Cleanse ``df`` and write the chosen buckets below ``path``.

    ``unique`` has one directory per bucket and chunk, ``duplicates`` and
    ``invalid`` carry ``_Source`` (and ``_Reason``), ``manifest`` and ``counts``
    say what was written. Buckets never share a directory, so no source sheet
    can collide with an audit table. ``buckets`` is a ``bucket_table`` of all
    sheets, if there are some without rows. ``progress`` is told each step that is
    done with its number of rows.
    """
    spec.check()
    began = time.monotonic()
    spark = df.sparkSession
    buckets = checkpointed(source_buckets(df, spec, lineage) if buckets is None else buckets)
    scratch = scratch_path(spark, "routed")
    with dropped(spark, scratch):
        seen = Observation()
        staged = route_to_stage(df, spec, lineage, buckets, scratch, rules, seen)
        tell = progress or (lambda step, rows: log.info("%s: %s rows", step, rows))
        tell("routed", seen.get["rows"])
        if spec.emit_duplicates:
            counted = staged_counts(staged, buckets)
        elif spec.emit_unique and spec.keep_sheets:
            counted = cheap_counts(df, staged, spec, lineage, buckets, rules)
        else:
            counted = bucket_counts(df, spec, lineage, rules, buckets)
        counted.write.mode(mode).parquet(f"{path}/counts")
        counts = spark.read.parquet(f"{path}/counts")
        totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]).first()
        columns = [col_ref(c) for c in user_columns(staged, lineage) if c not in ("_rid", "_bucket_pos")]
        run = path.rstrip("/").rsplit("/", 1)[-1]
        listed = manifest(counts, spec, run)
        if spec.emit_unique:
            rows, partitions = unique_output(staged, spec)
            if totals["unique_rows"]:
                write_rows(rows.select(*columns, *partitions), f"{path}/unique", spec.format, partitions, mode)
            else:
                # No row makes a directory by itself: the empty table lies in the first bucket's.
                values = {BUCKET: first_bucket(counts, spec), "_chunk": "1"}
                below = "".join(f"/{p}={quote(values[p], safe=' ')}" for p in partitions)
                write_rows(rows.select(*columns), f"{path}/unique{below}", spec.format, (), mode)
            tell("unique", totals["unique_rows"])
        if spec.emit_unique or spec.emit_duplicates or spec.emit_invalid:
            listed = audit_entries(totals, spec, listed, run)
            if spec.format is not OutputFormat.CSV:
                listed = sanitize_names(listed, "name", ["bucket_ord", "chunk"], within=["file"])
            listed.write.mode(mode).parquet(f"{path}/manifest")
        for wanted, status, folder, lead in (
            (spec.emit_duplicates, DUPLICATE, "duplicates", [F.col(BUCKET).alias(SOURCE)]),
            (spec.emit_invalid, INVALID, "invalid", [F.col(BUCKET).alias(SOURCE), F.col(REASON)]),
        ):
            if wanted:
                rows = staged.filter(F.col(STATUS) == status).sortWithinPartitions("_rid")
                write_rows(rows.select(*lead, *columns), f"{path}/{folder}", spec.format, (), mode)
                tell(folder, totals[f"{status}_rows"])
    log.info("%s: %s", path, totals.asDict())
    return RunResult(
        path,
        *[int(totals[c]) for c in COUNTS],
        elapsed=time.monotonic() - began,
        missing_columns=missing_columns(df, spec),
    )


def first_bucket(counts: DataFrame, spec: CleanseSpec) -> str:
    found = counts.orderBy("bucket_ord").limit(1).collect()
    return found[0]["bucket"] or spec.unique_name if found else spec.unique_name
