"""A whole run: files in, buckets and reports out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import SparkSession, functions as F

from rowsieve.operators.buckets import source_buckets
from rowsieve.operators.hygiene import drop_blank_rows
from rowsieve.operators.report import file_counts, file_outcomes
from rowsieve.operators.route import DUPLICATE, INVALID, UNIQUE
from rowsieve.session import dropped, scratch_path, sized_shuffles, stage
from rowsieve.sinks.inplace import replace_in_place
from rowsieve.sinks.write import RunResult, write_run
from rowsieve.sources.read import Sources, read_sources
from rowsieve.spec import FILE_LINEAGE, CleanseSpec, Destination, SpecError


def run_name(at: datetime | None = None) -> str:
    return f"Processed_{(at or datetime.now()):%Y%m%d_%H%M%S}"


def output_folder(paths: list[str], spec: CleanseSpec, run: str) -> str:
    """Below the output folder, or else beside the first file."""
    return f"{(spec.output_dir or paths[0].rsplit('/', 1)[0]).rstrip('/')}/{run}"


def outcomes(sources: Sources):
    """Status per file given, with the rows read from it."""
    if sources.rows is None:
        nothing = sources.outcomes.sparkSession.createDataFrame([], "file string, rows_read bigint")
        return file_outcomes(sources.outcomes, nothing)
    return file_outcomes(sources.outcomes, file_counts(sources.rows, FILE_LINEAGE, sources.columns))


def run(
    spark: SparkSession,
    paths: list[str],
    spec: CleanseSpec,
    name: str | None = None,
    mode="errorifexists",
    progress: Callable[[str, int], None] | None = None,
) -> RunResult:
    """Read ``paths``, cleanse them together and write the result.

    Without any readable sheet only the outcome of the files is written. ``progress``
    is told each step of writing that is done with its number of rows.
    """
    spec.check()
    if not paths:
        raise SpecError("no files to process")
    began = time.monotonic()
    sources = read_sources(spark, paths, spec)
    path = output_folder(paths, spec, name or run_name())
    if sources.rows is None:
        outcomes(sources).write.mode(mode).parquet(f"{path}/files")
        return concluded(RunResult(path, 0, 0, 0, 0), sources, began)
    scratch = scratch_path(spark, "ingest")
    with dropped(spark, scratch, *sources.scratch), sized_shuffles(spark, sources.nbytes):
        # Files are decoded once; every later pass reads the columns it needs from the copy.
        rows = stage(drop_blank_rows(sources.rows, sources.columns), scratch)
        lineage = replace(FILE_LINEAGE, blank_rows=False)
        if spec.destination is Destination.IN_PLACE:
            done = replace_in_place(spark, rows, spec, lineage=lineage).collect()
            n = {s: sum(r["rows"] for r in done if r["status"] == s) for s in (UNIQUE, DUPLICATE, INVALID)}
            result = RunResult(paths[0], sum(r["rows_read"] for r in done), n[UNIQUE], n[DUPLICATE], n[INVALID])
        else:
            buckets = source_buckets(sources.sheets, spec, lineage)
            result = write_run(rows, spec, lineage, path, mode=mode, buckets=buckets, progress=progress)
            missing = ", ".join(map(repr, result.missing_columns))
            said = f"Column not found: {missing}" if missing else None
            noted = sources.outcomes.withColumn("note", F.coalesce("note", F.lit(said)))
            files = file_outcomes(noted, file_counts(rows, lineage, []))
            files.write.mode(mode).parquet(f"{path}/files")
    return concluded(result, sources, began)


def concluded(result: RunResult, sources: Sources, began: float) -> RunResult:
    """``result`` with what became of the files, and the time taken."""
    failed = sources.outcomes.filter(F.col("error").isNotNull()).orderBy("file").limit(1).collect()
    error = f"{failed[0]['file']}: {failed[0]['error']}" if failed else None
    return replace(result, success=not failed, error=error, elapsed=time.monotonic() - began)
