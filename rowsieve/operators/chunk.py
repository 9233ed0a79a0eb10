"""Global row numbers and chunks of N rows, without sending all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from rowsieve.functions.names import clean_file_name, two_digits
from rowsieve.operators.small import join_small
from rowsieve.session import checkpointed, scratch_path, stage
from rowsieve.spec import Chunking, CleanseSpec, OutputFormat

CHUNK_RUN = 4096
LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row in partition below


def sorted_stage(df: DataFrame, sort_cols, path: str | None = None, seen: Observation | None = None) -> DataFrame:
    """``df`` in order, written once, with ``_rid`` telling each row's place; ``seen`` counts rows.

    The written table fixes partition boundaries, so that counting and numbering
    agree even if executors are lost in between.
    """
    ranged = df.repartitionByRange(*sort_cols).sortWithinPartitions(*sort_cols)
    if seen is not None:
        ranged = ranged.observe(seen, F.count("*").alias("rows"))
    path = path or scratch_path(df.sparkSession, "sorted")
    return stage(ranged.withColumn("_rid", F.monotonically_increasing_id()), path)


def partition_no() -> Column:
    return F.shiftright("_rid", LOCAL_BITS)


def row_numbers(staged: DataFrame, group: str | None = None) -> DataFrame:
    """Add ``_rn``, each row's 1-based rank in the staged order, overall or within ``group``.

    The rows counted must be contiguous in that order: all of them, those of one
    status, or, with ``group``, a frame sorted by it. A partition then holds one
    piece per group, and only the pieces' sizes are put together.
    """
    by = [group] if group else []
    pieces = staged.groupBy(*by, partition_no().alias("_pid")).agg(
        F.count("*").alias("_n"), F.min("_rid").alias("_from")
    )
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        F.struct(*by, "_pid").alias("_piece"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from") + 1).alias("_shift"),
    )
    keyed = staged.withColumn("_piece", F.struct(*by, partition_no().alias("_pid")))
    return (
        join_small(keyed, starts, "_piece")
        .withColumn("_rn", F.col("_rid") + F.col("_shift"))
        .drop("_piece", "_shift")
    )


def numbered(df: DataFrame, sort_cols, group: str | None = None) -> DataFrame:
    """``df`` with ``_rn`` from 1 in order (within ``group``), for frames of a row per bucket or file."""
    ranged = df.repartitionByRange(*sort_cols).sortWithinPartitions(*sort_cols)
    placed = checkpointed(ranged.withColumn("_rid", F.monotonically_increasing_id()))
    return row_numbers(placed, group).drop("_rid")


def running_sums(df: DataFrame, sort_cols, group: str, sums: dict[str, Column]) -> DataFrame:
    """``df`` with each of ``sums`` added up in order within ``group``, the row itself included.

    ``sort_cols`` begin with ``group``. As in ``row_numbers`` a task adds up its piece of a
    group and only the pieces' totals are put together, so that a group can hold any share of rows.
    """
    ranged = df.withColumns(sums).repartitionByRange(*sort_cols).sortWithinPartitions(*sort_cols)
    placed = checkpointed(ranged.withColumn("_rid", F.monotonically_increasing_id()))
    placed = placed.withColumn("_piece", F.struct(group, partition_no().alias("_pid")))
    pieces = placed.groupBy("_piece").agg(*(F.sum(name).alias(name) for name in sums))
    before = Window.partitionBy(f"_piece.{group}").orderBy("_piece._pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        "_piece", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before{name}") for name in sums)
    )
    upto = Window.partitionBy("_piece").orderBy("_rid").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({name: F.sum(name).over(upto) for name in sums})
    return (
        join_small(summed, starts, "_piece")
        .withColumns({name: F.col(name) + F.col(f"_before{name}") for name in sums})
        .drop("_rid", "_piece", *(f"_before{name}" for name in sums))
    )


def chunk_of(rn: Column, size: int) -> Column:
    return (F.floor((rn - 1) / F.lit(max(1, size))) + 1).cast("bigint")


def with_chunk(df: DataFrame, sort_cols, size: int, per: str | None = None) -> DataFrame:
    """``df`` with ``_rn`` and ``_chunk``: consecutive groups of ``size`` rows, overall or per column."""
    lead = [per] if per else []
    numbered = row_numbers(sorted_stage(df, [*lead, *[c for c in sort_cols if c not in lead]]), per)
    return numbered.withColumn("_chunk", chunk_of(F.col("_rn"), size)).drop("_rid")


def chunk_sizes(totals: DataFrame, rows: str, size: int) -> DataFrame:
    """One row per chunk (``chunk``, ``chunks``, ``chunk_rows``) of frames of ``rows`` rows each.

    An empty frame has one empty chunk.
    """
    size = max(1, size)
    n = F.col(rows)
    chunks = F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("bigint")
    # One merged frame can have any number of chunks: runs of them are dealt to tasks first.
    first = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("chunks"), F.lit(CHUNK_RUN)))
    runs = totals.withColumn("chunks", chunks).withColumn("_run", first).repartition("_run")
    last = F.least(F.col("chunks"), F.col("_run") + (CHUNK_RUN - 1))
    out = runs.withColumn("chunk", F.explode(F.sequence(F.col("_run"), last))).drop("_run")
    return out.withColumn("chunk_rows", F.least(F.lit(size), n - (F.col("chunk") - 1) * size).cast("bigint"))


def sheet_title(base: Column) -> Column:
    """Name of a chunk's sheet: numbered only if there are several."""
    return F.when(F.col("chunks") == 1, base).otherwise(F.concat(base, F.lit("_"), F.col("chunk").cast("string")))


def manifest(counts: DataFrame, spec: CleanseSpec, run: str) -> DataFrame:
    """What a run writes as unique output, one row per sheet or file.

    ``counts`` comes from ``bucket_counts``. ``name`` is the sheet's name, ``file``
    the output it stands in.
    """
    csv, chunking = spec.format is OutputFormat.CSV, spec.effective_chunking
    merged = chunking in (Chunking.MERGED_SHEETS, Chunking.SEPARATE_FILES)
    one_name = merged or not spec.keep_sheets
    if one_name:
        totals = counts.agg(F.coalesce(F.sum("unique_rows"), F.lit(0)).alias("rows")).select(
            F.lit(1).cast("bigint").alias("bucket_ord"), F.lit(spec.unique_name).alias("bucket"), "rows"
        )
    else:
        totals = counts.select("bucket_ord", "bucket", F.col("unique_rows").alias("rows"))
    if chunking is Chunking.NONE:
        one = F.lit(1).cast("bigint")
        sized = totals.select("*", one.alias("chunks"), one.alias("chunk"), F.col("rows").alias("chunk_rows"))
    else:
        sized = chunk_sizes(totals, "rows", spec.chunk_rows)
    bucket = F.col("bucket")
    name, several = bucket, F.col("chunks") > 1
    if csv:
        label = F.concat(F.lit("_"), bucket if one_name else clean_file_name(bucket))
        if chunking is Chunking.NONE and totals.limit(2).count() == 1:
            # A single table without audit tables is the run's own file.
            audited = spec.emit_duplicates or spec.emit_invalid
            label = F.lit(f"_{spec.unique_name}" if audited else "")
        number = F.when(several, F.concat(F.lit("_"), two_digits(F.col("chunk")))).otherwise(F.lit(""))
        file = F.concat(F.lit(run), label, number, F.lit(".csv"))
    elif chunking is Chunking.SEPARATE_FILES:
        number = F.when(several, F.concat(F.lit("_part"), two_digits(F.col("chunk")))).otherwise(F.lit(""))
        file = F.concat(F.lit(run), number)
    else:
        name, file = sheet_title(bucket), F.lit(run)
    return sized.select(
        "bucket_ord", "bucket", "chunk", name.alias("name"), file.alias("file"), F.col("chunk_rows").alias("rows")
    )
