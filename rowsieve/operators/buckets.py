"""Buckets: labels, order of first encounter, and joining them back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowsieve.functions.names import base_name, extension
from rowsieve.operators.chunk import numbered
from rowsieve.operators.dedup import order_key
from rowsieve.operators.small import join_small
from rowsieve.spec import CleanseSpec, Lineage


def with_bucket(df: DataFrame, spec: CleanseSpec, lineage: Lineage) -> DataFrame:
    """``_bucket``: the sheet, for a CSV the file's base name, or one name for all."""
    if not spec.keep_sheets or not (lineage.sheet or lineage.file):
        return df.withColumn("_bucket", F.lit(spec.unique_name))
    if lineage.sheet and lineage.file:
        csv = extension(F.col(lineage.file)) == ".csv"
        label = F.when(csv, base_name(F.col(lineage.file))).otherwise(F.col(lineage.sheet))
    elif lineage.sheet:
        label = F.col(lineage.sheet)
    else:
        label = base_name(F.col(lineage.file))
    return df.withColumn("_bucket", F.coalesce(label.cast("string"), F.lit("")))


def bucket_table(df: DataFrame, order) -> DataFrame:
    """One row per bucket: ``_bucket_key``, first spelling ``_bucket_name`` and first
    row position ``_bucket_pos``.

    The first step keeps only a position per spelling, combined before the shuffle.
    """
    spellings = (
        df.select("_bucket", order_key(df, order).alias("_p"))
        .groupBy("_bucket")
        .agg(F.min("_p").alias("_p"))
    )
    return spellings.groupBy(F.lower("_bucket").alias("_bucket_key")).agg(
        F.min_by("_bucket", "_p").alias("_bucket_name"), F.min("_p").alias("_bucket_pos")
    )


def source_buckets(df: DataFrame, spec: CleanseSpec, lineage: Lineage) -> DataFrame:
    """``bucket_table`` of unprocessed rows: only labels and positions are read."""
    return bucket_table(with_bucket(df, spec, lineage), lineage.order)


def bucket_order(df: DataFrame, order) -> DataFrame:
    """Buckets numbered from 1 in order of first encounter (one row per bucket)."""
    return numbered(bucket_table(df, order), ["_bucket_pos"]).select(
        F.col("_rn").alias("bucket_ord"),
        F.col("_bucket_name").alias("bucket"),
    )


def attach_bucket_names(df: DataFrame, buckets: DataFrame, materialised: bool = False) -> DataFrame:
    """Replace ``_bucket`` by its first spelling and add ``_bucket_pos`` to sort by."""
    keyed = df.withColumn("_bucket_key", F.lower("_bucket"))
    joined = join_small(keyed, buckets, "_bucket_key", materialised)
    return joined.withColumn("_bucket", F.col("_bucket_name")).drop("_bucket_key", "_bucket_name")
