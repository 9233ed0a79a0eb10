"""Existing tables as input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowsieve.operators.buckets import join_small
from rowsieve.spec import Lineage


def read_parquet(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[DataFrame, Lineage]:
    """A parquet dataset and its lineage: file by name, then row in file. Types stay as they are."""
    df = spark.read.parquet(path)
    files = [(f, i) for i, f in enumerate(sorted(df.inputFiles()))]
    placed = df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    ords = spark.createDataFrame(files, "_file string, _file_ord int")
    columns = [*df.columns, "_file", "_file_ord", "_row"]
    lineage = Lineage(order=("_file_ord", "_row"), sheet=sheet, extra=("_file",))
    return join_small(placed, ords, "_file").select(*columns), lineage
