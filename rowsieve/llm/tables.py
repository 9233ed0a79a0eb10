"""Reading the tables, and tables written once to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowsieve.session import scratch_path, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    What follows reads the written rows, so costly columns are made once and a lost
    executor brings no other values.
    """
    return stage(df, scratch_path(df.sparkSession, label))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
