"""Contiguous shards of nearly equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.llm.tables import shuffle_partitions, written

SHARDS = 8


def shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    Rows are taken in order of doc_id and cut where the bytes before the middle of a row
    pass the next of ``n`` equal targets, so shards are contiguous and differ by about the
    largest row. ``slot`` counts a shard's rows from 0. ``size`` is the UTF-8 bytes of the
    text plus one; a null text has none and the checksum of no bytes. Null doc_ids come
    first. Rows of one doc_id go by size, checksum and place in the table, so ties and
    repeated rows have a fixed order and may be cut apart. ``grown_shard`` is null: cuts by
    bytes move when a shard is added. Fewer rows than shards leave some shards empty.

    Rows are range-partitioned and written once with the number of their partition. Totals
    of partitions give where each one begins; within it, rows add up by a window.
    """
    spark = docs.sparkSession
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["doc_id", "size", "text_crc32", "place"]
    ranged = sized.repartitionByRange(shuffle_partitions(spark), *order)
    rows = written(ranged.withColumn("part", F.spark_partition_id()), "shards")

    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumns({"bytes_to": F.sum("size").over(within), "rows_to": F.count("*").over(within)})
        .join(totals, "part")
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("bytes_to")) - F.col("size"))
        .withColumn("shard", F.least(F.expr(f"middle * {n} div (2 * all_bytes)"), F.lit(n - 1)).cast("int"))
        .withColumn("at", F.col("rows_before") + F.col("rows_to") - 1)
        .select("doc_id", "size", "text_crc32", "shard", "at")
    )
    # At most n rows, whatever the input.
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
