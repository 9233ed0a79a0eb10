"""Joins with frames that are expected to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowsieve.session import checkpointed


def join_small(df: DataFrame, small: DataFrame, on: str, materialised: bool = False) -> DataFrame:
    """Left join of a frame expected to be small, whatever its size turns out to be.

    Its measured size decides: below the session's broadcast threshold it is
    broadcast; above, both sides are shuffled by the key, and adaptive execution
    splits a key that holds most rows of ``df``.
    """
    small = small if materialised else checkpointed(small)
    threshold = conf_bytes(df.sparkSession, "spark.sql.autoBroadcastJoinThreshold")
    if measured_bytes(small) <= threshold:
        return df.join(F.broadcast(small), on, "left")
    return df.join(small.hint("merge"), on, "left")


def measured_bytes(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]


def row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: its text form, at any depth, and 16 bytes per column."""
    text = F.octet_length(F.to_json(F.struct(*df.columns)))
    return F.coalesce(text, F.lit(0)).cast("bigint") + F.lit(16 * len(df.columns))


def conf_bytes(spark, name: str) -> int:
    """A size setting of the session; it may be given as 10485760, 10485760b or 10MB."""
    value = spark.conf.get(name).strip().lower()
    digits = value.rstrip("bkmgt")
    return int(digits) * {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}[value[len(digits):][:1]]
