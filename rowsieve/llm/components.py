"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.session import checkpointed


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the least of a and all b beside a.

    The grouped minimum is combined before the shuffle. It is written before the join, so
    that both sides are plain shuffles and a node with many edges can be split there.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    least = checkpointed(least.select("a", F.least("a", "m").alias("m")))
    return edges.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger to the smaller node."""
    starred = _with_least(edges)
    links = starred.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return links.union(starred.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst): root is the least node reachable.

    Alternating star rounds: each node is hung under the least node it knows, until the
    edges stay as they are, when every component is one star. The number of rounds grows
    with the logarithm of the longest path; rounds are cut by reliable checkpoints.
    """
    now = checkpointed(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .distinct()
    )
    state = _state(now)
    while state[0]:
        now = checkpointed(_small_star(_large_star(now)))
        state, last = _state(now), state
        if state == last:
            break
    hung = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return hung.union(now.select("b", "b").distinct())
