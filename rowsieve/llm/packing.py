"""Best-fit packing of token sequences in bulk-synchronous rounds."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.llm.arrow import map_rows
from rowsieve.llm.tables import shuffle_partitions, written
from rowsieve.llm.tokens import default_tokenizer, encoder

CAPACITY = 2048
END = bytes(4)  # id 0 after each document


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): pieces of every document, written once.

    A document's ids are followed by id 0. One of more than ``capacity`` ids is cut into
    pieces of that many; only its first may be shorter. ``row`` numbers the pieces, in no
    given order. Null texts count as empty: the end id alone.
    """
    path = tokenizer or default_tokenizer()

    def setup():
        encode = encoder(path).encode

        def work(rows):
            for (doc_id, _), ids in zip(rows, encode([t for _, t in rows]), strict=True):
                data = memoryview(ids + END)
                n = len(data) // 4
                start, end = 0, n % capacity or capacity
                piece = 0
                while start < n:
                    yield doc_id, piece, start, end - start, zlib.crc32(data[4 * start : 4 * end])
                    piece, start, end = piece + 1, end, end + capacity

        return work

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    made = map_rows(docs.select("doc_id", "text"), setup, schema)
    return written(made.withColumn("row", F.monotonically_increasing_id()), "pieces")


def best_fit_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go, as runs (length, first rank, pieces, first sequence, offset).

    ``counts`` holds the pieces of each length. Pieces of one length are alike, and so are
    sequences with the same gap, so both sorted lists are held as runs: at most as many as
    there are lengths, whatever the number of pieces.

    A round sweeps the lengths from the longest; each run of pieces takes the runs of gaps
    that succeed it, the tightest first, and where more pieces than gaps meet, those of the
    lowest rank win. A gap takes one piece per round; then gaps are updated and sorted in
    again. When no gap takes anything, as many sequences are opened as the rest of the
    tokens fill, and at most one per piece.
    """
    left = {n: c for n, c in counts.items() if c and n < capacity}
    placed = dict.fromkeys(left, 0)
    total = sum(n * c for n, c in left.items())
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, sequences)
    order: list[int] = []
    opened = 0
    while left:
        updated = defaultdict(list)
        for length in sorted(left, reverse=True):
            while length in left:
                k = bisect_left(order, length)
                if k == len(order):
                    break
                gap = order[k]
                first, n = gaps[gap].pop()
                take = min(n, left[length])
                runs.append((length, placed[length], take, first, capacity - gap))
                placed[length] += take
                left[length] -= take
                total -= take * length
                if not left[length]:
                    del left[length]
                if take < n:
                    gaps[gap].append((first + take, n - take))
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(k)
                if gap > length:
                    updated[gap - length].append((first, take))
        if updated:
            for gap, found in updated.items():
                if gap not in gaps:
                    insort(order, gap)
                    gaps[gap] = []
                gaps[gap] += _joined(found)
        elif left and (not order or order[-1] < min(left)):
            new = max(1, min(-(-total // capacity), sum(left.values())))
            if capacity not in gaps:
                insort(order, capacity)
                gaps[capacity] = []
            gaps[capacity].append((opened, new))
            opened += new
    if counts.get(capacity):
        runs.append((capacity, 0, counts[capacity], opened, 0))
    return runs


def _joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of sequences, neighbours as one."""
    made: list[tuple[int, int]] = []
    for first, n in sorted(found):
        if made and sum(made[-1]) == first:
            made[-1] = (made[-1][0], made[-1][1] + n)
        else:
            made.append((first, n))
    return made


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``: gapless from 0 among the pieces of one length.

    A length that many pieces share is dealt over slots; a slot's ranks begin after the
    pieces of the slots before it.
    """
    slots = shuffle_partitions(pieces.sparkSession)
    dealt = pieces.withColumn("slot", F.pmod(F.xxhash64("row"), F.lit(slots)))
    sizes = dealt.groupBy("length", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "slot").orderBy("row")
    return (
        dealt.withColumn("at", F.row_number().over(within) - 1)
        .join(sizes, ["length", "slot"])
        .withColumn("rank", F.col("before") + F.col("at"))
        .drop("slot", "at", "before")
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Repeated rows and null doc_ids are packed like any other row; an empty table gives none.
    The counts per length (at most ``capacity`` rows) and the runs made of them are the only
    things that pass through the driver; a piece finds its run by length and rank.
    """
    pieces = token_pieces(docs, capacity, tokenizer)
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    schema = "length long, first long, n long, sequence long, offset long"
    runs = docs.sparkSession.createDataFrame(best_fit_rounds(counts, capacity), schema)
    found = ranked(pieces).join(F.broadcast(runs.withColumnRenamed("length", "of")), F.expr("length = of and rank >= first and rank < first + n"))
    return found.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
        "offset",
    )
