"""SimHash fingerprints and the self-join of binary tries that links them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.tables import shuffle_partitions, written
from rowsieve.llm.words import shingle_hashes
from rowsieve.session import checkpointed

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
PAIRS = 1 << 18


@dataclass(frozen=True)
class Linking:
    """When two fingerprints are linked.

    ``width`` words make a shingle and ``lanes`` 64-bit hashes of it a fingerprint. Tries
    are built over stretches of ``stretch`` bits: two fingerprints are linked if some
    stretch of both differs in at most ``budget`` bits, and all bits differ in at most
    ``most``. With one lane and one stretch of 64 bits this is the plain Hamming join.
    """

    width: int = 3
    lanes: int = 1
    stretch: int = 64
    budget: int = 3
    most: int = 3
    #: Count each shingle of a text once, as a similarity of sets does.
    once: bool = False
    #: Rows of a task: more go down the trie in Spark first.
    task_rows: int = 4096


#: Links at three or fewer of 64 bits over 3-word shingles.
CLOSE = Linking()


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; others are mixed from it by multiply and shift."""
    if not lane:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(lane) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, width: int = 3, lanes: int = 1, once: bool = False) -> str:
    """Lower-case hex; a bit is 1 if over half of the shingle hashes have it. No words: zero.

    With ``once`` repeated shingles count once.
    """
    found = shingle_hashes(text, width)
    if once:
        found = [np.unique(np.concatenate([*found, np.empty(0, np.uint64)]))]
    return majority(found, lanes)


def majority(found: Iterable[np.ndarray], lanes: int) -> str:
    """The fingerprint of shingle hashes that come in parts."""
    ones, n = np.zeros((lanes, 8, 8), np.int64), 0
    for hashes in found:
        n += len(hashes)
        for lane in range(lanes):
            by = _lane(hashes, lane).astype(">u8").view(np.uint8).reshape(-1, 8)
            for k in range(8):
                ones[lane, k] += np.bincount(by[:, k], minlength=256) @ _BITS
    return np.packbits(2 * ones.reshape(-1) > n).tobytes().hex()


def _keys(prints: np.ndarray, linking: Linking, band: np.ndarray) -> np.ndarray:
    """The stretch of each row's band, turned so that the band's leading bits come first.

    ``prints``: (rows, lanes) of 64-bit numbers. Keys are left-aligned in 64 bits.
    """
    lead = linking.stretch // (linking.budget + 1)
    at = band.astype(np.int64) * lead
    lane, inside = at // 64, at % 64
    word = prints[np.arange(len(prints)), lane]
    start = inside // linking.stretch * linking.stretch
    size, turn = np.uint64(linking.stretch), (inside - start).astype(np.uint64)
    word = word << start.astype(np.uint64)
    if linking.stretch == 64:
        return np.where(turn == 0, word, (word << turn) | (word >> ((np.uint64(64) - turn) & np.uint64(63))))
    word >>= np.uint64(64) - size
    word = ((word << turn) | (word >> (size - turn))) & ((np.uint64(1) << size) - np.uint64(1))
    return word << (np.uint64(64) - size)


def trie_pairs(
    keys: np.ndarray, starts: list[tuple[int, int, int, int]], bits: int, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``keys`` that differ in at most about ``budget`` bits, in chunks.

    A trie node is a range of sorted keys. ``starts`` gives node pairs (low, high, low,
    high) at the root; the same range twice is a self-join. Pairs of nodes go down bit by
    bit, all of a level together. A step to unlike children costs one bit, and a pair over
    budget is dropped with all below it. Small nodes are given out as they are, so a few
    pairs are over budget: the caller compares whole fingerprints anyway.
    """
    front = [np.array(x, np.int64) for x in zip(*starts, strict=True)]
    held = [(0, [*front, np.zeros(len(starts), np.int64)])]
    while held:
        bit, front = held.pop()
        if bit == bits:
            yield from _expand(front)
            continue
        if len(front[0]) > PAIRS:  # half at a time: memory stays bounded
            held += [(bit, [x[part] for x in front]) for part in (slice(PAIRS // 2), slice(PAIRS // 2, None))]
            continue
        ones = (keys >> np.uint64(63 - bit)) & np.uint64(1)
        seen = np.concatenate(([0], np.cumsum(ones.astype(np.int64))))
        low1, high1, low2, high2, spent = front
        mid1 = high1 - (seen[high1] - seen[low1])
        mid2 = high2 - (seen[high2] - seen[low2])
        cross = low1 != low2
        steps = [
            (low1, mid1, low2, mid2, spent),
            (mid1, high1, mid2, high2, spent),
            (low1, mid1, mid2, high2, spent + 1),
            tuple(x[cross] for x in (mid1, high1, low2, mid2, spent + 1)),
        ]
        front = [np.concatenate(x) for x in zip(*steps, strict=True)]
        low1, high1, low2, high2, spent = front
        size1, size2 = high1 - low1, high2 - low2
        alive = (size1 > 0) & (size2 > 0) & (spent <= budget) & ((low1 != low2) | (size1 > 1))
        small = alive & (size1 * size2 <= 8)
        if small.any():
            yield from _expand([x[small] for x in front])
        alive &= ~small
        if alive.any():
            held.append((bit + 1, [x[alive] for x in front]))


def _expand(front: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of the ranges, at most about PAIRS at a time."""
    low1, high1, low2, high2 = front[:4]
    at = 0
    rows = np.cumsum((high1 - low1) * (high2 - low2))
    while at < len(low1):
        done = rows[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(rows, done + PAIRS, side="right")))
        if end == at + 1 and rows[at] - done > PAIRS:
            # One large pair of nodes: row by row of its first side.
            for i in range(low1[at], high1[at]):
                j = np.arange(i + 1 if low1[at] == low2[at] else low2[at], high2[at])
                yield np.full(len(j), i), j
        else:
            part = slice(at, end)
            size2 = (high2 - low2)[part]
            n = (high1 - low1)[part] * size2
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(low1[part], n) + k // np.repeat(size2, n)
            j = np.repeat(low2[part], n) + k % np.repeat(size2, n)
            own = np.repeat(low1[part] == low2[part], n)
            keep = ~own | (i < j)
            yield i[keep], j[keep]
        at = end


def _union(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (index of the least row known to be linked) with the links i-j added."""
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        keep = low != high
        i, j, low, high = i[keep], j[keep], low[keep], high[keep]
        if len(i):
            np.minimum.at(root, high, low)
            while not np.array_equal(further := root[root], root):
                root = further
    return root


def _link_batch(task: np.ndarray, side: np.ndarray, band: np.ndarray, raw: list[bytes], linking: Linking):
    """Links (print, print of the least row) found inside whole tasks."""
    prints = np.frombuffer(b"".join(raw), ">u8").reshape(len(raw), -1)[:, : linking.lanes].astype(np.uint64)
    keys = _keys(prints, linking, band)
    order = np.lexsort((keys, side, task))
    keys, prints = keys[order], prints[order]
    task, side = task[order], side[order]
    edge = np.flatnonzero(np.diff(task)) + 1
    starts = []
    for low, high in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(task)])), strict=True):
        if side[low] == 0 and side[high - 1] == 0:
            starts.append((low, high, low, high))
        elif side[low] == 1 and side[high - 1] == 2:
            middle = low + int(np.searchsorted(side[low:high], 2))
            starts.append((low, middle, middle, high))
    root = np.arange(len(keys))
    if starts:
        for i, j in trie_pairs(keys, starts, linking.stretch, linking.budget):
            apart = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1)
            close = apart <= linking.most
            root = _union(root, i[close], j[close])
    for k in np.flatnonzero(root != np.arange(len(root))):
        yield raw[order[k]].hex(), raw[order[root[k]]].hex()


BATCH_ROWS = 16_384


def _link_tasks(linking: Linking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task; whole tasks are joined together."""
        held: list[tuple] = []

        def links(rows):
            names = {}
            task = np.array([names.setdefault(r[0], len(names)) for r in rows])
            side, band = (np.array([r[k] for r in rows]) for k in (1, 2))
            found = list(_link_batch(task, side, band, [r[3] for r in rows], linking))
            if found:
                src, dst = zip(*found, strict=True)
                yield pa.RecordBatch.from_pydict({"src": pa.array(src), "dst": pa.array(dst)})

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) >= BATCH_ROWS:
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield from links(held[:cut])
                    held = held[cut:]
        if held:
            yield from links(held)

    return run


def _sizes(tasks: DataFrame, task_rows: int) -> DataFrame:
    return checkpointed(tasks.groupBy("task").count().where(F.col("count") > task_rows).select("task"))


def _tasks(prints: DataFrame, linking: Linking, put) -> DataFrame:
    """Rows (task, side, band, print) of (stretch, fingerprint): pairs of trie nodes of bounded size.

    With ``budget`` + 1 leading parts in a stretch, one part of two near keys is equal, so
    each part leads one trie and its value is a node that is joined with itself (side 0).
    Nodes of more than ``task_rows`` rows go down four bits, as pairs of child nodes
    (sides 0, or 1 and 2) within the budget, until all are small or the key ends.
    """
    lead = linking.stretch // (linking.budget + 1) // 4
    digits = linking.stretch // 4
    bands = digits // lead
    columns = ["task", "side", "band", "print", "spent"]
    tasks = prints.select("fingerprint", F.explode(F.expr(f"sequence(stretch * {bands}, (stretch + 1) * {bands} - 1)")).alias("band")).select(
        F.concat_ws(":", "band", F.expr(f"substring(fingerprint, band * {lead} + 1, {lead})")).alias("task"),
        F.lit(0).alias("side"),
        "band",
        F.unhex("fingerprint").alias("print"),
        F.lit(0).alias("spent"),
    )
    done = None
    for depth in range(lead, digits):
        large = _sizes(tasks, linking.task_rows)
        if large.isEmpty():
            break
        place = f"(band * {lead}) div {digits} * {digits} + (band * {lead} + {depth}) % {digits} + 1"
        small = tasks.join(large, "task", "left_anti").select(columns)
        done = done.unionByName(small) if done else small
        split = (
            tasks.join(large, "task")
            .withColumn("digit", F.expr(f"cast(conv(substring(hex(print), {place}, 1), 16, 10) as int)"))
            .withColumn("other", F.explode(F.expr("sequence(0, 15)")))
            .withColumn("spent", F.col("spent") + F.bit_count(F.col("digit").bitwiseXOR(F.col("other"))))
            .where(F.col("spent") <= linking.budget)
            .withColumn(
                "child",
                F.expr("if(side = 1 or side = 0 and digit <= other, digit * 16 + other, other * 16 + digit)"),
            )
            .withColumn(
                "side",
                F.expr("case when side > 0 then side when digit = other then 0 when digit < other then 1 else 2 end"),
            )
            .withColumn("task", F.concat_ws("/", "task", "child"))
        )
        tasks = put(split.select(columns), "trie")
    return (done.unionByName(tasks) if done else tasks).drop("spent")


def _joined(prints: DataFrame, linking: Linking, put=written) -> DataFrame:
    """Links (src, dst) between the ``prints`` (stretch, fingerprint) of each stretch."""
    tasks = _tasks(prints, linking, put)
    n = shuffle_partitions(prints.sparkSession)
    return (
        tasks.repartition(n, "task")
        .sortWithinPartitions("task")
        .mapInArrow(_link_tasks(linking), "src string, dst string")
    )


def links(prints: DataFrame, linking: Linking = CLOSE) -> DataFrame:
    """Links (src, dst) between distinct ``prints`` (fingerprint) of one stretch that join all that are near.

    A task gives one link for each of its rows at most, to the least row it reaches there:
    a large group of near copies gives as many links as it has rows, not all its pairs.
    """
    return _joined(prints.withColumn("stretch", F.lit(0)), linking)


def node_links(nodes: DataFrame, linking: Linking, put=written) -> DataFrame:
    """Links (src, dst) between ``nodes`` (node, print), whose prints have several stretches and may repeat.

    Of the nodes with an equal stretch the least goes down its tries, the others are linked
    to it. So a node there has as many near ones as a key has bits to change, however large
    a group of near copies is.
    """
    digits = linking.stretch // 4
    at = F.explode(F.expr(f"sequence(0, {linking.lanes * 16 // digits - 1})")).alias("stretch")
    value = F.unhex(F.expr(f"substring(print, stretch * {digits} + 1, {digits})")).alias("value")
    # The node follows its print, and links give both back.
    name = F.concat("print", F.lower(F.lpad(F.hex("node"), 16, "0"))).alias("fingerprint")
    each = nodes.select("node", "print", at).select("stretch", value, "node", name)
    least = each.groupBy("stretch", "value").agg(F.min("node").alias("src"), F.count("*").alias("rows"))
    equal = each.select("stretch", "value", "node").join(least.where("rows > 1"), ["stretch", "value"])
    equal = put(equal.where("node <> src").select("stretch", "node", "src"), "equal")
    found = _joined(each.join(equal, ["stretch", "node"], "left_anti").select("stretch", "fingerprint"), linking, put)
    number = (F.conv(F.right(c, F.lit(16)), 16, 10).cast("long").alias(c) for c in ("src", "dst"))
    return found.select(*number).unionByName(equal.select("src", F.col("node").alias("dst")))
