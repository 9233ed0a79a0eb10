"""The trie of conversation prefixes, as tables of slots per shard.

A prefix's digest is the sum, in two lanes of 64 bits, of its turns' digests mixed with
their places, so that prefixes of a conversation cut between shards still add up. Shards
are ranges of sorted turns of bounded size. Twice each shard gives the distinct prefixes
in it slots by a minimal perfect hash, scatters counts into flat arrays and gives one row a
slot: first members and ends, then, with every node's value entered at its smallest
member alone, the sums over subtrees along the slots of parents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.slots import Slots, distinct, mix
from rowsieve.llm.tables import shuffle_partitions, written
from rowsieve.operators.small import join_small

#: Turns of a shard on average.
SHARD_ROWS = 1 << 18
#: Conversations share the head of the first of so many, up to so many turns.
GROUP, HEADS = 100, 6
#: Ids in a piece of the text whose digest tells a node's ends.
PIECE = 512
#: Digest of the empty turn above all first turns.
_NONE = bytes(16)
#: Marks digests of rows that are kept apart in a shard.
_APART = np.uint64(0xA5A5A5A5A5A5A5A5)


def _numpy(batch: pa.RecordBatch, name: str, kind=None) -> np.ndarray:
    found = batch.column(name).to_numpy(zero_copy_only=False)
    return found if kind is None else found.view(kind)


def _lanes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of 16-byte digests."""
    both = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)


def _steps(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a turn at place ``at`` adds to the digest of its prefix; the root adds nothing."""
    with np.errstate(over="ignore"):
        place = at.astype(np.uint64)
        low = mix(low + place * np.uint64(0x9E3779B97F4A7C15))
        high = mix(high ^ mix(place + np.uint64(0xD1B54A32D192ED03)))
    return np.where(at > 0, low, np.uint64(0)), np.where(at > 0, high, np.uint64(0))


def _run_starts(ids: np.ndarray) -> np.ndarray:
    """For each row the index at which its run of equal ids begins."""
    new = np.flatnonzero(np.diff(ids)) + 1
    return np.repeat(np.concatenate(([0], new)), np.diff(np.concatenate(([0], new, [len(ids)]))))


def _ranged(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """``df`` range-partitioned and sorted, with the partition as ``part``."""
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id, with their place (from 1) within it in this partition."""
    last, before = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = _numpy(batch, "conv_id")
        starts = _run_starts(ids)
        place = np.arange(len(ids)) - starts + 1
        place[starts == 0] += before if ids[0] == last else 0
        last, before = ids[-1], place[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, depth), with the digest of the prefix as far as it lies in this partition."""
    last, held = None, (np.uint64(0), np.uint64(0))
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, depth = _numpy(batch, "conv_id"), _numpy(batch, "depth")
        steps = _steps(*_lanes(batch.column("turn_digest")), depth)
        starts = _run_starts(ids)
        sums = []
        with np.errstate(over="ignore"):
            for step, before in zip(steps, held, strict=True):
                run = np.cumsum(step, dtype=np.uint64)
                run = run - (run - step)[starts]
                run[starts == 0] += before if ids[0] == last else np.uint64(0)
                sums.append(run)
        last, held = ids[-1], tuple(s[-1] for s in sums)
        yield pa.RecordBatch.from_pydict(
            {c: batch.column(c) for c in ("part", "conv_id", "depth", "points", "ends")}
            | {c: pa.array(x.view(np.int64)) for c, x in zip(("step_low", "step_high", "low", "high"), (*steps, *sums), strict=True)}
        )


def _edges(df: DataFrame, *more: str) -> list:
    """(part, first, last) of each partition in order: its first conversation, and its last row. One row a partition."""
    last = F.max(F.struct("conv_id", *more)).alias("last")
    return sorted(df.groupBy("part").agg(F.min("conv_id").alias("first"), last).collect(), key=lambda r: r.part)


def _carried(edges: list, value: Callable, add: Callable) -> dict[int, tuple]:
    """part: (conversation, what the partitions before hold of it), where one goes on in the next partition."""
    out: dict[int, tuple] = {}
    for before, now in zip(edges, edges[1:], strict=False):
        if before.last.conv_id == now.first:
            held = value(before.last)
            if before.first == now.first and before.part in out:
                held = add(held, out[before.part][1])
            out[now.part] = (now.first, held)
    return out


def _placed(conversations: DataFrame, n: int) -> DataFrame:
    """(conv_id, place, turn_digest, points) of every turn, in order of turn.

    Only digests move, never texts. A conversation of any length lies in as many
    partitions as it fills.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        "conv_id",
        "turn",
        F.unhex(F.substring(digest, 1, 32)).alias("turn_digest"),
        F.char_length(text).cast("long").alias("points"),
        F.monotonically_increasing_id().alias("tie"),  # so that repeated rows can be parted
    )
    order = ("conv_id", F.asc_nulls_first("turn"), "turn_digest", "tie")
    turns = _ranged(turns, n, *order).select("conv_id", "turn_digest", "points", "part")
    schema = "conv_id long, turn_digest binary, points long, part int, place long"
    turns = written(turns.mapInArrow(_numbered, schema), "turns")
    carried = _carried(_edges(turns, "place"), lambda last: last.place, int.__add__)
    if carried:
        rows = [(part, conv, held) for part, (conv, held) in carried.items()]  # a row a partition at most
        more = turns.sparkSession.createDataFrame(rows, "part int, conv_id long, held long")
        turns = join_small(turns, more, ["part", "conv_id"]).withColumn("place", F.expr("place + coalesce(held, 0)"))
    return turns.select("conv_id", "place", "turn_digest", "points")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, turn_digest, points, ends) of rebuilt conversations, each with its root at depth 0.

    Conversation c takes the first h turns of c - c % 100 and its own after its first h,
    with h = crc32(c) % 6. ``ends`` marks its last row.
    """
    heads = turns.where((F.col("place") < HEADS) & (F.col("conv_id") % GROUP == 0))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "turn_digest", "points"))).alias("head")  # five at most
    )
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("own")).select(
        "conv_id",
        "own",
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"),
    )
    convs = convs.join(heads, "base", "left").withColumn("k", F.expr("least(h, coalesce(size(head), 0))"))
    convs = convs.withColumn("length", F.expr("k + greatest(0, own - h)"))
    root = F.struct(F.lit(0).cast("long").alias("place"), F.lit(_NONE).alias("turn_digest"), F.lit(0).cast("long").alias("points"))
    shared = F.expr("coalesce(slice(head, 1, cast(k as int)), array())")
    given = convs.select("conv_id", "length", F.posexplode(F.concat(F.array(root), shared)).alias("depth", "turn"))
    given = given.select("conv_id", F.col("depth").cast("long").alias("depth"), "turn.turn_digest", "turn.points", "length")
    rest = turns.join(convs.select("conv_id", "h", "k", "length"), "conv_id").where("place > h")
    rest = rest.select("conv_id", F.expr("place - h + k").alias("depth"), "turn_digest", "points", "length")
    return given.unionByName(rest).withColumn("ends", F.col("depth") == F.col("length")).drop("length")


class Shard:
    """Rows of sorted prefixes, with their whole digests and those of their parents.

    With ``apart``, rows of a conversation that goes on from an earlier partition get slots
    of their own: their sums are handed to that partition, not to parents found here.
    """

    def __init__(self, batch: pa.Table, carried: dict[int, tuple], apart: bool = False) -> None:
        self.conv, self.depth, self.part = (_numpy(batch, c) for c in ("conv_id", "depth", "part"))
        low, high, step_low, step_high = (
            _numpy(batch, c).astype(np.int64).view(np.uint64).copy() for c in ("low", "high", "step_low", "step_high")
        )
        mark = np.zeros(len(low), np.uint64)
        with np.errstate(over="ignore"):
            for part in np.unique(self.part).tolist():
                if part in carried:
                    conv, held = carried[part]
                    on = (self.part == part) & (self.conv == conv)
                    mark[on] = _APART if apart else 0
                    low[on] += np.uint64(held[0])
                    high[on] += np.uint64(held[1])
            self.above = (low - step_low, high - step_high)
        self.low, self.high, self.step = low, high, (step_low, step_high)
        entered = distinct(low ^ mark, high)
        self.slots = Slots((low ^ mark)[entered], high[entered])
        self.slot = self.slots.of(low ^ mark, high)
        self.size = len(entered)
        self.mark = self.first(mark)

    def first(self, values: np.ndarray) -> np.ndarray:
        """By slot, the value of one of its rows; rows of a slot must agree, else two prefixes share a digest."""
        out = np.empty(self.size, values.dtype)
        out[self.slot] = values
        if (out[self.slot] != values).any():
            raise ValueError("two prefixes share a digest")
        return out

    def keys(self) -> dict[str, pa.Array]:
        return {"low": pa.array((self.slots.low ^ self.mark).view(np.int64)), "high": pa.array(self.slots.high.view(np.int64))}


_NODE = "low long, high long, depth long, above_low long, above_high long, points long, n long, conv_id long, ends long"


def _counted(carried: dict[int, tuple]):
    """Pass one: members, smallest member and ends of the prefixes of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            shard = Shard(table, carried)
            n, ends = np.zeros(shard.size, np.int64), np.zeros(shard.size, np.int64)
            least = np.full(shard.size, np.iinfo(np.int64).max)
            np.add.at(n, shard.slot, 1)
            np.add.at(ends, shard.slot, _numpy(table, "ends").astype(np.int64))
            np.minimum.at(least, shard.slot, shard.conv)
            yield pa.RecordBatch.from_pydict(
                shard.keys()
                | {
                    "depth": pa.array(shard.first(shard.depth)),
                    "above_low": pa.array(shard.first(shard.above[0]).view(np.int64)),
                    "above_high": pa.array(shard.first(shard.above[1]).view(np.int64)),
                    "points": pa.array(shard.first(_numpy(table, "points"))),
                    "n": pa.array(n),
                    "conv_id": pa.array(least),
                    "ends": pa.array(ends),
                }
            )

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to a shard's rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= SHARD_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by part, whole parts at a time; a part is a shard, of bounded size."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = _numpy(batch, "part")
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if held and held[-1].column("part")[0].as_py() != part[low]:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(pa.Table.from_batches([batch.slice(low, high - low)]))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _accumulated(carried: dict[int, tuple], below: dict[int, tuple]):
    """Pass two: sums over what lies below each prefix of a shard, for values entered at their owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _parts(batches):
            shard = Shard(table, carried, apart=True)
            owned = _numpy(table, "owned").astype(np.int64)
            saved, leaves, children = (np.zeros(shard.size, np.int64) for _ in range(3))
            np.add.at(saved, shard.slot, _numpy(table, "value"))
            np.add.at(leaves, shard.slot, _numpy(table, "leaf"))
            # A row's parent is the row before it, but for the root and where a partition begins inside a conversation.
            inside = np.flatnonzero(np.diff(shard.conv) == 0) + 1
            parent = np.full(shard.size, -1)
            parent[shard.slot[inside]] = shard.slot[inside - 1]
            np.add.at(children, shard.slot[inside - 1], owned[inside])
            part = int(shard.part[0])
            if part in below:
                more = below[part]
                for array, extra in zip((saved, leaves, children), more, strict=True):
                    array[shard.slot[-1]] += extra
            depth = shard.first(shard.depth)
            order = np.argsort(-depth, kind="stable")
            order = order[parent[order] >= 0]
            for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
                np.add.at(saved, parent[level], saved[level])
                np.add.at(leaves, parent[level], leaves[level])
            some = pa.array((saved != 0) | (leaves != 0) | (children != 0))
            sums = {"saved": pa.array(saved), "leaves": pa.array(leaves), "children": pa.array(children)}
            yield pa.RecordBatch.from_pydict(shard.keys() | sums).filter(some)

    return run


def _below(valued: DataFrame, edges: list, carried: dict[int, tuple]) -> dict[int, tuple]:
    """part: (values, leaves, children) of what follows its last row in later partitions; a row a partition."""
    if not carried:
        return {}
    rows = [(part, conv) for part, (conv, _) in carried.items()]
    on = valued.sparkSession.createDataFrame(rows, "part int, conv_id long").withColumn("on", F.lit(True))
    sums = join_small(valued, on, ["part", "conv_id"]).where("on").groupBy("part")
    found = {r.part: r for r in sums.agg(F.sum("value").alias("value"), F.sum("leaf").alias("leaf"), F.min_by("owned", "depth").alias("first")).collect()}
    out: dict[int, tuple] = {}
    for now, after in reversed(list(zip(edges, edges[1:], strict=False))):
        if after.part in carried:
            here = found[after.part]
            value, leaf = here.value, here.leaf
            if after.first == after.last.conv_id and after.part in out:
                value, leaf = value + out[after.part][0], leaf + out[after.part][1]
            out[now.part] = (value, leaf, int(here.first))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (low, high, conv_id), put together as text of up to PIECE ids."""
    for batch in batches:
        low, high, ids = (_numpy(batch, c) for c in ("low", "high", "conv_id"))
        if not len(ids):
            continue
        cuts = np.flatnonzero((np.diff(low) != 0) | (np.diff(high) != 0)) + 1
        cuts = np.union1d(np.concatenate(([0], cuts, [len(ids)])), np.arange(0, len(ids), PIECE))
        text = list(map(str, ids.tolist()))
        pieces = [",".join(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        at = cuts[:-1]
        yield pa.RecordBatch.from_pydict({"low": low[at], "high": high[at], "first": ids[at], "text": pieces})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (low, high, first): the SHA-256 of each digest's joined text, piece by piece."""
    now, state = None, None
    for batch in batches:
        done = []
        for low, high, text in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "text")), strict=True):
            if now != (low, high):
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (low, high), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("low", "high", "ends_sha256"), zip(*done, strict=True), strict=True)))
    if now:
        yield pa.RecordBatch.from_pydict({"low": [now[0]], "high": [now[1]], "ends_sha256": [state.hexdigest()]})


def _ended(carried: dict[int, tuple]):
    """(low, high, conv_id) of the last rows of conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            shard = Shard(table, carried)
            on = _numpy(table, "ends")
            yield pa.RecordBatch.from_pydict(
                {"low": shard.low.view(np.int64)[on], "high": shard.high.view(np.int64)[on], "conv_id": shard.conv[on]}
            )

    return run


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Turns are in order of ``turn``, null first; equal ones (repeated rows too) by a digest
    of role and text, each counting as a turn. Null role or text is empty. A turn without a
    conv_id belongs to no conversation and plays no part. Texts and conversations may have
    any length. An empty table has no conversation and so no node. Other columns play no part.
    """
    spark = conversations.sparkSession
    n = max(shuffle_partitions(spark), -(-conversations.count() // SHARD_ROWS))
    prefix = "part int, conv_id long, depth long, points long, ends boolean, step_low long, step_high long, low long, high long"
    paths = _ranged(rebuilt(_placed(conversations, n)), n, "conv_id", "depth").mapInArrow(_summed, prefix)
    paths = written(paths, "prefixes")
    edges = _edges(paths, "depth", "low", "high")
    lanes = lambda last: (last.low % (1 << 64), last.high % (1 << 64))
    carried = _carried(edges, lanes, lambda a, b: tuple((x + y) % (1 << 64) for x, y in zip(a, b, strict=True)))

    agree = F.struct("depth", "above_low", "above_high", "points")
    nodes = paths.mapInArrow(_counted(carried), _NODE).groupBy("low", "high")
    nodes = nodes.agg(
        F.min(agree).alias("one"),
        F.max(agree).alias("other"),
        F.sum("n").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.sum("ends").alias("ends"),
    )
    sound = F.when(F.col("one") == F.col("other"), F.col("one")).otherwise(F.raise_error(F.lit("two prefixes share a digest")))
    nodes = written(nodes.withColumn("one", sound).select("low", "high", "one.*", "n_convs", "conv_id", "ends"), "nodes")

    # Each node is entered once, at its smallest member; below a root of a conversation's own, that is itself.
    owned = nodes.select(
        "conv_id",
        "depth",
        ((F.col("n_convs") - 1) * F.col("points")).alias("value"),
        (F.col("ends") == F.col("n_convs")).cast("long").alias("leaf"),
        F.lit(True).alias("owned"),
    )
    valued = paths.join(owned, ["conv_id", "depth"], "left").withColumns(
        {"value": F.expr("coalesce(value, 0)"), "leaf": F.expr("coalesce(leaf, 0)"), "owned": F.expr("coalesce(owned, false)")}
    )
    if carried:
        valued = written(valued, "valued")
    below = _below(valued, edges, carried)
    shards = valued.repartition(n, "part").sortWithinPartitions("part", "conv_id", "depth")
    sums = "low long, high long, saved long, leaves long, children long"
    sums = shards.mapInArrow(_accumulated(carried, below), sums).groupBy("low", "high").agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.sum("children").alias("n_children")
    )

    ends = paths.mapInArrow(_ended(carried), "low long, high long, conv_id long")
    order = ("low", "high", "conv_id")
    pieces = _ranged(ends, n, *order).drop("part").mapInArrow(_pieces, "low long, high long, first long, text string")
    order = ("low", "high", "first")
    ends = pieces.repartition(n, "low", "high").sortWithinPartitions(*order)
    ends = ends.mapInArrow(_hashed, "low long, high long, ends_sha256 string")

    above = nodes.select(F.col("low").alias("above_low"), F.col("high").alias("above_high"), F.col("conv_id").alias("parent"))
    found = nodes.join(sums, ["low", "high"], "left").join(ends, ["low", "high"], "left").join(above, ["above_low", "above_high"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        zero("n_children"),
        zero("n_leaves"),
        zero("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
