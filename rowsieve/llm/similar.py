"""Texts whose sets of word shingles are alike: SimHash tries, completed by MinHash bands; links counted exactly."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.arrow import map_rows
from rowsieve.llm import components as parts
from rowsieve.llm.tables import written
from rowsieve.llm.tries import Linking, majority, node_links
from rowsieve.llm.words import shingle_hashes
from rowsieve.operators.small import join_small
from rowsieve.session import checkpointed, drop_path, scratch_path, stage


@dataclass(frozen=True)
class Similar:
    """Two texts are linked if their sets of shingles have a Jaccard similarity of 0.8 or more.

    ``width`` words make a shingle. Two texts are compared if the ``trie`` join of their
    SimHash fingerprints links them. At 0.8 a bit of these differs in 15 of 100 cases, and
    some stretch is within the budget for nine pairs in ten, for more above. For the pairs
    it leaves out, texts are also compared if all ``hashes`` MinHashes of one of ``bands``
    bands are equal, which at 0.8 misses (1 - 0.8^4)^24, three in a million. What is
    compared is counted exactly.
    """

    width: int = 5
    bands: int = 24
    hashes: int = 4
    trie: Linking = Linking(width=5, lanes=4, stretch=32, budget=3, most=64, once=True, task_rows=1 << 17)


#: Links texts whose 5-word shingles have a Jaccard similarity of 0.8 or more.
SIMILAR = Similar()
#: The same with longer bands, for groups that are large otherwise: misses as few, parts unlike texts better.
FINE = Similar(bands=42, hashes=6)
#: Similarity as a fraction in whole numbers.
OVER, UNDER = 4, 5
SEED = 42
PART = 2048
#: Texts of a group, and shingles in all of them, that are compared within one task.
GROUP, SHINGLES = 512, 1 << 20
#: Cells of the table that rules out pairs of a task.
CELLS = 1 << 23


def components(edges: DataFrame) -> DataFrame:
    """``parts.components``, after which the shuffles and checkpoints of its rounds are let go.

    Spark drops what nothing refers to any more when the driver collects its garbage, which
    a driver with little to do does late.
    """
    found = checkpointed(parts.components(edges))
    gc.collect()
    edges.sparkSession.sparkContext._jvm.System.gc()
    return found


def grouped(stars: DataFrame, put=written) -> DataFrame:
    """(node, root) of every node of ``stars`` (node, low): all nodes of one low hang together.

    A low is a node of its own star, and a node has few lows, one for each of its keys. It
    is hung under the least of them, and only these least ones and the lows beside them are
    edges: a large group of copies that share its lows brings few into the rounds, not its
    keys. ``root`` is one of the lows that can be reached, the same for all.
    """
    lows = stars.groupBy("node").agg(F.array_sort(F.collect_set("low")).alias("lows"))
    lows = put(lows, "lows")
    beside = lows.select(F.col("lows")[0].alias("src"), F.explode(F.expr("slice(lows, 2, size(lows))")).alias("dst"))
    found = components(beside.distinct()).withColumnRenamed("node", "low")
    hung = lows.select("node", F.col("lows")[0].alias("low")).join(found, "low", "left")
    return hung.select("node", F.coalesce("root", "low").alias("root"))


def near_prints(nodes: DataFrame, linking: Similar, put=written) -> DataFrame:
    """Stars (node, low) of the ``nodes`` (node, print, n) that the trie join links to another."""
    found = node_links(nodes.where("n > 0").select("node", "print"), linking.trie, put)
    return found.select(F.explode(F.array("src", "dst")).alias("node"), F.col("src").alias("low")).distinct()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; no words give none."""
    return np.unique(np.concatenate([*shingle_hashes(text, width), np.empty(0, np.uint64)]))


def band_keys(shingles: np.ndarray, linking: Similar) -> np.ndarray:
    """A 64-bit key for each band; no shingles give none."""
    if not len(shingles):
        return np.empty(0, np.int64)
    rng = np.random.default_rng(SEED)
    turn, factor, mix = (rng.integers(0, 1 << 64, linking.bands * linking.hashes, np.uint64, endpoint=False) for _ in range(3))
    factor, mix = factor | np.uint64(1), mix | np.uint64(1)
    least = np.full(len(turn), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), PART):
        part = shingles[at : at + PART, None]
        np.minimum(least, ((part ^ turn) * factor).min(axis=0), out=least)
    least ^= least >> np.uint64(29)
    return (least * mix).reshape(linking.bands, linking.hashes).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketched(base: DataFrame, linking: Similar) -> DataFrame:
    """(row, doc_id, text_hash, fingerprint, print, keys, n) of every row (row, doc_id, text) of ``base``.

    ``n`` shingles are in the set. Equal sets have equal fingerprints; null and empty
    texts have the empty set. ``print`` is the SimHash of the set.
    """

    def setup():
        def work(rows):
            for row, doc_id, text_hash, text in rows:
                found = shingle_set(text, linking.width)
                name = blake2b(found.tobytes(), digest_size=16).hexdigest()
                yield row, doc_id, text_hash, name, majority([found], linking.trie.lanes), band_keys(found, linking), len(found)

        return work

    columns = base.select("row", "doc_id", F.xxhash64("text"), "text")
    schema = "row long, doc_id long, text_hash long, fingerprint string, print string, keys array<long>, n int"
    return map_rows(columns, setup, schema)


def _sets(texts: DataFrame, linking: Similar) -> DataFrame:
    """(node, shingles) of ``texts`` (node, text)."""

    def setup():
        return lambda rows: [(node, shingle_set(text, linking.width).view(np.int64)) for node, text in rows]

    return map_rows(texts.select("node", "text"), setup, "node long, shingles array<long>")


def _possible(sets: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Which two sets may be alike, by places that their shingles fall to.

    What two sets have in common falls to places that both hold; of several shingles at a
    place, all but one can be common beyond these. So no alike pair is ruled out.
    """
    places = 64
    while places < 8 * np.median(size) and 2 * places * len(sets) <= CELLS:
        places *= 2
    holds = np.zeros((len(sets), places), np.float32)
    for row, shingles in zip(holds, sets, strict=True):
        row[(shingles % np.uint64(places)).astype(np.int64)] = 1
    more = size - holds.sum(axis=1)
    common = holds @ holds.T + np.minimum(more[:, None], more[None, :])
    return common * (OVER + UNDER) >= (size[:, None] + size[None, :]) * OVER


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each of some sorted ``sets``, the index of the first one that links reach.

    Only pairs that may be alike and are not yet linked are counted, exactly.
    """
    size = np.array([len(s) for s in sets])
    possible = _possible(sets, size)
    root = np.arange(len(sets))
    for i in range(len(sets)):
        for j in np.flatnonzero(possible[i, i + 1 :]) + i + 1:
            if root[i] != root[j]:
                common = size[i] + size[j] - len(np.union1d(sets[i], sets[j]))
                if common * (OVER + UNDER) >= (size[i] + size[j]) * OVER:
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
    return root


def _groups(linking: Similar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (task, node, text) sorted by task; the texts of a task are compared, each with each."""
        now, held = None, {}

        def done():
            nodes = sorted(held)
            roots = linked([held[k] for k in nodes])
            return pa.RecordBatch.from_pydict({"src": pa.array([nodes[k] for k in roots]), "dst": pa.array(nodes)})

        for batch in batches:
            for task, node, text in zip(*(batch.column(c) for c in ("task", "node", "text")), strict=True):
                if held and task.as_py() != now:
                    yield done()
                    held = {}
                now = task.as_py()
                held[node.as_py()] = shingle_set(text.as_py(), linking.width)
        if held:
            yield done()

    return run


def _compared(texts: DataFrame, linking: Similar) -> DataFrame:
    """Links (src, dst) between ``texts`` (task, node, text) of a task, one for each of them at most."""
    dealt = texts.select("task", "node", "text").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(_groups(linking), "src long, dst long").where("src <> dst")


def _near_sizes(a: str, b: str):
    return F.expr(f"least({a}, {b}) * {UNDER} >= greatest({a}, {b}) * {OVER}")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (src, dst) whose similarity is high enough, by counting."""
    one, other = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}")) for c in ("src", "dst"))
    common = F.size(F.array_intersect("_src", "_dst"))
    both = F.size("_src") + F.size("_dst")
    # common / (both - common) >= OVER / UNDER
    return (
        pairs.join(one, "src").join(other, "dst").where(common * (OVER + UNDER) >= both * OVER).select(pairs.columns)
    )


def _starred(buckets: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root), and (node, root, n) of the nodes that share a key with one of another root.

    The rows of each key of ``buckets`` (key, node, n) are compared with one of them, drawn
    by hash. A node's root is the first drawn node that it is alike to, or itself, so equal
    roots are linked. A large group of near copies costs its rows, not their pairs.
    """
    drawn = F.min(F.struct(F.xxhash64("node").alias("by"), "node", "n")).alias("drawn")
    met = buckets.join(buckets.groupBy("key").agg(drawn), "key")
    pairs = met.where((F.col("node") != F.col("drawn.node")) & _near_sizes("n", "drawn.n"))
    pairs = pairs.select(F.col("node").alias("src"), F.col("drawn.node").alias("dst")).distinct()
    first = _verified(pairs, sets).groupBy(F.col("src").alias("node")).agg(F.min_by("dst", F.xxhash64("dst")).alias("to"))
    roots = buckets.select("node", "n").distinct().join(first, "node", "left")
    roots = checkpointed(roots.select("node", "n", F.coalesce("to", "node").alias("root")))
    now = buckets.select("key", "node").join(roots, "node")
    apart = now.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    return roots.select("node", "root"), now.join(apart, "key", "left_semi").select("node", "root", "n").distinct()


def _blocks(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """(task, node, text): each two blocks of the nodes of a group meet in a task of bounded size.

    ``groups``: (node, root, n). A group is dealt into as many blocks as keep two of them
    within ``GROUP`` texts and ``SHINGLES`` shingles. What a task gives out are links that
    join its texts, never their pairs.
    """
    sizes = groups.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    whole = (F.col("rows") <= GROUP) & (F.col("total") <= SHINGLES)
    many = F.ceil(F.greatest(F.col("rows") / (GROUP // 2), F.col("total") / (SHINGLES // 2)))
    sizes = sizes.select("root", F.when(whole, F.lit(1)).otherwise(many).cast("int").alias("blocks"))
    dealt = groups.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    # A block alone meets itself; of several, each meets all others, and so itself there too.
    met = other.where("blocks = 1 or block <> other")
    task = F.concat_ws(":", "root", F.least("block", "other"), F.greatest("block", "other")).alias("task")
    return texts.join(met.select("node", task), "node")


class Tables:
    """Tables written on the way to a result, and dropped together once that is written itself."""

    def __init__(self) -> None:
        self._paths: list[tuple] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(df.sparkSession, label)
        self._paths.append((df.sparkSession, path))
        return stage(df, path)

    def drop(self) -> None:
        while self._paths:
            drop_path(*self._paths.pop())


def crowded(buckets: DataFrame, texts: DataFrame, linking: Similar, put=written) -> DataFrame:
    """Links (src, dst) that join all alike nodes of ``buckets`` (key, node, n), for groups too large for a task.

    First the near copies among them are found by comparing rows with drawn ones. What is
    left shares keys and is mostly unlike, a common passage say: longer bands part it, and
    only nodes of unlike roots that share one of those are compared, in blocks.
    """
    sets = put(_sets(texts, linking), "sets")
    roots, left = _starred(buckets, sets)

    def finer():
        return lambda rows: [(*row, band_keys(np.array(found, np.int64).view(np.uint64), FINE)) for *row, found in rows]

    fine = map_rows(left.join(sets, "node"), finer, "node long, root long, n int, keys array<long>")
    fine = fine.select("node", "n", "root", F.explode("keys").alias("key"))
    fine = put(fine, "fine")
    least = fine.groupBy("key").agg(F.min("node").alias("low"), F.min("root").alias("a"), F.max("root").alias("b"))
    met = checkpointed(fine.join(least.where("a <> b").select("key", "low"), "key").select("node", "low", "n").distinct())
    groups = grouped(met.select("node", "low"), put)
    groups = checkpointed(groups.join(met.select("node", "n").distinct(), "node"))
    found = _compared(_blocks(texts, groups), linking)
    return roots.where("node <> root").select(F.col("root").alias("src"), F.col("node").alias("dst")).unionByName(found)


def roots(nodes: DataFrame, base: DataFrame, linking: Similar, put=written) -> DataFrame:
    """(node, root) of ``nodes`` (node, print, keys, n) that are alike to another; ``base`` has their texts.

    Nodes that tries link or that share keys, over any number of steps, are a group: no link leaves it. A
    group of bounded size is compared within one task, all texts against all, so each
    text moves once. Larger groups are first thinned out.
    """
    buckets = nodes.select("node", "n", F.explode("keys").alias("key"))
    least = buckets.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("rows")).where("rows > 1")
    buckets = put(buckets.join(least.select("key", "low"), "key"), "buckets")
    near = put(near_prints(nodes, linking, put), "near")
    groups = grouped(near.unionByName(buckets.select("node", "low")), put)
    groups = groups.join(nodes.select("node", "n"), "node")
    sizes = groups.groupBy("root").agg(((F.count("*") > GROUP) | (F.sum("n") > SHINGLES)).alias("large"))
    groups = put(groups.join(sizes, "root").select("node", "root", "n", "large"), "groups")
    texts = base.select(F.col("row").alias("node"), "text").join(groups, "node")
    texts = put(texts, "texts")
    found = _compared(texts.where("not large").withColumn("task", F.col("root").cast("string")), linking)
    large = groups.where("large").select("node", "n", F.xxhash64(F.lit("group"), "root").alias("key"))
    if not large.isEmpty():
        # The group is a key too, so that texts which only tries link are not left out.
        some = buckets.drop("low").join(large.select("node"), "node", "left_semi").unionByName(large)
        found = found.unionByName(crowded(put(some, "crowded"), texts.where("large").select("node", "text"), linking, put))
    return components(found)


def classes(docs: DataFrame, linking: Similar) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprints, and distinct fingerprints with root and first row.

    Texts are written once with a number for each row. Each distinct set is a node, so
    exact copies cost nothing in the join. Only the result is kept.
    """
    put = Tables()
    try:
        base = put(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts")
        rows = put(sketched(base, linking), "sketches")
        least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")).alias("first")
        same = (F.min("row").alias("node"), *(F.first(c).alias(c) for c in ("print", "keys", "n")))
        found = put(rows.groupBy("fingerprint").agg(least, *same), "classes")
        rooted = roots(found.select("node", "print", "keys", "n"), base, linking, put)
        rooted = found.select("fingerprint", "first", "node").join(rooted, "node", "left")
        rooted = written(rooted.withColumn("root", F.coalesce("root", "node")).drop("node"), "roots")
        return written(rows.select("doc_id", "text_hash", "fingerprint"), "rows"), rooted
    finally:
        put.drop()
