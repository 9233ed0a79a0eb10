"""Benchmark passages in documents, found by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.arrow import map_rows, row_test

MIN_TILE = 5
MIN_COVERAGE = 0.5
BLOCK_BYTES = 16 << 20
#: Seeds of a document that are looked at together.
SEEDS = 1 << 18

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    if n:
        steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def running_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2**64) of every window of ``width`` ids, from running sums."""
    n = len(ids) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids.astype(np.uint64) * _powers(_BASE, len(ids)), dtype=np.uint64)))
    return (sums[width:] - sums[:n]) * _powers(_INVERSE, n)


@dataclass
class Index:
    """Shared-token seeds of a block of items: hashes of word windows, sorted, by width of the window.

    Windows are ``least`` words wide; an item of fewer words is one window as wide as itself.
    """

    vocabulary: dict[str, int]
    items: list[tuple[int | None, np.ndarray]]
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # width: hashes, item, place
    least: int


def index(items: list[tuple[int | None, str | None]], least: int = MIN_TILE) -> Index:
    vocabulary: dict[str, int] = {}
    held, windows = [], {}
    for item_id, text in items:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)], np.int64)
        if len(ids):
            width = min(least, len(ids))
            found = running_hashes(ids, width)
            windows.setdefault(width, []).append((found, np.full(len(found), len(held)), np.arange(len(found))))
            held.append((item_id, ids))
    for width, parts in windows.items():
        hashes, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        windows[width] = hashes[order], item[order], place[order]
    return Index(vocabulary, held, windows, least)


def runs(at: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches (place in doc, place in item, size) with those joined that go on along a diagonal or overlap there."""
    order = np.lexsort((at, at - place))
    at, place, size = at[order], place[order], size[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at - place) != 0) | (at[1:] > at[:-1] + size[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    return at[first], place[first], at[last] + size[last] - at[first]


def _seeded(doc: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, width: int):
    """Matches that begin with equal windows of ``width`` ids: seeds, compared and joined along diagonals."""
    same = np.ones(len(at), bool)
    for k in range(width):
        same &= doc[at + k] == item[place + k]
    at, place = at[same], place[same]
    # Seeds overlap if they are one apart: a match of n seeds is n - 1 + width long.
    at, place, size = runs(at, place, np.ones(len(at), np.int64))
    return at, place, size + width - 1


def tile(doc: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``tiles`` of the matches that windows of ``least`` ids with equal hashes begin."""
    return tiles(len(doc), len(item), *_seeded(doc, item, at, place, least), least)


def tiles(doc_size: int, item_size: int, at: np.ndarray, place: np.ndarray, size: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of tiles, longest first.

    Of the maximal matches given, the longest is marked again and again; what marked words
    cut off a match goes back if it is long enough.
    """
    heap = list(zip((-size).tolist(), at.tolist(), place.tolist(), strict=True))
    heapq.heapify(heap)
    marked_doc, marked_item = np.zeros(doc_size, bool), np.zeros(item_size, bool)
    left = item_size
    found = []
    while heap and left >= least:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = ~(marked_doc[i : i + n] | marked_item[j : j + n])
        if free.all():
            marked_doc[i : i + n] = marked_item[j : j + n] = True
            left -= n
            found.append((i, j, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False]))))
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start >= least:
                heapq.heappush(heap, (start - end, i + start, j + start))
    return found


def _met(doc: np.ndarray, known: Index, width: int):
    """(item, matches) of the items that share windows of ``width`` words with the document.

    Seeds are made, compared and joined a bounded number at a time. What is kept are
    matches, of which a word that both repeat gives one on each diagonal.
    """
    hashes, item, place = known.windows[width]
    strange = np.concatenate(([0], np.cumsum(doc == 0)))
    at = np.flatnonzero(strange[width:] == strange[: len(doc) - width + 1])
    if not len(at):
        return
    own = running_hashes(doc, width)[at]
    low = np.searchsorted(hashes, own, "left")
    size = np.searchsorted(hashes, own, "right") - low
    at, low, size = at[size > 0], low[size > 0], size[size > 0]
    held: dict[int, list] = {}
    ends = np.cumsum(size)
    begin = 0
    while begin < len(at):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + SEEDS, side="right")))
        n = size[begin:end]
        entry = np.repeat(low[begin:end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        seeds, of, where = np.repeat(at[begin:end], n), item[entry], place[entry]
        order = np.argsort(of, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            k = int(of[part[0]])
            held.setdefault(k, []).append(_seeded(doc, known.items[k][1], seeds[part], where[part], width))
        begin = end
    for k, parts in sorted(held.items()):
        yield k, runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def matches(text: str | None, known: Index, min_coverage: float = MIN_COVERAGE):
    """(item_id, item_words, covered_words, n_tiles, longest_tile) of items in the text."""
    found = words(text)
    doc = np.fromiter(map(known.vocabulary.get, found, repeat(0)), np.int64, len(found))
    for width in known.windows:
        if width <= len(doc):
            for k, (at, place, size) in _met(doc, known, width):
                item_id, ids = known.items[k]
                marked = tiles(len(doc), len(ids), at, place, size, width)
                covered = sum(t[2] for t in marked)
                if marked and covered >= min_coverage * len(ids):
                    yield item_id, len(ids), covered, len(marked), marked[0][2]


def _blocks(benchmark: DataFrame, least: int, block_bytes: int):
    """Indexes of the benchmark in blocks of about ``block_bytes`` of text, by hash of the row.

    One block at a time passes the driver and is sent to the executors.
    """
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield spark.sparkContext.broadcast(index([tuple(r) for r in rows], least))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_tile: int = MIN_TILE,
    min_coverage: float = MIN_COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, n_tiles, longest_tile).

    One row per row of ``docs`` and benchmark item of which tiles of ``min_tile`` words or
    more cover ``min_coverage`` or more, in any order of passages. Words are lower-cased
    runs of letters, digits and underscores. Null and empty texts match nothing, nor do
    items without words; an item of fewer than ``min_tile`` words is found where all of it
    stands. Texts may have any length and repeat a word as often as they like. Repeated
    documents and items give a row each, an empty table gives none. Other columns play no
    part. The benchmark is the query set: all of it runs against all documents, in blocks of
    about ``block_bytes``.
    """
    schema = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, longest_tile long"
    found = None
    for block in _blocks(benchmark, min_tile, block_bytes):

        def setup(block=block):
            known = block.value
            return lambda rows: ((i, *m) for i, t in rows for m in matches(t, known, min_coverage))

        part = map_rows(docs.select("doc_id", "text"), setup, schema)
        found = found.unionByName(part) if found else part
    return found.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_tile: int = MIN_TILE,
    min_coverage: float = MIN_COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` in which no item is covered, with their columns as they are.

    Null and empty texts stay, repeated rows stay or go together, and an empty benchmark
    drops nothing.
    """
    for block in _blocks(benchmark, min_tile, block_bytes):

        def make(block=block):
            known = block.value
            return lambda texts: [next(matches(t, known, min_coverage), None) is None for t in texts]

        docs = docs.where(row_test(make)(docs["text"]))
    return docs
