"""Greedy string tiling against a plain version that looks at every pair."""

import random

import numpy as np
import pytest
from helpers import SF, documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from rowsieve.llm import decontaminate as dc


def plain_tiles(doc, item, least):
    """Sizes of tiles: again and again the longest match of unmarked words is marked."""
    free_doc, free_item = [True] * len(doc), [True] * len(item)
    sizes = []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_doc[i + n] and free_item[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return sizes
        for k in range(n):
            free_doc[i + k] = free_item[j + k] = False
        sizes.append(n)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=24), st.lists(st.sampled_from("abcd"), max_size=14), st.integers(1, 4))
def test_first_tile_and_marks(doc, item, least):
    """The longest tile is the plain one's; no word is marked twice, and what is left is short."""
    known = dc.index([(1, " ".join(item))], least)
    ids = np.array([known.vocabulary.get(w, 0) for w in doc], np.int64)
    own = np.array([known.vocabulary.get(w, -1) for w in item], np.int64)
    pairs = [
        (i, j)
        for i in range(len(doc) - least + 1)
        for j in range(len(item) - least + 1)
        if doc[i : i + least] == item[j : j + least]
    ]
    at, place = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    found = dc.tile(ids, own, at, place, least) if pairs else []
    want = plain_tiles(doc, item, least)
    assert [t[2] for t in found][:1] == want[:1]
    marked_doc = [i + k for i, _, n in found for k in range(n)]
    marked_item = [j + k for _, j, n in found for k in range(n)]
    assert len(set(marked_doc)) == len(marked_doc) and len(set(marked_item)) == len(marked_item)
    assert all(doc[i : i + n] == item[j : j + n] and n >= least for i, j, n in found)
    free = [(i, j) for i, j in pairs if not {*range(i, i + least)} & {*marked_doc} and not {*range(j, j + least)} & {*marked_item}]
    assert not free


def test_running_hashes():
    ids = np.array([3, 1, 4, 1, 5, 9, 2, 6, 1, 4, 1, 5], np.int64)
    hashes = dc.running_hashes(ids, 3)
    assert len(hashes) == 10
    assert hashes[1] == hashes[8] and hashes[2] == hashes[9]
    assert len(set(hashes.tolist())) == 8
    assert len(dc.running_hashes(ids, 13)) == 0


def test_documents(spark):
    """Against coverage by every shared window, on real tables, also in several blocks."""
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: dc.words(r.text) for r in benchmark.collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        words = dc.words(r.text)
        windows = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for item_id, w in items.items():
            covered = {k + j for k in range(len(w) - 4) if tuple(w[k : k + 5]) in windows for j in range(5)}
            if 2 * len(covered) >= len(w):
                want.add((r.doc_id, item_id))
    assert want
    for block_bytes in (dc.BLOCK_BYTES, 2000):
        got = dc.contaminated(docs, benchmark, block_bytes=block_bytes)
        assert set(rows(got, "doc_id", "item_id")) == want
    kept = dc.drop_contaminated(docs, benchmark, block_bytes=2000)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_reordered_passage(spark):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(40)]
    parts = [words[k : k + 8] for k in range(0, 40, 8)]
    rng.shuffle(parts)
    noise = ["noise"] * 50
    moved = " ".join(noise + [w for p in parts for w in [*p, "x"]] + noise)
    data = [(1, moved), (2, " ".join(noise + words[:19])), (3, " ".join(words[::-1])), (4, " ".join(words).upper())]
    items = spark.createDataFrame([(7, " ".join(words)), (8, "two words"), (9, None), (None, "")], "item_id long, text string")
    got = rows(dc.contaminated(documents(spark, data), items), "doc_id", "item_id", "covered_words", "n_tiles", "longest_tile")
    assert got == [(1, 7, 40, 5, 8), (4, 7, 40, 1, 40)]


@pytest.mark.parametrize("items", [[], [(1, None), (2, "")], [(1, "one two three four five six"), (1, "one two three four five six")]])
def test_awkward_rows(spark, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark)
    assert dc.contaminated(docs, benchmark).count() == 0
    assert dc.drop_contaminated(docs, benchmark).count() == 15
    assert dc.contaminated(documents(spark, []), benchmark).count() == 0


def test_short_items_count_as_a_whole(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "omega psi"), (3, "one two three four five")], "item_id long, text string")
    data = [(1, "x alpha beta gamma delta y"), (2, "alpha beta gamma x delta"), (3, "Omega, Psi."), (4, "psi omega"), (5, "omega"), (6, "one two three four")]
    got = rows(dc.contaminated(documents(spark, data), items), "doc_id", "item_id", "covered_words", "n_tiles", "longest_tile")
    assert got == [(1, 1, 4, 1, 4), (3, 2, 2, 1, 2)]


def test_a_word_repeated_in_both(monkeypatch):
    """Memory goes with the words of both texts, not with their pairs; parts of seeds give the same tiles."""
    import tracemalloc

    known = dc.index([(1, "word " * 400)])
    tracemalloc.start()
    assert list(dc.matches("word " * 80_000, known)) == [(1, 400, 400, 1, 400)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    rng = random.Random(3)
    item = " ".join(rng.choice("abc") for _ in range(60))
    texts = [" ".join(rng.choice("abc") for _ in range(500)) for _ in range(20)]
    known = dc.index([(1, item), (2, "a b"), (3, item + " " + item)])
    whole = [list(dc.matches(t, known, 0.1)) for t in texts]
    monkeypatch.setattr(dc, "SEEDS", 64)
    assert [list(dc.matches(t, known, 0.1)) for t in texts] == whole and any(whole)
