"""Near copies by the similarity of their shingle sets, against brute force."""

import random

import numpy as np
import pytest
from helpers import documents, rows
from pyspark.sql import functions as F

from rowsieve.llm import simhash, similar, tries


def plain_set(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_similarity(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b)


def changed(rng, words, times):
    """``words`` with every change far from the others, so each costs five shingles."""
    words = words.copy()
    for at in rng.sample(range(5, len(words) - 5, 6), times):
        words[at] = f"c{rng.randrange(10**9)}"
    return words


def test_links_are_exact_around_the_limit(spark):
    """Of 400-word texts, 8 changes leave 0.816 and 9 leave 0.794: all of the one, none of the other."""
    rng = random.Random(11)
    data, want = [], set()
    for k in range(160):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        other = changed(rng, words, 8 + k % 2)
        data += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        near = plain_similarity(data[-2][1], data[-1][1]) >= 0.8
        assert near == (k % 2 == 0)
        want |= {2 * k} if near else {2 * k, 2 * k + 1}
    assert {r[0] for r in rows(simhash.keep_first(documents(spark, data)), "doc_id")} == want


def test_groups_equal_brute_force(spark):
    """Chains of copies of copies, short texts and texts without words."""
    rng = random.Random(12)
    data = [(0, ""), (1, None), (2, "one"), (3, "One"), (4, "one two"), (5, "a b c d e f")]
    for _ in range(8):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(6):
            data.append((len(data), " ".join(words)))
            words = changed(rng, words, rng.randint(1, 5))
    root = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            a, b = data[i][1] or "", data[j][1] or ""
            if plain_set(a) == plain_set(b) or plain_similarity(a, b) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = rows(simhash.near_duplicates(documents(spark, data), simhash.SIMILAR), "doc_id", "component_id")
    assert dict(got) == dict(enumerate(root))


@pytest.mark.parametrize("text", ["", "a", "a b c d e f g", "x " * 5000, "y%d " * 9])
def test_band_keys(text):
    found = similar.shingle_set(text, 5)
    keys = similar.band_keys(found, similar.SIMILAR)
    assert len(keys) == (similar.SIMILAR.bands if len(found) else 0)
    assert len(found) == len(plain_set(text)) and np.array_equal(keys, similar.band_keys(found, similar.SIMILAR))


@pytest.mark.parametrize("group", [2, 128])
def test_groups_within_and_beyond_a_task(spark, monkeypatch, group):
    """The same classes whether groups are compared in one task or by pairs of a key."""
    monkeypatch.setattr(similar, "GROUP", group)
    rng = random.Random(15)
    data = [(0, ""), (1, None), (2, "one")]
    for _ in range(10):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(5):
            data.append((len(data), " ".join(words)))
            words = changed(rng, words, rng.randint(1, 6))
    root = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            a, b = data[i][1] or "", data[j][1] or ""
            if plain_set(a) == plain_set(b) or plain_similarity(a, b) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = rows(simhash.near_duplicates(documents(spark, data), simhash.SIMILAR), "doc_id", "component_id")
    assert dict(got) == dict(enumerate(root))


def test_linked_counts_exactly():
    """Two sets of 9 with 8 in common are at 0.8; with 7 they are not."""
    a, b, c = ([*range(8), 100], [*range(8), 200], [*range(7), 300, 400])
    sets = [np.array(sorted(x), np.uint64) for x in (a, c, b, a)]
    assert similar.linked(sets).tolist() == [0, 1, 0, 0]
    rng = np.random.default_rng(1)
    long = np.unique(rng.integers(0, 1 << 63, 50_000, np.uint64))
    fifths = [long, long[:10], long[: len(long) * 4 // 5 + 1], long[: len(long) * 3 // 4]]
    assert similar.linked(fifths).tolist() == [0, 1, 0, 0]
    assert similar.linked([long, fifths[3]]).tolist() == [0, 1]


@pytest.mark.parametrize("cells", [1 << 12, 1 << 23])
def test_no_alike_pair_is_ruled_out(monkeypatch, cells):
    monkeypatch.setattr(similar, "CELLS", cells)
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(12):
        own = rng.integers(0, 1 << 62, rng.integers(5, 900), np.uint64)
        sets += [np.unique(np.concatenate((own[k:], rng.integers(0, 1 << 62, k, np.uint64)))) for k in range(0, len(own) // 6 + 1, 20)]
    size = np.array([len(s) for s in sets])
    possible = similar._possible(sets, size)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)):
                assert possible[i, j]


def test_large_group_costs_its_rows(spark, monkeypatch):
    """Distinct near copies of one text are not compared pair by pair, and each is found."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    data = [(k, " ".join(changed(rng, base, rng.randint(1, 3)))) for k in range(600)]
    compared = []
    verified, blocks = similar._verified, similar._blocks

    def pairs_counted(pairs, sets):
        compared.append(pairs.count())
        return verified(pairs, sets)

    def blocks_counted(texts, groups):
        out = blocks(texts, groups)
        compared.extend(r["count"] ** 2 for r in out.groupBy("task").count().collect())
        return out

    monkeypatch.setattr(similar, "_verified", pairs_counted)
    monkeypatch.setattr(similar, "_blocks", blocks_counted)
    assert rows(simhash.keep_first(documents(spark, data)), "doc_id") == [(0,)]
    assert 0 < sum(compared) < 60 * len(data) < 600 * 599 / 2


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """Texts that share a long passage and are unlike but for pairs of near copies: all of these are found."""
    monkeypatch.setattr(similar, "GROUP", 16)
    rng = random.Random(14)
    passage = [f"p{k}" for k in range(300)]
    data, want = [], {}
    for k in range(60):
        own = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for words in (own, changed(rng, own, 2)):
            want[len(data)] = 2 * k
            data.append((len(data), " ".join(passage + words)))
    got = rows(simhash.near_duplicates(documents(spark, data), simhash.SIMILAR), "doc_id", "component_id")
    assert dict(got) == want


def test_blocks_let_all_meet(spark, monkeypatch):
    """Each two nodes of a group meet in a task, and no task holds more than two blocks."""
    monkeypatch.setattr(similar, "GROUP", 10)
    groups = [(k, 0, 3) for k in range(57)] + [(k, 100, 3) for k in range(100, 109)] + [(200, 200, similar.SHINGLES), (201, 200, 5)]
    groups = spark.createDataFrame(groups, "node long, root long, n int")
    texts = groups.select("node", F.lit("t").alias("text"))
    tasks = {}
    for r in similar._blocks(texts, groups).collect():
        tasks.setdefault(r.task, set()).add(r.node)
    met = {(a, b) for nodes in tasks.values() for a in nodes for b in nodes if a < b}
    assert met >= {(a, b) for b in range(57) for a in range(b)} | {(a, b) for b in range(100, 109) for a in range(100, b)} | {(200, 201)}
    assert all(len({n // 100 for n in nodes}) == 1 for nodes in tasks.values())


def test_tries_link_near_copies(spark):
    """The trie join of fingerprints finds near copies by itself, and counting keeps out what is less alike."""
    rng = random.Random(16)
    data, want = [], []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        times = (2, 12)[k % 2]
        data += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed(rng, words, times)))]
        want += [2 * k] if times == 2 else [2 * k, 2 * k + 1]
    alone = similar.Similar(bands=0)
    assert {r[0] for r in rows(simhash.keep_first(documents(spark, data), alone), "doc_id")} == set(want)


@pytest.mark.parametrize("group", [4, 512])
def test_tries_reach_large_groups(spark, monkeypatch, group):
    """Near copies that only tries link hang together, also in groups too large for a task."""
    monkeypatch.setattr(similar, "GROUP", group)
    rng = random.Random(17)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    data = [(k, " ".join(changed(rng, words, 2))) for k in range(40)] + [(99, "other words only in this one")]
    alone = similar.Similar(bands=0)
    assert rows(simhash.keep_first(documents(spark, data), alone), "doc_id") == [(0,), (99,)]


def test_node_links_join_near_prints(spark):
    """Prints with a stretch within three bits, or an equal one, hang together; each gives few links."""
    rng = random.Random(18)
    prints = {}
    for k in range(40):
        base = rng.getrandbits(256)
        for _ in range(6):
            flips = [32 * s + b for s in range(8) for b in rng.sample(range(32), 2)]
            prints[len(prints) * 7 + 3] = (k, base ^ sum(1 << at for at in flips))
            prints[len(prints) * 7 + 3] = (k, base)
    frame = spark.createDataFrame([(n, f"{p:064x}") for n, (_, p) in prints.items()], "node long, print string")
    found = tries.node_links(frame, similar.SIMILAR.trie).collect()
    assert all(prints[r.src][0] == prints[r.dst][0] for r in found) and len(found) <= 40 * len(prints)
    root = {n: n for n in prints}
    for a, b in found:
        low, high = sorted((root[a], root[b]))
        root = {n: low if r == high else r for n, r in root.items()}
    assert len(set(root.values())) == 40


def test_grouped_equals_brute_force(spark, monkeypatch):
    """Stars of any kind; a large group whose nodes share their lows brings few edges into the rounds."""
    rng = random.Random(19)
    stars = [(n, low) for low in range(0, 300, 3) for n in {low, *(rng.randrange(300) for _ in range(rng.randrange(3)))}]
    shared = [(n, low) for n in range(1000, 2000) for low in range(1000, 1024)]
    root = list(range(300))
    for a, b in stars:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    edges, plain = [], similar.parts.components

    def counted(found):
        edges.append(found.count())
        return plain(found)

    monkeypatch.setattr(similar.parts, "components", counted)
    frame = spark.createDataFrame(stars + shared, "node long, low long")
    got = dict(rows(similar.grouped(frame), "node", "root"))
    assert set(got) == {n for n, _ in stars + shared} and {got[n] for n, _ in shared} == {1000}
    assert all((got[a] == got[b]) == (root[a] == root[b]) for a, _ in stars for b, _ in stars)
    assert edges[0] < 300 + 24
    # Near copies: each brings a row for each of its keys, not each of these rows an edge.
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    data = [(k, " ".join(changed(rng, base, rng.randint(1, 3)))) for k in range(600)]
    edges.clear()
    assert rows(simhash.keep_first(documents(spark, data)), "doc_id") == [(0,)]
    assert sum(edges) < 3 * len(data)
