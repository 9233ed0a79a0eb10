"""SimHash: fingerprints, trie join and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from helpers import SF, documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from rowsieve.llm import simhash
from rowsieve.llm.components import components


def plain_fingerprint(text, width=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return "0" * 16
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), 42) for k in range(max(1, len(words) - width + 1))]
    bits = [2 * sum(h >> (63 - b) & 1 for h in hashes) > len(hashes) for b in range(64)]
    return f"{int(''.join('01'[b] for b in bits), 2):016x}"


def plain_components(prints, near):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i], prints[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(prints))]


def apart(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


@pytest.mark.parametrize("text", [None, "", "A", "a b", "A b C", "É à b c d", "x y z " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_shingles_once():
    """A word said over and over does not make two texts alike."""
    texts = [" ".join([*(f"{c}{k}" for k in range(60)), *["be"] * 500]) for c in "ab"]
    same, apart_ = (
        bin(int(simhash.fingerprint(texts[0], 5, 4, once), 16) ^ int(simhash.fingerprint(texts[1], 5, 4, once), 16)).count("1")
        for once in (False, True)
    )
    assert same < 20 and apart_ > 90
    assert simhash.fingerprint("", 5, 4, True) == "0" * 64


def test_fingerprint_of_blocks(monkeypatch):
    monkeypatch.setattr("rowsieve.llm.words.BLOCK", 7)
    text = "some words that cross a block boundary again and again " * 3
    from rowsieve.llm import words

    cut = [h for part in words.shingle_hashes(text, 3) for h in part.tolist()]
    w = text.encode().split()
    assert cut == [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(len(w) - 2)]
    assert b"".join(words.blocks(text.encode(), 7)) == text.encode()
    assert len(list(words.blocks(text.encode(), 7))) > 10


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=40), st.integers(0, 4))
def test_trie_pairs_miss_nothing(keys, budget):
    # A few keys are moved near others, so that there are links to find.
    keys += [keys[0] ^ (1 << b) for b in (0, 31, 63)] + [keys[1] ^ 0b111]
    held = np.sort(np.array(sorted(set(keys)), np.uint64))
    found = set()
    for i, j in simhash.trie_pairs(held, [(0, len(held), 0, len(held))], 64, budget):
        found |= {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {
        (i, j)
        for j in range(len(held))
        for i in range(j)
        if int(held[i] ^ held[j]).bit_count() <= budget
    }
    assert want <= found


@pytest.mark.parametrize("task_rows", [4096, 8, 2])
def test_links_join_all_near_prints(spark, task_rows):
    """Also when every node is too large and goes down the trie in Spark."""
    rng = random.Random(task_rows)
    prints = set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        prints |= {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(12)}
    prints = sorted(f"{p:016x}" for p in prints)
    linking = simhash.Linking(task_rows=task_rows)
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    links = [(r.src, r.dst) for r in simhash.links(frame, linking).collect()]
    at = {p: k for k, p in enumerate(prints)}
    linked = {tuple(sorted((at[a], at[b]))) for a, b in links}
    want = plain_components(prints, lambda a, b: apart(a, b) <= 3)
    got = plain_components(prints, lambda a, b: tuple(sorted((at[a], at[b]))) in linked)
    assert got == want


def test_near_duplicates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    data = [tuple(r) for r in docs.collect()]
    prints = [plain_fingerprint(t) for _, t in data]
    root = plain_components(prints, lambda a, b: apart(a, b) <= 3)
    least = {}
    for (doc_id, _), r in zip(data, root, strict=True):
        least[r] = min(doc_id, least.get(r, doc_id))
    want = sorted((d[0], p, least[r]) for d, p, r in zip(data, prints, root, strict=True))
    assert rows(simhash.near_duplicates(docs)) == sorted(want, key=repr)


def test_awkward_rows(spark):
    got = rows(simhash.near_duplicates(documents(spark)))
    assert len(got) == 15
    zero = [r for r in got if r[1] == "0" * 16]
    assert {r[0] for r in zero} == {0, 1, 2, None} and {r[2] for r in zero} == {0}
    assert [r[2] for r in got if r[0] == 3] == [3, 3]
    lone = documents(spark, [(None, "a b c d"), (None, "a b c d")])
    assert [r[2] for r in rows(simhash.near_duplicates(lone))] == [None, None]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_first(docs).count() == 0


def test_keep_first(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(300)]
    near = words.copy()
    near[150] = "other"
    far = [f"v{rng.randrange(400)}" for _ in range(300)]
    data = [
        (9, " ".join(words)),
        (4, " ".join(near)),
        (4, " ".join(near)),
        (7, " ".join(words)),
        (8, " ".join(far)),
        (None, " ".join(far)),
        (1, None),
        (2, ""),
    ]
    docs = documents(spark, data)
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema
    assert rows(kept, "doc_id", "text") == sorted([(4, " ".join(near)), (8, " ".join(far)), (1, None)], key=repr)


def test_keep_first_finds_similar_texts(spark):
    """Of pairs whose 5-word shingles have a Jaccard similarity of 0.85, nine in ten go."""
    rng = random.Random(6)
    data = []
    for k in range(60):
        words = [f"w{rng.randrange(2000)}" for _ in range(400)]
        data.append((2 * k, " ".join(words)))
        for at in range(20, 400, 70):
            words[at] = "changed"
        data.append((2 * k + 1, " ".join(words)))
    kept = {r[0] for r in rows(simhash.keep_first(documents(spark, data)), "doc_id")}
    assert {i for i in range(0, 120, 2)} <= kept
    assert len(kept) <= 66


def test_components_of_long_paths(spark):
    edges = [(f"{k:03d}", f"{k + 1:03d}") for k in range(100)] + [("b", "a"), ("c", "b"), ("x", "x")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {f"{k:03d}": "000" for k in range(101)} | {"a": "a", "b": "a", "c": "a"}
