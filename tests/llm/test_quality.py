"""Quality rules against counts made word by word, and the trees' constraints."""

import re

import numpy as np
import pytest
from helpers import AWKWARD, SF, documents, rows

from rowsieve.llm import boosting, quality
from rowsieve.llm.quality_stats import FEATURES, statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:k] for k, x in enumerate(lines)),
        len(covered),
    )


@pytest.mark.parametrize("text", [t for _, t in AWKWARD] + ["a b c a b c", "a a a a", "a b c d a b", "#a# b|c\n #a# b|c"])
def test_counts(text):
    assert statistics(text)[:5] == plain(text)


def test_query_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r for r in quality.judge_quality(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for doc_id, r in got.items():
        want = plain(texts[doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality.keep_quality(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_held_out_accuracy(spark):
    """Fitted on two thirds of the labels, the trees keep good and drop bad of the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit_quality(docs, labels.where("doc_id % 3 <> 0"))
    found = quality.judge_quality(docs, model).where("not base_failed").join(labels.where("doc_id % 3 = 0"), "doc_id")
    pairs = [(r.kept, r.quality) for r in found.select("kept", "quality").collect()]
    assert len(pairs) > 60
    assert np.mean([k == bool(q) for k, q in pairs]) > 0.95


def test_scores_are_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(12 * x[:, 1]) - x[:, 2] + 0.3 * rng.standard_normal(3000) > 0).astype(float)
    model = boosting.fit(x, y, [1, 0, -1], trees=40)
    assert np.mean((model.score(x) > 0.5) == y) > 0.8
    grid = np.linspace(0, 1, 50)
    for base in rng.random((30, 3)):
        up, down = np.tile(base, (50, 1)), np.tile(base, (50, 1))
        up[:, 0], down[:, 2] = grid, grid
        assert (np.diff(model.score(up)) >= -1e-12).all()
        assert (np.diff(model.score(down)) <= 1e-12).all()


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(3, 1), (8, 0), (None, 1), (5, None)], "doc_id long, quality int")
    for model in (None, quality.fit_quality(docs, labels)):
        got = quality.judge_quality(docs, model)
        assert got.count() == 15
        assert all(r.base_failed for r in got.where("doc_id in (0, 1, 2, 3)").collect())
        assert quality.keep_quality(docs, model).schema == docs.schema
    assert quality.fit_quality(docs, labels.limit(0)) is None
    assert quality.judge_quality(documents(spark, []), None).count() == 0
    assert len(rows(quality.keep_quality(documents(spark, []), None))) == 0
    assert len(FEATURES) == len(statistics("a")[5])
