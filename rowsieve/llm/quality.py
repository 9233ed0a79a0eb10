"""Quality rules: a base rule over counts, then boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.arrow import map_rows, row_test
from rowsieve.llm.boosting import Forest, fit
from rowsieve.llm.quality_stats import FEATURES, statistics

SAMPLE_ROWS = 20_000
MIN_KEPT = 0.5

_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_FEATURES = "features array<double>"


def _base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """Trees for ``labels.quality``, fitted on at most ``sample_rows`` labelled documents.

    The sample takes the labelled ids that come first by hash. Only it is fitted on; every
    other figure covers all rows. A document given twice counts once. None: no labelled
    documents, or only one label.
    """
    ids = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )

    def setup():
        return lambda rows: [(i, q, statistics(t)[5]) for i, t, q in rows]

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = (
        map_rows(chosen, setup, f"doc_id long, quality int, {_FEATURES}")
        .groupBy("doc_id")
        .agg(F.min(F.struct("quality", "features")).alias("row"))
        .select("doc_id", "row.*")
        .collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.quality for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([r.features for r in rows]), y, list(FEATURES.values()))


def judge_quality(docs: DataFrame, model: Forest | None, min_kept: float = MIN_KEPT) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``score`` and ``kept``.

    ``docs`` needs ``doc_id`` and ``text``; other columns play no part, whatever their
    names. A null text counts as empty: no words, so it fails the base rule. Repeated
    rows are judged each. Without a model a document is kept if it passes the base rule.
    """

    def setup():
        def work(rows):
            found = [statistics(text) for _, text in rows]
            scores = model.score(np.array([x[5] for x in found])) if model else np.ones(len(found))
            for (doc_id, _), x, score in zip(rows, found, scores, strict=True):
                failed = _base_failed(x[0], x[4])
                yield doc_id, *x[:5], failed, float(score), bool(not failed and score >= min_kept)

        return work

    schema = f"doc_id long, {_COUNTS}, base_failed boolean, score double, kept boolean"
    return map_rows(docs.select("doc_id", "text"), setup, schema)


def keep_quality(docs: DataFrame, model: Forest | None, min_kept: float = MIN_KEPT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are.

    Null and empty texts have no words and fail the base rule. Repeated rows stay or go
    together, an empty table gives none, and without a model the base rule decides alone.
    """

    def work(texts: list) -> list[bool]:
        found = [statistics(text) for text in texts]
        failed = np.array([_base_failed(x[0], x[4]) for x in found], bool)
        if model:
            failed |= model.score(np.array([x[5] for x in found])) < min_kept
        return list(~failed)

    return docs.where(row_test(lambda: work)(docs["text"]))
