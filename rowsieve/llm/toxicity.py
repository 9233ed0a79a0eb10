"""Toxicity from a learned lexicon, spelling errors included, and the context of its terms."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.arrow import map_rows
from rowsieve.llm.lexicon import Lexicon, Term, usual_edits
from rowsieve.llm.tables import written

SAMPLE_ROWS = 10_000
STEMS = (4, 5, 6, 7)
CONTEXT_WORDS = 6

_WORD = re.compile(r"[^\W_]+")

# Signs and words of reported speech, and of speech to the reader.
QUOTES = "\"“”„«»"
REPORTED = frozenset(
    "said says wrote called word term quote quoted sagte sagt schrieb nannte wort zitat "
    "dit disait écrit appelé mot citation dijo dice escribió llamó palabra cita".split()
)
DIRECT = frozenset("you your du dich dein tu te toi vous ton tú eres usted".split())


def is_held_out() -> Column:
    """Whether the checksum of the doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    terms: list[Term]
    weights: np.ndarray


def features(text: str | None, lexicon: Lexicon) -> tuple[float, ...]:
    """What the terms of a whole text say; zeros where there are none.

    Each hit is judged in a window of words before and after it: words of reported speech
    and quotation marks on both sides speak for a quotation, words to the reader and other
    hits for abuse. Both kinds of hits are counted apart.
    """
    text = (text or "").lower()
    words = _WORD.findall(text)
    found = lexicon.find(words)
    hits = [k for k, x in enumerate(found) if x]
    if not hits:
        return (0.0,) * len(NAMES)
    spans = [m.span() for m in _WORD.finditer(text)]
    exact = stems = fuzzy = quoted = abuse = 0
    distinct: dict[int, int] = {}
    hit_set = set(hits)
    for k in hits:
        edits, term = found[k]
        distinct[term] = min(edits, distinct.get(term, 9))
        exact += edits == 0 and not lexicon.terms[term].stem
        stems += lexicon.terms[term].stem
        fuzzy += edits > 0
        low, high = max(0, k - CONTEXT_WORDS), min(len(words), k + CONTEXT_WORDS + 1)
        near = words[low:k] + words[k + 1 : high]
        marks = _quoted(text, *spans[k], spans[low][0], spans[high - 1][1])
        others = sum(j != k and j in hit_set for j in range(low, high))
        score = others + sum(w in DIRECT for w in near) - 2 * marks - sum(w in REPORTED for w in near)
        quoted += score < 0
        abuse += score > 0
    odds = [lexicon.terms[t].weight / (1 + e) for t, e in distinct.items()]
    return (
        math.log1p(exact),
        math.log1p(stems),
        math.log1p(fuzzy),
        math.log1p(quoted),
        math.log1p(abuse),
        math.log1p(len(distinct)),
        max(odds),
        min(5.0, math.log1p(100 * len(hits) / len(words))),
    )


NAMES = ("exact", "stems", "fuzzy", "quoted", "abuse", "distinct", "odds", "rate")


def _quoted(text: str, start: int, end: int, low: int, high: int) -> bool:
    return any(q in text[low:start] for q in QUOTES) and any(q in text[end:high] for q in QUOTES)


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids that are not held out, the first by hash."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
    ids = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def learn_terms(train: DataFrame) -> list[Term]:
    """Words and stems that stand mostly in toxic texts of ``train`` (doc_id, text, toxic).

    A text counts a word once. A term needs a share of the toxic texts (1 in 200, at least
    5 texts) and four toxic texts in five of those it stands in, one clean text added. A
    stem is taken if it is found in a third more toxic texts than any word that begins with
    it, so plain words stay words. A word that a taken stem covers is a term still if
    misspellings of it count, as stems have none. There are no more terms than words in the
    sample, which is bounded.
    """
    counts = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    toxic = counts.get(1, 0)
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+", -1)), lambda w: F.length(w) > 3)
    entries = F.array(
        F.struct(F.col("word").alias("text"), F.lit(False).alias("stem")),
        *(F.struct(F.substring("word", 1, n).alias("text"), F.lit(True).alias("stem")) for n in STEMS),
    )
    seen = (
        train.select("doc_id", "toxic", F.explode(words).alias("word"))
        .select("doc_id", "toxic", "word", F.explode(entries).alias("entry"))
        .select("doc_id", "toxic", "entry.*", F.length("word").alias("size"))
        .where("not stem or length(text) < size")
        .groupBy("doc_id", "toxic", "text", "stem")
        .count()
    )
    rows = (
        seen.groupBy("text", "stem")
        .agg(F.sum("toxic").alias("hits"), F.count("*").alias("texts"))
        .where((F.col("hits") >= max(5, 0.005 * toxic)) & (F.col("hits") >= 0.8 * (F.col("texts") + 1)))
        .collect()
    )
    most = {n: {} for n in STEMS}
    for r in rows:
        if not r.stem:
            for n in STEMS:
                key = r.text[:n]
                most[n][key] = max(most[n].get(key, 0), r.hits)
    stems: dict[str, float] = {}
    words_: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (not r.stem, len(r.text), r.text)):
        covered = any(r.text[:n] in stems for n in STEMS if n <= len(r.text))
        odds = math.log((r.hits + 0.5) / (r.texts - r.hits + 0.5))
        if not r.stem:
            if not covered or usual_edits(r.text, False):
                words_[r.text] = odds
        elif not covered and 3 * r.hits > 4 * most[len(r.text)].get(r.text, 0):
            stems[r.text] = odds
    terms = [Term(t, True, w) for t, w in stems.items()]
    terms += [Term(t, False, w, usual_edits(t, False)) for t, w in words_.items()]
    return _checked(train, sorted(terms, key=lambda t: (-t.weight, t.text)))


def _checked(train: DataFrame, terms: list[Term]) -> list[Term]:
    """``terms`` without edits where words an edit away stand in clean texts too."""

    def setup():
        lexicon = Lexicon(terms)

        def work(rows):
            for text, toxic in rows:
                found = lexicon.find(_WORD.findall(text.lower()))
                for term in {x[1] for x in found if x and x[0]}:
                    yield term, toxic

        return work

    near = map_rows(train.select("text", "toxic"), setup, "term int, toxic int").groupBy("term")
    counts = {r.term: (r.hits, r.texts) for r in near.agg(F.sum("toxic").alias("hits"), F.count("*").alias("texts")).collect()}
    clean = {k for k, (hits, texts) in counts.items() if hits < 0.8 * texts}
    return [replace(t, edits=0) if k in clean else t for k, t in enumerate(terms)]


def _logistic(rows: np.ndarray, labels: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the constant last) of a logistic regression by Newton steps."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    shrink = np.full(len(w), penalty)
    shrink[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - shrink * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of ``labels.toxic`` from at most ``sample_rows`` labelled texts.

    Held-out ids are never learnt from, and only texts enter. Without texts of both labels
    the model gives every text the share of toxic ones, one half if there are none at all.
    """
    ids = _sample(labels, sample_rows)
    train = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null")
    # The sample is written, so that the documents are read once for it.
    train = written(train.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxic-sample")
    terms = learn_terms(train)

    def setup():
        lexicon = Lexicon(terms)
        return lambda rows: [(i, y, features(t, lexicon)) for i, t, y in rows]

    rows = map_rows(train.select("doc_id", "text", "toxic"), setup, "doc_id long, toxic int, x array<double>").collect()
    rows.sort(key=lambda r: r.doc_id)
    if not rows:
        return Model([], np.zeros(len(NAMES) + 1))
    x, y = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)
    return Model(terms, _logistic(x, y))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Scores come from the text alone; null and empty texts get the score of a text without
    terms. A null doc_id is not held out. Repeated rows are scored each.
    """

    def setup():
        lexicon = Lexicon(model.terms)

        def work(rows):
            x = np.array([features(t, lexicon) for _, t in rows])
            scores = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
            return [(i, float(s), int(s >= 0.5)) for (i, _), s in zip(rows, scores, strict=True)]

        return work

    scored = map_rows(docs.select("doc_id", "text"), setup, "doc_id long, score double, predicted int")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
