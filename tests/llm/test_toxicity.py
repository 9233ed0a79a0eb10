"""Toxicity: the automata against edit distances, held-out accuracy, context."""

import random
import zlib

import numpy as np
import pytest
from helpers import documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from rowsieve.llm import lexicon, toxicity
from rowsieve.llm.lexicon import Lexicon, Term, usual_edits

WORDS = "idiot loser worthless scum moron pathetic abc".split()
TERMS = [Term(w, False, 1.0, usual_edits(w, False)) for w in WORDS] + [Term("vequ", True, 1.0), Term("lostra", True, 1.0)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def nearest(word):
    found = []
    for k, t in enumerate(TERMS):
        edits = (0 if word.startswith(t.text) else 99) if t.stem else distance(word, t.text)
        if edits <= t.edits:
            found.append((edits, k))
    return min(found, default=None)


@settings(max_examples=300, deadline=None)
@given(
    st.sampled_from([t.text for t in TERMS]),
    st.lists(st.tuples(st.integers(0, 11), st.sampled_from("+-="), st.sampled_from("abeiosté0")), max_size=3),
    st.sampled_from(["", "x", "s"]),
)
def test_automaton(text, edits, end):
    word = list(text)
    for at, kind, letter in edits:
        at = min(at, len(word))
        word[at : at + (kind != "+")] = [] if kind == "-" else [letter]
    word = "".join(word) + end
    got = Lexicon(TERMS).find([word, word])
    want = nearest(word)
    assert [g and g[0] for g in got] == [want and want[0]] * 2


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(lexicon, "KEPT_WORDS", 20)
    found = Lexicon(TERMS)
    for k in range(50):
        assert found.find([f"word{k}", "idoit", "looser"])[1:] == [nearest("idoit"), nearest("looser")]
    assert len(found._words) < 40


def test_no_terms():
    assert Lexicon([]).find(["a", ""]) == [None, None]
    assert toxicity.features("any text", Lexicon([])) == (0.0,) * len(toxicity.NAMES)


def test_context_tells_quotation_from_abuse():
    found = Lexicon(TERMS)
    at = {name: k for k, name in enumerate(toxicity.NAMES)}
    quoted = toxicity.features('The witness said the word "idiot" was on the wall.', found)
    abuse = toxicity.features("you are an idiot and a loser, you moron", found)
    assert quoted[at["quoted"]] > 0 and quoted[at["abuse"]] == 0
    assert abuse[at["abuse"]] > 0 and abuse[at["quoted"]] == 0
    assert toxicity.features("an idiott", found)[at["fuzzy"]] > 0
    assert toxicity.features("nothing here", found) == (0.0,) * len(at)


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return docs, labels, toxicity.fit_toxicity(docs, labels)


def test_held_out(trained):
    docs, labels, model = trained
    found = toxicity.score_toxicity(docs, model).join(labels, "doc_id").collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in found if r.held_out]
    assert len(held) > 700
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.98
    assert np.mean([r.predicted for r in held if r.toxic]) > 0.9
    assert np.mean([r.toxic for r in held if r.predicted]) > 0.95


def test_misspelled_terms(spark, trained):
    """Clean texts with some terms put in, each with one letter changed."""
    docs, labels, model = trained
    rng = random.Random(3)
    clean = docs.where("lang = 'en' and length(text) between 300 and 900").join(labels.where("toxic = 0 and quality = 1"), "doc_id")
    texts = [r.text for r in clean.select("text").limit(40).collect()]
    terms = ["worthless", "disgusting", "pathetic", "idiot", "loser", "stupid", "moron"]
    data = []
    for k, text in enumerate(texts):
        words = text.split(" ")
        for _ in range(5):
            term = rng.choice(terms)
            at = rng.randrange(1, len(term))
            words.insert(rng.randrange(len(words)), term[:at] + rng.choice("xqz") + term[at + 1 :])
        data += [(2 * k, text), (2 * k + 1, " ".join(words))]
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(documents(spark, data), model).collect()}
    assert np.mean([got[2 * k] for k in range(40)]) < 0.05
    assert np.mean([got[2 * k + 1] for k in range(40)]) > 0.9


def test_only_texts_and_open_labels_enter(spark):
    """Labels of held-out ids change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    one, two = toxicity.fit_toxicity(docs, labels), toxicity.fit_toxicity(docs.select("text", "doc_id"), turned)
    assert one.terms == two.terms and np.allclose(one.weights, two.weights)


def test_awkward_rows(spark):
    docs = documents(spark)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(3, 1), (3, 0), (8, 0), (None, 1), (5, None), (9, 7)], "doc_id long, toxic int")
    for labels in (empty, odd):
        model = toxicity.fit_toxicity(docs, labels)
        got = toxicity.score_toxicity(docs, model)
        assert got.count() == 15
        assert all(0 <= r.score <= 1 for r in got.collect())
        assert {r.held_out for r in got.where("doc_id is null").collect()} == {False}
    assert rows(toxicity.score_toxicity(documents(spark, []), model)) == []


def test_misspellings_of_words_that_a_stem_covers(spark):
    """A stem found beyond any one word does not hide the misspellings of its words."""
    forms = ["idiotly", "idiotic", "idiotism"]
    data = [(k, f"you {forms[k % 3]} {k}", 1) for k in range(60)] + [(k, f"fine words {k}", 0) for k in range(100, 160)]
    terms = toxicity.learn_terms(spark.createDataFrame(data, "doc_id long, text string, toxic int"))
    assert any(t.stem for t in terms) and {t.text for t in terms if not t.stem} >= set(forms)
    found = Lexicon(terms).find(["idiatic", "idiotish", "fine"])
    assert found[0][0] > 0 and found[1][0] == 0 and found[2] is None


def test_thousands_of_terms(spark):
    """No term is left out, however many there are, and each is found with an edit."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(9)) for _ in range(5000)})
    data = [(k, " ".join(words[k % 25 :: 25]), 1) for k in range(200)] + [(k, "plain text", 0) for k in range(300, 400)]
    terms = toxicity.learn_terms(spark.createDataFrame(data, "doc_id long, text string, toxic int"))
    assert {t.text for t in terms if not t.stem} == set(words)
    found = Lexicon(terms)
    some = rng.sample(words, 30)
    assert all(x and x[0] == 0 for x in found.find(some))
    assert all(x and x[0] <= 1 for x in found.find([w[:4] + "z" + w[5:] for w in some]))
