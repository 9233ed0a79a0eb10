"""Personal data: base spans against plain regular expressions, contexts, masking."""

import hashlib
import re

import pytest
from helpers import AWKWARD, SF, documents, rows

from rowsieve.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def fits(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": True,
        "ip": all(int(p) <= 255 for p in text.split(".")) if kind == "ip" else None,
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if fits(k, m[0])]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


TRICKY = [
    "a@b.c_d@e.f x@@y.z a@b@c.d a@b.c.",
    "é日 +1 (843) 555-4223 ü 999.1.2.3 1.2.3.4.5.6.7.8 001.002.0003.4 1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 é 4111111111111111 +123456789 +12",
    "9" * 20_000,
    "a" * 50_000 + "@b.c",
    ".1" * 5_000,
    "+1" + "(" * 5_000,
    "a@b.c.d@e.f 4111  1111 4111111111111111",
]


def test_base_spans(spark):
    data = [*AWKWARD, *((100 + k, t) for k, t in enumerate(TRICKY))]
    got = pii.find_pii(documents(spark, data)).collect()
    assert len(got) == len(data)
    want = sorted((hashlib.sha256(written(plain(t)).encode()).hexdigest(), repr(i)) for i, t in data)
    assert sorted((r.base_sha256, repr(r.doc_id)) for r in got) == want
    texts = {i: t for i, t in data if i is not None}
    for r in got:
        kinds = [k for k, _, _ in plain(texts.get(r.doc_id))]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in PLAIN]


def test_documents_and_masks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    masked = {r.doc_id: r for r in pii.mask_pii(docs).collect()}
    assert sum(bool(r.spans) for r in spans.values()) > 10
    for doc_id, text in texts.items():
        base = plain(text)
        assert spans[doc_id].base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        found = [s.split(":") for s in spans[doc_id].spans.split(",") if s]
        out, at = "", 0
        for kind, start, end in sorted(((k, int(a), int(b)) for k, a, b in found), key=lambda s: (s[1], s[2])):
            out += text[at : max(at, start)] + (f"<{kind.upper()}>" if start >= at else "")
            at = max(at, end)
        assert masked[doc_id].text == out + text[at:]
        assert masked[doc_id].n_chars == (len(masked[doc_id].text) if found else len(text))
    assert pii.mask_pii(docs).schema == docs.schema


def test_contexts_give_unseen_identifiers(spark):
    """A number after a word that stands before known numbers is found; others are not."""
    known = [(k, f"zz{k} yy please ring +1 (843) 555-{4223 + k} at w{k} and v{k} go on") for k in range(8)]
    unseen = [(50, "so then please ring 843-555-9999 now"), (51, "the order 843-555-7777 came today")]
    short = [(52, "please ring 12 now")]
    got = {r.doc_id: r.spans for r in pii.find_pii(documents(spark, known + unseen + short)).collect()}
    assert got[50] == "phone:20:32"
    assert got[51] == got[52] == ""
    assert all(got[k].startswith("phone:") for k in range(8))


def test_unseen_identifiers_of_several_words(spark):
    """Whole numbers written with spaces, not their last word; addresses with (at)."""
    known = [(k, f"zz{k} yy please ring +1 (843) 555-{4223 + k} at w{k} and v{k} go on") for k in range(8)]
    known += [(20 + k, f"q{k} r{k} kindly write u{k}@mail.example.com s{k} t{k}") for k in range(8)]
    numbers = ["(743) 555-3824", "743 555 3824", "1 743 555 3824", "(743)555-3824", "743-555-3824", "5553824"]
    addresses = ["jane(at)mail.example.com", "jane[at]mail.example.com", "jane (at) mail.example.com"]
    data, want = [], {}
    for word, kind, given in (("ring", "phone", numbers), ("write", "email", addresses)):
        lead = "so then please ring " if word == "ring" else "now then kindly write "
        for text in given:
            i = 100 + len(data)
            data.append((i, f"{lead}{text}, thanks"))
            want[i] = f"{kind}:{len(lead)}:{len(lead) + len(text)}"
    data += [(200, "so then please ring 743 555 3824 2025 now"), (201, "so then please ring 12 34 now")]
    got = {r.doc_id: r.spans for r in pii.find_pii(documents(spark, known + data)).collect()}
    assert {i: got[i] for i in want} == want
    assert got[200] == "phone:20:32" and got[201] == ""


def test_many_unseen_identifiers(spark):
    """Twice as many unseen as known ones beside a word: rounds go on until scores settle."""
    known = [(k, f"zz{k} yy please ring +1 (843) 555-{4000 + k} at w{k} and v{k} go on") for k in range(50)]
    unseen = [(1000 + k, f"a{k} b{k} please ring 843-555-{5000 + k} c{k} d{k} e{k}") for k in range(100)]
    got = {r.doc_id: r.spans for r in pii.find_pii(documents(spark, known + unseen)).collect()}
    assert sum(got[i] != "" for i, _ in unseen) == 100


def test_common_words_are_no_evidence(spark):
    """A word that is as frequent further away from identifiers tells nothing."""
    known = [(k, f"the cat the dog the sun the sky the +1 (843) 555-{4223 + k} the x{k} the y{k}") for k in range(8)]
    got = {r.doc_id: r.spans for r in pii.find_pii(documents(spark, [*known, (50, "saw the 843-555-9999 there")])).collect()}
    assert got[50] == ""


def test_copies_are_one_piece_of_evidence(spark):
    known = [(k, "please ring +1 (843) 555-4223 now") for k in range(20)]
    got = {r.doc_id: r.spans for r in pii.find_pii(documents(spark, [*known, (50, "please ring 843-555-9999 now")])).collect()}
    assert got[50] == ""


def test_awkward_rows(spark):
    docs = documents(spark)
    masked = pii.mask_pii(docs)
    assert masked.schema == docs.schema
    want = [(i, "<CARD>".join(t.split("1234567890123456")) if t and luhn("1234567890123456") else t) for i, t in AWKWARD]
    assert rows(masked, "doc_id", "text") == sorted(want, key=repr)
    assert pii.find_pii(documents(spark, [])).count() == 0
    assert pii.mask_pii(documents(spark, [])).count() == 0


def test_native_plan(spark):
    plan = pii.find_pii(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("digits", ["4111111111111111", "4111111111111112", "0" * 13, "5500005555555559"])
def test_luhn(spark, digits):
    got = pii.find_pii(documents(spark, [(1, digits)])).first()
    assert got.n_card == int(luhn(digits))
