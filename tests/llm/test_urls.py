"""URL verdicts against plain string comparison, and the index itself."""

import numpy as np
import pytest
from helpers import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from rowsieve.llm import urls
from rowsieve.llm.queries import BLOCKED_HOSTS, RULES, op2_url_filters


def plain(url, rules=RULES, blocked=BLOCKED_HOSTS):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]

    def fits(entry):
        h, slash, p = entry.partition("/")
        return (host == h or host.endswith("." + h)) and path.startswith(slash + p)

    best = max((r for r in rules if fits(r[0])), key=lambda r: len(r[0]), default=None)
    if best:
        return host, path, best[0], "block" if best[1] else "allow"
    return host, path, None, "block" if any(map(fits, blocked)) else "allow"


ODD = [
    None,
    "",
    "no scheme/org/",
    "http://",
    "http://org",
    "http://org/",
    "http://ORG/x",
    "HTTP://A.Example.ORG/es/1#top",
    "http://example.org/ES/1",
    "http://xexample.org/en/1",
    "http://example.org/en/12?x=1",
    "http://a.b.com/fr/?/de/",
    "http://a.b.com/de/x://y.org/",
    "http://com/de/",
    "http://com./de/",
    "http://.com/de/",
    "http://free-bets.example.com",
    "http://a.free-bets.example.com?x",
    "http://FREE-BETS.example.com:80/",
    "http://notfree-bets.example.com/",
    "x\ny://a\nb.org/\n/z?q",
    "http://ÀÉ.org/é",
    "http://" + "a." * 5000 + "org/" + "d/" * 5000,
]


def test_odd_urls(spark, tmp_path):
    table = spark.createDataFrame(list(enumerate(ODD)) + [(None, "http://org/"), (3, "http://")], "page_id long, url string")
    path = tmp_path / "sf"
    table.selectExpr("*", "'x' as host", "'y' as rule").repartition(1).write.parquet(f"{path}/pages.parquet")
    got = op2_url_filters(spark, str(path)).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        url = ODD[r.page_id] if r.page_id is not None else "http://org/"
        assert (r.host, r.path, r.rule, r.verdict) == plain(url), url


def test_pages(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op2_url_filters(spark, SF).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain(u) for i, u in pages.items()}


def test_many_entries_in_several_files(spark):
    entries = [(f"h{k}.example.com/{'p' * (k % 4)}", urls.BLOCK) for k in range(3000)]
    blocked = urls.publish(spark, spark.createDataFrame(entries, "entry string, verdict int"), index_bytes=20_000)
    none = urls.publish(spark, spark.createDataFrame([], "entry string, verdict int"))
    assert len(blocked.names) > 3 and len(none.names) == 1
    hosts = [f"http://{sub}h{k}.EXAMPLE.com/{path}" for k in range(0, 4000, 7) for sub in ("", "a.b.") for path in ("", "p", "ppp/x")]
    pages = spark.createDataFrame(list(enumerate(hosts)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages, none, blocked).collect()}
    plain_entries = [e for e, _ in entries]
    by_host = {e.partition("/")[0]: e for e in plain_entries}
    for k, url in enumerate(hosts):
        host, path = urls_parts(url)
        entry = by_host.get(host.removeprefix("a.b."))
        want = entry is not None and path.startswith("/" + entry.partition("/")[2])
        assert got[k] == ("block" if want else "allow"), url


def urls_parts(url):
    rest = url.split("://")[1]
    host, _, path = rest.partition("/")
    return host.lower(), "/" + path


def test_stored_text_decides_on_equal_keys(tmp_path, monkeypatch):
    """With one key for all entries only the texts tell them apart."""
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda data, seed: 7)
    path = tmp_path / "index"
    path.write_bytes(urls.build_index([("a/", 1), ("b/", 0), ("c/", 1), ("b/", 1)]))
    index = urls.Index.mapped(str(path))
    places = index.probe([b"b/", b"x/", b"c/"])
    assert places[1] == -1 and places[0] != places[2]
    assert index.verdicts[places[0]] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab./", max_size=6), max_size=20), st.lists(st.text("ab./", max_size=6), max_size=20))
def test_probe(tmp_path_factory, entries, wanted):
    path = tmp_path_factory.mktemp("index") / "i"
    path.write_bytes(urls.build_index([(e, 1) for e in entries]))
    places = urls.Index.mapped(str(path)).probe([w.encode() for w in wanted])
    assert [p >= 0 for p in places] == [w in entries for w in wanted]


@pytest.mark.parametrize("host", ["", "com", "a.com", ".com", "com.", "a.b.c.d"])
def test_candidates(host):
    found = set(urls.candidates(host, "/xy", 1, [0, 2, 9]))
    parts = host.split(".")
    tails = {".".join(parts[k:]) for k in range(len(parts))} - {""}
    want = {t + "/xy"[:n] for t in tails if t.count(".") <= 1 for n in (0, 2)}
    assert want <= found
    assert all(host == f.partition("/")[0] or host.endswith("." + f.partition("/")[0]) for f in found)
    assert np.all([f.count("/") <= 1 for f in found])
