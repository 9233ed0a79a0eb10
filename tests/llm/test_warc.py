"""Archives: round trip, layout, and what is refused."""

import hashlib
import io
import struct

import pytest
import zstandard
from helpers import SF, rows

from rowsieve.llm import warc

PAGES = [
    (1, "http://a/", "x" * 200),
    (2, "http://b/", "x" * 200),
    (2, "http://b2/", "x" * 200),
    (0, None, "y" * 99),
    (5, "http://c/\r\nX-Bad: 1", "y" * 99),
    (6, "u", None),
    (7, "u", ""),
    (8, "u", "é\r\n\r\nWARC/1.1\r\n\r\n" * 20),
    (None, "u", "x" * 200),
    (None, "u", "lone" * 100),
    (9, "u", "long " * 400_000),
    (10, "u", "é" * 50),
    (3, "u", "é" * 50),
]


def plain(pages):
    first = {}
    for i, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        refers = first.get(data)
        refers = None if refers == i else refers
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def table(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return df.selectExpr("*", "'q' as digest", "'z' as payload", "1 as bytes", "2 as first")


def test_round_trip(spark):
    assert rows(warc.archive_round_trip(table(spark, PAGES))) == plain(PAGES)
    assert warc.archive_round_trip(table(spark, [])).count() == 0


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    both = pages.unionByName(pages.selectExpr("page_id + 100000 as page_id", "url", "html"))
    want = plain([tuple(r) for r in both.select("page_id", "url", "html").collect()])
    assert rows(warc.archive_round_trip(both)) == want
    assert sum(r[3] == "revisit" for r in want) >= 50


def test_archives(spark, tmp_path):
    """Several archives, with a dictionary first and then one frame per record."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").coalesce(1)
    folder = str(tmp_path)
    archives = warc.write_archives(warc.with_revisits(pages), folder, archive_bytes=30_000, sample_bytes=300_000)
    found = archives.collect()
    assert len(found) > 1 and sum(r.records for r in found) == pages.count()
    assert sorted(p.name for p in tmp_path.glob("*.zst")) == sorted(r.path for r in found)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(archives, folder).collect() if r.payload is not None}
    assert got == {r.page_id: r.html for r in pages.collect()}
    data = (tmp_path / found[0].path).read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8:12] == b"\x37\xa4\x30\xec"
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    rest, frames = data[8 + size :], 0
    while rest:
        frame = decoder.decompressobj()
        record = frame.decompress(rest)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        rest, frames = frame.unused_data, frames + 1
    assert frames == found[0].records


def page(**other):
    data = b"<p>text</p>" * 20
    return {
        "row": 1, "page_id": 1, "url": "u", "payload": data, "bytes": len(data),
        "digest": hashlib.sha256(data).hexdigest(), "refers_to": None,
    } | other


def test_records():
    assert warc.parse_page(warc.record(page()))[5:] == ("response", None)
    found = warc.parse_page(warc.record(page(refers_to=0)))
    assert found[2] is None and found[3] == 220 and found[5:] == ("revisit", 0)
    assert warc.parse_page(warc.record(page(url="a\r\nb: c")))[1] == "a%0D%0Ab: c"


@pytest.mark.parametrize(
    "change",
    [
        lambda x: x[:-1],
        lambda x: x + b"x",
        lambda x: x.replace(b"<p>", b"<q>", 1),
        lambda x: x.replace(b"WARC/1.1", b"WARC/9.9"),
        lambda x: x.replace(b"WARC-Date", b"WARC-Hour"),
        lambda x: x.replace(b"response\r\nWARC-Record", b"metadata\r\nWARC-Record"),
        lambda x: x.replace(b"WARC-Type:", b"WARC-Type "),
        lambda x: x.replace(b"sha256:", b"sha256:0"),
        lambda x: b"",
    ],
)
def test_bad_records(change):
    with pytest.raises(warc.BadArchive):
        warc.parse_page(change(warc.record(page())))


def archive(dictionary=None, n=40):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, dictionary)
    for k in range(n):
        writer.add(warc.record(page(page_id=k)))
    assert writer.size == len(out.getvalue())
    return out.getvalue()


def test_frames_across_reads(monkeypatch):
    samples = [warc.record(page(page_id=k, url=f"http://host{k}/path{k * 7}")) for k in range(500)]
    dictionary = warc.train_dictionary(samples)
    assert warc.train_dictionary(samples[:3]) is None
    for size in (7, 100, 1 << 20):
        monkeypatch.setattr(warc, "READ_BYTES", size)
        for held in (None, dictionary):
            frames = list(warc.read_frames(io.BytesIO(archive(held))))
            assert [warc.parse_page(f)[0] for f in frames] == list(range(40))
    assert list(warc.read_frames(io.BytesIO(b""))) == []


def test_compressed_dictionary():
    samples = [warc.record(page(page_id=k, url=f"http://host{k}/path{k * 7}")) for k in range(500)]
    dictionary = warc.train_dictionary(samples)
    whole = archive(dictionary)
    packed = zstandard.ZstdCompressor().compress(dictionary)
    again = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + whole[8 + len(dictionary) :]
    assert len(list(warc.read_frames(io.BytesIO(again)))) == 40


@pytest.mark.parametrize("cut", [3, 6, 20, -1, -10])
def test_cut_off(cut):
    samples = [warc.record(page(page_id=k, url=f"http://host{k}/path{k * 7}")) for k in range(500)]
    data = archive(warc.train_dictionary(samples))
    with pytest.raises((warc.BadArchive, zstandard.ZstdError)):
        list(warc.read_frames(io.BytesIO(data[:cut])))
    with pytest.raises(warc.BadArchive):
        list(warc.read_frames(io.BytesIO(struct.pack("<II", warc.SKIPPABLE, 4) + b"none" + data)))
