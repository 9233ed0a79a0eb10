"""WARC archives in Zstandard frames: written from pages, read back and validated.

An archive is a skippable frame that holds a dictionary, if there is one, and then one
frame per record, compressed with it. Archives lie in the shared folder.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.tables import written
from rowsieve.session import hadoop_path, scratch_path

# The first bytes of a dictionary's frame, and of a finished dictionary.
SKIPPABLE = 0x184D2A5D
DICTIONARY = b"\x37\xa4\x30\xec"

MIN_SHARED = 100
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
READ_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def _line(value: str | None) -> str:
    """``value`` in one header line: control characters and spaces at its ends escaped."""
    value = value or ""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(page: dict) -> bytes:
    """A response or revisit record of a page (page_id, url, payload, digest, bytes, refers_to).

    A revisit keeps the head of the response and names digest and length of the payload;
    the payload itself is in the record that it refers to.
    """
    payload = page["payload"] if page["refers_to"] is None else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += f"Content-Length: {page['bytes']}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if page['refers_to'] is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(page['row']))}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(page['url'])}",
        f"WARC-Payload-Digest: sha256:{page['digest']}",
        f"X-Page-ID: {'' if page['page_id'] is None else page['page_id']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
    ]
    if page["refers_to"] is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {page['refers_to']}"]
    return "\r\n".join(lines).encode() + _END + http + payload + _END


def train_dictionary(samples: list[bytes]) -> bytes | None:
    """A dictionary trained on ``samples``, or None where there is too little to learn."""
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """One archive: the dictionary first, then a frame per record."""

    def __init__(self, sink, dictionary: bytes | None) -> None:
        self._sink, self.size = sink, 0
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._compressor = zstandard.ZstdCompressor(level=3, dict_data=held, write_checksum=True)
        if dictionary:
            self._put(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self._sink.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self._compressor.compress(data))


class BadArchive(ValueError):
    pass


def read_frames(source) -> Iterator[bytes]:
    """The decoded frames of an archive, read piece by piece."""
    data, held = b"", None
    while len(data) < 8 and (more := source.read(READ_BYTES)):
        data += more
    if data[:4] == struct.pack("<I", SKIPPABLE):
        if len(data) < 8:
            raise BadArchive("dictionary frame cut off")
        size = 8 + struct.unpack("<I", data[4:8])[0]
        while len(data) < size:
            more = source.read(max(READ_BYTES, size - len(data)))
            if not more:
                raise BadArchive("dictionary frame cut off")
            data += more
        raw, data = data[8:size], data[size:]
        if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        if raw[:4] != DICTIONARY:
            raise BadArchive("no dictionary in the leading frame")
        held = zstandard.ZstdCompressionDict(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=held)
    while True:
        data = data or source.read(READ_BYTES)
        if not data:
            return
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if not data and not (data := source.read(READ_BYTES)):
                raise BadArchive("frame cut off")
            parts.append(frame.decompress(data))
            data = b""
        data = frame.unused_data
        yield b"".join(parts)


def parse_record(frame: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a frame that holds exactly one record."""
    head, found, rest = frame.partition(_END)
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive("no record in the frame")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"header line without a colon: {line[:80]}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadArchive(f"header {name} is missing")
    length = headers["content-length"]
    if not length.isdecimal() or len(rest) != int(length) + len(_END) or not rest.endswith(_END):
        raise BadArchive("length of the record differs from its header")
    return headers, rest[: int(length)]


def parse_page(frame: bytes) -> tuple:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)."""
    headers, block = parse_record(frame)
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        raise BadArchive(f"record of type {kind}")
    head, found, payload = block.partition(_END)
    length = next((x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    if not found or not length.isdigit():
        raise BadArchive("no response head in the block")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and (len(payload) != int(length) or hashlib.sha256(payload).hexdigest() != digest):
        raise BadArchive("payload differs from its length or digest")
    page, refers = headers.get("x-page-id", ""), headers.get("x-refers-to-page-id", "")
    return (
        int(page) if page else None,
        headers.get("warc-target-uri") or None,
        payload if kind == "response" else None,
        int(length),
        digest,
        kind,
        int(refers) if refers else None,
    )


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def with_revisits(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(row, page_id, url, payload, bytes, digest, refers_to) of every page.

    Of equal payloads of ``min_shared`` bytes or more the smallest page_id is kept; the
    others refer to it. Rows that share this page_id are all kept, and so are all where no
    row has an id. Only digests that occur twice are joined with the pages.
    """
    payload = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        pages["page_id"],
        pages["url"],
        F.encode(payload, "UTF-8").alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha2(payload, 256).alias("digest"),
    )
    shared = (
        rows.where(F.col("bytes") >= min_shared)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, "digest", "left").select(
        "row", "page_id", "url", "payload", "bytes", "digest", F.when(other, F.col("first")).alias("refers_to")
    )


def write_archives(
    records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """Write ``records`` (as of ``with_revisits``) as archives; (path, records) of each.

    Every task writes its own rows, a new archive after each ``archive_bytes``. A dictionary
    is trained for each on its first records, ``sample_bytes`` of them. A file gets its
    name when it is whole; names hold the attempt, so one that is run again leaves no mark:
    only the files listed here count, and the list is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        token = uuid.uuid4().hex
        waiting: list[bytes] = []
        samples: list[bytes] = []
        state = {"n": 0, "count": 0, "size": 0}
        sink = writer = None

        def opened():
            name = f"{root}/pages-{token}-{state['n']:05d}.warc.zst"
            sink = store.open_output_stream(f"{name}.part")
            return name, sink, ArchiveWriter(sink, train_dictionary(samples))

        def closed(name, sink):
            sink.close()
            store.move(f"{name}.part", name)
            done = pa.RecordBatch.from_pydict(
                {"path": pa.array([os.path.basename(name)]), "records": pa.array([state["count"]], pa.int64())}
            )
            state.update(n=state["n"] + 1, count=0)
            samples.clear()
            return done

        name = None
        for batch in batches:
            for row in batch.to_pylist():
                data = record(row)
                if writer is None:
                    waiting.append(data)
                    samples.append(data[: 1 << 16])
                    state["size"] += len(data)
                    if state["size"] < sample_bytes:
                        continue
                    name, sink, writer = opened()
                    held, waiting, state["size"] = waiting, [], 0
                else:
                    held = [data]
                for x in held:
                    writer.add(x)
                    state["count"] += 1
                if writer.size >= archive_bytes:
                    yield closed(name, sink)
                    writer = None
        if waiting:
            name, sink, writer = opened()
            for x in waiting:
                writer.add(x)
                state["count"] += 1
        if writer is not None:
            yield closed(name, sink)

    return written(records.mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of ``archives`` (path), decoded and validated.

    (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to); revisits
    have no payload. An archive that does not hold what it should fails the query.
    """
    schema = (
        "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long"
    )
    names = schema.replace(",", " ").split()[::2]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def made(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for frame in read_frames(source):
                        rows.append(parse_page(frame))
                        size += len(frame)
                        if size > READ_BYTES or len(rows) >= 1000:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    # A name is a few bytes and an archive many: each gets a task of its own.
    names_only = archives.select("path")
    return names_only.repartition(max(1, names_only.count())).mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back.

    Null html is an empty payload. Repeated rows give a record each; extra columns play no
    part.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    store, path = hadoop_path(spark, folder)
    store.mkdirs(path)
    archives = write_archives(with_revisits(pages, min_shared), folder)
    return read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
