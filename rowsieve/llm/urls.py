"""Verdicts on URLs from sorted digest arrays of rules and of a block list."""

from __future__ import annotations

import string
import struct
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.session import hadoop_path, scratch_path

SEED = 42
#: Bytes of entries in one index file. More entries make more files, each probed in turn.
INDEX_BYTES = 64 << 20

ALLOW, BLOCK = 0, 1
_MAGIC = b"urlidx1\0"


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, ?, # or the end, A-Z lower-cased."""
    return F.coalesce(_lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def _lowered(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_index(entries: list[tuple[str, int]]) -> bytes:
    """An index of (entry, verdict): sorted keys, then where each entry's text begins.

    Layout: magic, number of entries, then arrays of 64-bit keys, 64-bit ends of texts and
    8-bit verdicts, then the texts. Equal keys of unlike entries stand side by side. Of an
    entry given twice the block verdict holds.
    """
    held: dict[str, int] = {}
    for entry, verdict in entries:
        held[entry] = max(verdict, held.get(entry, ALLOW))
    rows = sorted((xxhash.xxh64_intdigest(e.encode(), SEED), e.encode(), v) for e, v in held.items())
    keys = np.array([r[0] for r in rows], "<u8")
    ends = np.cumsum([len(r[1]) for r in rows], dtype="<u8") if rows else np.empty(0, "<u8")
    verdicts = np.array([r[2] for r in rows], "u1")
    return b"".join((_MAGIC, struct.pack("<Q", len(rows)), keys.tobytes(), ends.tobytes(), verdicts.tobytes(), *(r[1] for r in rows)))


@dataclass
class Index:
    """A memory-mapped index: pages are read as they are probed and shared by all workers."""

    keys: np.ndarray
    ends: np.ndarray
    verdicts: np.ndarray
    texts: np.ndarray

    @classmethod
    def mapped(cls, path: str) -> Index:
        data = np.memmap(path, np.uint8, "r")
        if bytes(data[:8]) != _MAGIC:
            raise ValueError(f"{path} is no URL index")
        n = int(data[8:16].view("<u8")[0])
        ends = 16 + 16 * n
        return cls(data[16 : 16 + 8 * n].view("<u8"), data[16 + 8 * n : ends].view("<u8"), data[ends : ends + n], data[ends + n :])

    def probe(self, wanted: list[bytes]) -> np.ndarray:
        """Place of each wanted entry, or -1: binary search of all keys at once, then the
        stored text decides, through every entry that shares the key."""
        keys = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in wanted), np.uint64, len(wanted))
        low = np.searchsorted(self.keys, keys, "left")
        high = np.searchsorted(self.keys, keys, "right")
        found = np.full(len(wanted), -1)
        for k in np.flatnonzero(high > low):
            for at in range(low[k], high[k]):
                begin = int(self.ends[at - 1]) if at else 0
                if self.texts[begin : int(self.ends[at])].tobytes() == wanted[k]:
                    found[k] = at
                    break
        return found


@lru_cache(maxsize=16)
def _opened(name: str) -> Index:
    return Index.mapped(SparkFiles.get(name))


def candidates(host: str, path: str, labels: int, lengths: list[int]) -> list[str]:
    """Entries that would fit: the host and its parents, with path prefixes.

    ``labels`` is the most dots in an entry's host and ``lengths`` the lengths of entries'
    paths; nothing else can fit, so long hosts and paths stay cheap.
    """
    if not host:
        return []
    hosts, end = [host], len(host)
    parts = host.rsplit(".", labels + 1)
    at = end
    for part in reversed(parts):
        at -= len(part)
        if 0 < at:
            hosts.append(host[at:])
        at -= 1
    return [h + path[:n] for h in dict.fromkeys(hosts) if h for n in lengths if n <= len(path)]


@dataclass(frozen=True)
class UrlList:
    """Index files on the executors, with what bounds the candidates."""

    names: tuple[str, ...]
    labels: int
    lengths: tuple[int, ...]


def publish(spark, entries: DataFrame, index_bytes: int = INDEX_BYTES) -> UrlList:
    """Write ``entries`` (entry, verdict) as index files and send them to all executors.

    Files lie in the shared folder, and executors keep a copy on disk and map it.
    Entries are dealt by hash to as many files as keep each near ``index_bytes``; one file at
    a time passes the driver.
    """
    # Hosts compare in lower case, paths as they are.
    host = F.substring_index("entry", "/", 1)
    entries = entries.where("entry is not null").select(
        F.concat(_lowered(host), F.expr("substring(entry, length(substring_index(entry, '/', 1)) + 1)")).alias("entry"),
        "verdict",
    )
    facts = entries.agg(
        F.sum(F.octet_length("entry") + 17).alias("bytes"),
        F.max(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))).alias("labels"),
        F.collect_set(F.length("entry") - F.length(host)).alias("lengths"),
    ).first()
    n = max(1, -(-(facts.bytes or 0) // index_bytes))
    names = []
    folder = scratch_path(spark, "urls")
    for k in range(n):
        rows = entries.where(F.pmod(F.xxhash64("entry"), F.lit(n)) == k).collect()
        names.append(f"urls-{uuid.uuid4().hex}.idx")
        path = f"{folder}/{names[-1]}"
        store, place = hadoop_path(spark, path)
        out = store.create(place)
        out.write(build_index([(r.entry, r.verdict) for r in rows]))
        out.close()
        spark.sparkContext.addFile(path)
    return UrlList(tuple(names), facts.labels or 0, tuple(sorted(facts.lengths or [])))


def _longest(known: UrlList, hosts: pd.Series, paths: pd.Series) -> list[tuple[str, int] | None]:
    """The longest entry that fits each URL, with its verdict."""
    best: list[tuple[str, int] | None] = [None] * len(hosts)
    owner, wanted = [], []
    for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        fits = candidates(host, path, known.labels, list(known.lengths))
        owner += [k] * len(fits)
        wanted += fits
    raw = [w.encode() for w in wanted]
    for name in known.names:
        index = _opened(name)
        places = index.probe(raw)
        for at in np.flatnonzero(places >= 0):
            now, entry = best[owner[at]], wanted[at]
            if now is None or (len(entry), entry.count(".")) > (len(now[0]), now[0].count(".")):
                best[owner[at]] = (entry, int(index.verdicts[places[at]]))
    return best


def judge_urls(pages: DataFrame, rules: UrlList, blocked: UrlList) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    The longest rule that fits a URL decides; without one, a URL is blocked if an entry of
    the block list fits it. An entry fits its host and all subdomains where the path begins
    with its path. A null URL or one without :// has empty host and path, fits nothing and
    is allowed. Repeated rows are judged each.
    """

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        ruled = _longest(rules, hosts, paths)
        listed = _longest(blocked, hosts, paths)
        return pd.DataFrame(
            {
                "rule": [r[0] if r else None for r in ruled],
                "verdict": ["block" if (r[1] if r else b is not None) else "allow" for r, b in zip(ruled, listed, strict=True)],
            }
        )

    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parsed.withColumn("judged", judge("host", "path")).select("page_id", "host", "path", "judged.rule", "judged.verdict")
