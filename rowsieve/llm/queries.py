"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowsieve.llm.decontaminate import contaminated
from rowsieve.llm.lengths import length_histogram, length_report
from rowsieve.llm.mtree import nearest_vectors
from rowsieve.llm.packing import pack
from rowsieve.llm.pii import find_pii
from rowsieve.llm.prefixes import prefix_trie
from rowsieve.llm.quality import fit_quality, judge_quality
from rowsieve.llm.sharding import shards
from rowsieve.llm.simhash import CLOSE, near_duplicates
from rowsieve.llm.tables import table
from rowsieve.llm.toxicity import fit_toxicity, score_toxicity
from rowsieve.llm.urls import ALLOW, BLOCK, judge_urls, publish
from rowsieve.llm.warc import archive_round_trip
from rowsieve.llm.whitening import whiten

# Rules on URLs, and hosts on the block list, as given.
RULES = [
    ("org/", ALLOW),
    ("example.org/es/", BLOCK),
    ("example.org/en/1", BLOCK),
    ("com/fr/", ALLOW),
    ("com/de/", BLOCK),
]
BLOCKED_HOSTS = ["casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com"]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 8 shards of nearly equal bytes."""
    return shards(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    schema = "entry string, verdict int"
    rules = publish(spark, spark.createDataFrame(RULES, schema))
    blocked = publish(spark, spark.createDataFrame([(h, BLOCK) for h in BLOCKED_HOSTS], schema))
    return judge_urls(table(spark, sf_dir, "pages"), rules, blocked)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), CLOSE)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in a sequence of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written to archives and read back."""
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return find_pii(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half or more of a benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    found = judge_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return found.drop("score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact histogram of encoded lengths with its suffix sums."""
    return length_report(length_histogram(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten highest inner products of every hundredth vector, among all others."""
    return nearest_vectors(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the eight whitened components of largest variance."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_url_filters": op2_url_filters,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_top_k": op12_top_k,
    "op13_whitening": op13_whitening,
}

_RULE_ROWS = ", ".join(
    "('{}', '{}', '{}', '{}')".format(*entry.partition("/")[::2], entry, "block" if verdict else "allow")
    for entry, verdict in RULES
)
_HOST_ROWS = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)

#: Queries whose rows SQL can tell.
ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": f"""
        WITH rules(h, p, rule, verdict) AS (
            SELECT h, '/' || p, rule, verdict FROM (VALUES {_RULE_ROWS}) AS r(h, p, rule, verdict)
        ),
        blocked(b) AS (VALUES {_HOST_ROWS}),
        parsed AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        )
        SELECT page_id, host, path,
               (SELECT max_by(rule, length(rule)) FROM rules
                WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
               coalesce(
                   (SELECT max_by(verdict, length(rule)) FROM rules
                    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
                   CASE WHEN EXISTS (SELECT 1 FROM blocked WHERE host = b OR ends_with(host, '.' || b))
                        THEN 'block' ELSE 'allow' END) AS verdict
        FROM parsed
    """,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ),
        q AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM q
    """,
    "op11_prefix_trie": """
        WITH digits AS (
            -- h: CRC-32 of the decimal conv_id, bit by bit, modulo 6
            SELECT conv_id,
                   xor(list_reduce(
                       list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
                       lambda crc, d: list_reduce(
                           list_prepend(xor(crc, d), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                           lambda c, z: xor(c >> 1, (c & 1) * 3988292384) + z),
                       4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
        ),
        original AS (
            SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                                 ORDER BY turn NULLS FIRST, role, text) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ),
        rebuilt AS (
            SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:d.h], o.turns[d.h + 1:]) AS turns
            FROM original o JOIN digits d USING (conv_id)
            LEFT JOIN original b ON b.conv_id = o.conv_id - o.conv_id % 100
        ),
        prefix AS (
            SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt
        ),
        nodes AS (
            SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth) AS ends,
                   count(*) FILTER (len(turns) > depth) = 0 AS leaf
            FROM prefix GROUP BY ALL
        ),
        -- every node beside each node above it, itself included
        above AS (
            SELECT path, unnest(range(depth + 1)) AS up, leaf,
                   CASE WHEN depth > 0 THEN (n_convs - 1) * length(path[depth].text) ELSE 0 END AS saved
            FROM nodes
        ),
        sums AS (
            SELECT path[1:up] AS path, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens,
                   count(*) FILTER (len(path) = up + 1) AS n_children
            FROM above GROUP BY path[1:up]
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens,
               sha256(coalesce(n.ends, '')) AS ends_sha256
        FROM nodes n JOIN sums s ON s.path = n.path
        LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1] AND p.depth = n.depth - 1
    """,
    "op12_top_k": """
        WITH whole AS (
            SELECT row_number() OVER () AS row, vec_id,
                   list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS vec
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.row, q.vec_id AS query_id, c.vec_id, c.row AS other,
                   list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM whole q JOIN whole c ON q.row <> c.row WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST, other))::INTEGER AS rank,
               vec_id, score
        FROM scored QUALIFY rank <= 10
    """,
}
