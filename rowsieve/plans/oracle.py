"""The same results as SQL text, written independently of the operators."""

from __future__ import annotations

from rowsieve.plans.fixtures import CONTACT_COLUMNS

CONTACTS = f"contacts AS (SELECT {', '.join(CONTACT_COLUMNS)} FROM customer)"

# White space stripped from both ends, as escapes of the regular expression.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"


def trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def key(c: str) -> str:
    return f"lower({trim(f'coalesce({c}, {chr(39) * 2})')})"


def parts(c: str, delimiters: str) -> str:
    pieces = f"list_transform(string_split_regex(coalesce({c}, ''), '{delimiters}'), lambda p: {trim('p')})"
    return f"list_filter({pieces}, lambda p: p <> '')"


def explode(table: str, keep: str, c: str, delimiters: str) -> str:
    """SELECT with one row per part; fewer than two parts keep the value."""
    return f"""SELECT {keep}, generate_subscripts(vals, 1) - 1 AS part_pos, unnest(vals) AS {c}
      FROM (SELECT *, CASE WHEN len(pieces) > 1 THEN pieces ELSE [raw] END AS vals
            FROM (SELECT * EXCLUDE ({c}), {c} AS raw, {parts(c, delimiters)} AS pieces FROM {table}))"""


def reason(c: str, not_empty: bool = True, email: bool = True) -> str:
    value = trim(f"coalesce({c}, '')")
    cases = []
    if not_empty:
        cases.append(f"WHEN {value} = '' THEN '''email'' is empty'")
    if email:
        cases.append(f"WHEN {value} = '' THEN '''email'' is empty (expected email)'")
        cases.append(f"WHEN length({value}) NOT BETWEEN 5 AND 320 THEN '''email'' length out of range'")
        cases.append(f"WHEN NOT regexp_matches({value}, '{EMAIL}') THEN '''email'' is not a valid email format'")
    return f"CASE {' '.join(cases)} END"


def routed(exploded=True, checked=True, scope="", keys=("email",), exact=False) -> str:
    """WITH chain ending in ``routed``: contacts with status, reason and bucket."""
    keep = "contact_id, sheet, name, segment, score"
    rows = (
        explode("contacts", keep, "email", "[;,|\\n\\r]")
        if exploded
        else f"SELECT {keep}, 0 AS part_pos, email FROM contacts"
    )
    normal = (lambda c: trim(f"coalesce({c}, '')")) if exact else key
    named = ", ".join(f"{normal(k)} AS k{i}" for i, k in enumerate(keys))
    ks = [f"k{i}" for i in range(len(keys))]
    empty = "k0 = ''" if len(keys) == 1 else "FALSE"
    by = ", ".join(([f"lower({scope})"] if scope else []) + ks)
    bucket = scope or "'Unique'"
    return f"""WITH {CONTACTS},
      parted AS ({rows}),
      checked AS (SELECT *, {named}, {reason('email') if checked else 'NULL'} AS reason, {bucket} AS bucket FROM parted),
      ranked AS (SELECT *, {empty} AS no_key, row_number() OVER
                   (PARTITION BY reason IS NULL, {empty}, {by} ORDER BY contact_id, part_pos) AS rn FROM checked),
      routed AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'invalid'
                                WHEN no_key OR rn = 1 THEN 'unique' ELSE 'duplicate' END AS status FROM ranked)"""


def statuses(**options) -> str:
    return routed(**options) + " SELECT contact_id, CAST(part_pos AS BIGINT) AS part_pos, email, status FROM routed"


def first_by(table: str, keys, order: str, select: str, part: str = "") -> str:
    by = ", ".join([*([part] if part else []), *[key(f"CAST({k} AS VARCHAR)") for k in keys]])
    return f"""SELECT {select}, CASE WHEN {len(keys)} = 1 AND {key(f'CAST({keys[0]} AS VARCHAR)')} = '' THEN 'unique'
        WHEN row_number() OVER (PARTITION BY {by} ORDER BY {order}) = 1 THEN 'unique' ELSE 'duplicate' END AS status
      FROM {table}"""


SHEETS = routed(scope="sheet")
BUCKETS = """, firsts AS (SELECT lower(bucket) AS bkey, min(contact_id) AS first_id FROM routed GROUP BY 1),
  uniques AS (SELECT r.*, f.first_id FROM routed r JOIN firsts f ON lower(r.bucket) = f.bkey WHERE status = 'unique'),
  numbered AS (SELECT *, row_number() OVER (ORDER BY first_id, contact_id, part_pos) AS rn_all,
                      row_number() OVER (PARTITION BY bucket ORDER BY contact_id, part_pos) AS rn_in FROM uniques),
  counts AS (SELECT row_number() OVER (ORDER BY min(contact_id)) AS bucket_ord, bucket,
                    count(*) FILTER (part_pos = 0) AS rows_read,
                    count(*) FILTER (status = 'unique') AS unique_rows,
                    count(*) FILTER (status = 'duplicate') AS duplicate_rows,
                    count(*) FILTER (status = 'invalid') AS invalid_rows FROM routed GROUP BY bucket)"""
PART = "CAST(part_pos AS BIGINT) AS part_pos"
TOTALS = """CAST(count(*) FILTER (part_pos = 0) AS BIGINT) AS rows_read, count(*) FILTER (status = 'unique') AS unique_rows,
  count(*) FILTER (status = 'duplicate') AS duplicate_rows, count(*) FILTER (status = 'invalid') AS invalid_rows"""


DATA = "email,name,segment,score"


def sized(totals: str, size: int = 25) -> str:
    """Chunks of ``totals`` (bucket_ord, bucket, n)."""
    return f"""sized AS (SELECT bucket_ord, bucket, n, greatest(1, CAST(ceil(n / {size}.0) AS BIGINT)) AS chunks FROM ({totals})),
      chunked AS (SELECT *, unnest(range(1, chunks + 1)) AS chunk FROM sized)"""


def chunk_rows(size: int = 25) -> str:
    return f"CAST(least({size}, n - (chunk - 1) * {size}) AS BIGINT) AS rows"


RUN = "Processed_20240101_000000"
PER_BUCKET = sized("SELECT bucket_ord, bucket, unique_rows AS n FROM counts")
ONE_BUCKET = sized("SELECT 1 AS bucket_ord, 'Unique' AS bucket, CAST(sum(unique_rows) AS BIGINT) AS n FROM counts")
FILE_KEY = "row_number() OVER (PARTITION BY source, " + key("text") + " ORDER BY doc_id)"
WHOLE = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
HOST = "regexp_extract(url, '//([^/]+)/', 1)"
LINK = """CASE page_id % 5
  WHEN 0 THEN 'https://docs.google.com/spreadsheets/d/' || md5(url) || '/edit#gid=0'
  WHEN 1 THEN 'https://drive.google.com/open?usp=sharing&id=' || md5(url)
  WHEN 2 THEN 'https://docs.google.com/spreadsheets/d/' || left(md5(url), 19) || '/edit'
  WHEN 3 THEN 'https://drive.google.com/open?id=' || md5(url) || '&x=1' ELSE url END"""
LINK_ID = """coalesce(nullif(regexp_extract(link, '/spreadsheets/d/([A-Za-z0-9_-]{20,})', 1), ''),
  nullif(regexp_extract(link, '[?&]id=([A-Za-z0-9_-]{20,})', 1), ''))"""

ORACLE_SQL = {
    "bucket_counts": SHEETS + BUCKETS + " SELECT * FROM counts",
    "route_status": SHEETS + f" SELECT contact_id, {PART}, email, name, segment, score, bucket, status, reason FROM routed",
    "run_totals": routed() + f" SELECT {TOTALS} FROM routed",
    "invalid_reason_counts": SHEETS
    + " SELECT bucket, reason, count(*) AS n FROM routed WHERE reason IS NOT NULL GROUP BY ALL",
    "dedup_single": statuses(),
    "dedup_empty_keys": statuses(exploded=False, checked=False),
    "dedup_validated": statuses(exploded=False),
    "dedup_case_sensitive": statuses(exact=True),
    "dedup_per_sheet": statuses(scope="sheet"),
    "dedup_multi": statuses(exploded=False, checked=False, keys=("email", "segment")),
    "dedup_multi_lineitem": """SELECT l_returnflag, l_linestatus, l_quantity, 'unique' AS status, CAST(1 AS BIGINT) AS n
      FROM lineitem GROUP BY ALL
      UNION ALL SELECT l_returnflag, l_linestatus, l_quantity, 'duplicate', count(*) - 1
      FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity HAVING count(*) > 1""",
    "dedup_part_name": first_by("part", ["p_name"], "p_partkey", "p_partkey, p_name"),
    "dedup_text": first_by("documents", ["text"], "doc_id", "doc_id"),
    "dedup_per_file": first_by("documents", ["text"], "doc_id", "doc_id, source", part="source"),
    "dedup_whole_row": first_by("part", ["p_name", "p_brand", "p_type"], "p_partkey", "p_partkey"),
    "dedup_whole_row_labels": first_by("labels", ["quality", "toxic"], "doc_id", "doc_id"),
    "dedup_whole_row_turns": first_by("conversations", ["role", "text"], "conv_id, turn", "conv_id, turn"),
    "dedup_user_events": first_by("events", ["user_id", "event_type"], "event_id", "event_id"),
    "nested_passthrough": "SELECT vec_id, status, CAST(len(e) AS BIGINT) AS dims FROM ("
    + first_by("embeddings", ["label"], "vec_id", "vec_id, embedding AS e")
    + ")",
    "first_wins": routed() + f" SELECT contact_id, {PART}, email, name FROM routed WHERE status = 'unique'",
    "validation_only": f"""WITH {CONTACTS}, r AS (SELECT contact_id, {reason('email')} AS reason FROM contacts)
      SELECT contact_id, CASE WHEN reason IS NULL THEN 'unique' ELSE 'invalid' END AS status, reason FROM r""",
    "validate_not_empty": f"WITH {CONTACTS} SELECT contact_id, {reason('email', email=False)} AS reason FROM contacts",
    "validate_email": f"WITH {CONTACTS} SELECT contact_id, {reason('email', not_empty=False)} AS reason FROM contacts",
    "validate_combined": f"WITH {CONTACTS} SELECT contact_id, {reason('email')} AS reason FROM contacts",
    "duplicates_audit": SHEETS
    + " SELECT bucket AS source, email, name, segment, score FROM routed WHERE status = 'duplicate'",
    "invalid_audit": SHEETS
    + " SELECT bucket AS source, reason, email, name, segment, score FROM routed WHERE status = 'invalid'",
    "explode_multi_value": f"""WITH {CONTACTS} SELECT contact_id, {PART}, email, segment FROM
      ({explode('contacts', 'contact_id, segment', 'email', '[;,|\\n\\r]')})""",
    "explode_text_lines": f"""SELECT doc_id, {PART}, text FROM ({explode('documents', 'doc_id', 'text', '\\n')})""",
    "drop_blank_rows": f"WITH {CONTACTS} SELECT contact_id FROM contacts WHERE {key('email')} <> ''",
    "resolve_column": f"""WITH {CONTACTS}
      SELECT contact_id, email, name AS full_name, CAST(NULL AS VARCHAR) AS missing FROM contacts""",
    "conform_columns": "SELECT s_suppkey AS suppkey, CAST(NULL AS VARCHAR) AS phone, s_name AS name FROM supplier",
    "union_by_header": """SELECT c_name AS "Name", c_acctbal AS "Balance", c_mktsegment AS segment, CAST(NULL AS BIGINT) AS "Nation"
      FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier""",
    "normalize_text": f"SELECT doc_id, {trim('text')} AS text FROM documents",
    "value_to_text": f"""SELECT o_orderkey, {WHOLE.format('o_totalprice')} AS price,
      CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole FROM orders""",
    "normalize_key": f"""WITH {CONTACTS} SELECT contact_id, {key('email')} AS any_case,
      {trim("coalesce(email, '')")} AS exact_case FROM contacts""",
    "sheet_links": f"""SELECT page_id, id, 'https://docs.google.com/spreadsheets/d/' || id || '/export?format=xlsx' AS export_url
      FROM (SELECT page_id, {LINK_ID} AS id FROM (SELECT page_id, {LINK} AS link FROM pages))""",
    "sanitize_paths": """SELECT page_id, CASE WHEN trim(coalesce(url, '')) = '' THEN 'sheet'
      ELSE regexp_replace(url, '["<>|:*?\\\\/\\x00-\\x1f]', '_', 'g') END AS file_name FROM pages""",
    "output_names": """SELECT o_orderkey, 'Processed_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_part' ||
      CASE WHEN o_orderkey % 250 < 10 THEN '0' ELSE '' END || CAST(o_orderkey % 250 AS VARCHAR) AS name FROM orders""",
    "bucket_order": """WITH e AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN upper(event_type)
        ELSE upper(event_type[1]) || lower(event_type[2:]) END AS bucket FROM events)
      SELECT row_number() OVER (ORDER BY min(event_id)) AS bucket_ord, arg_min(bucket, event_id) AS bucket FROM e GROUP BY lower(bucket)""",
    "rows_per_file": f"""SELECT source AS file, count(*) AS rows_read, count(DISTINCT lower(lang)) AS sheets_read
      FROM documents WHERE {key('text')} <> '' GROUP BY source""",
    "totals_by_file_rollup": f"""WITH d AS (SELECT source, {FILE_KEY} AS rn FROM documents WHERE {key('text')} <> '')
      SELECT source AS file, count(*) AS rows_read, count(*) FILTER (rn = 1) AS unique_rows,
        count(*) FILTER (rn > 1) AS duplicate_rows, CAST(0 AS BIGINT) AS invalid_rows FROM d GROUP BY ROLLUP (source)""",
    "file_outcomes": """SELECT 'Processed' AS status, '' AS message,
        CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS BIGINT) AS rows_read
      UNION ALL SELECT 'Skipped', 'No matching sheets', 0 UNION ALL SELECT 'Failed', 'File not found', 0""",
    "merged_unique": SHEETS + BUCKETS + f" SELECT rn_all AS rn, bucket, contact_id, {PART}, email FROM numbered",
    "chunk_rows": """SELECT o_orderkey, rn, CAST(floor((rn - 1) / 1000) AS BIGINT) + 1 AS chunk
      FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rn FROM orders)""",
    "chunk_lineitem": """SELECT (rn - 1) // 10000 + 1 AS chunk, count(*) AS rows, min(l_orderkey) AS first_order,
        max(l_orderkey) AS last_order, CAST(sum(l_partkey) AS BIGINT) AS parts
      FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) GROUP BY 1""",
    "chunk_per_sheet": SHEETS + BUCKETS
    + f" SELECT contact_id, {PART}, bucket, rn_in AS rn, (rn_in - 1) // 25 + 1 AS chunk FROM numbered",
    "chunk_merged": SHEETS + BUCKETS
    + f" SELECT contact_id, {PART}, rn_all AS rn, (rn_all - 1) // 25 + 1 AS chunk FROM numbered",
    "chunk_files_manifest": SHEETS + BUCKETS + ", " + ONE_BUCKET
    + f""" SELECT CAST(bucket_ord AS BIGINT) AS bucket_ord, bucket, chunk, bucket AS name, '{RUN}' ||
        CASE WHEN chunks > 1 THEN '_part' || lpad(CAST(chunk AS VARCHAR), CAST(greatest(2, length(CAST(chunk AS VARCHAR))) AS INTEGER), '0')
        ELSE '' END AS file, {chunk_rows()} FROM chunked""",
    "chunk_sheets_manifest": SHEETS + BUCKETS + ", " + PER_BUCKET
    + f""" SELECT bucket_ord, bucket, chunk, CASE WHEN chunks > 1 THEN bucket || '_' || CAST(chunk AS VARCHAR) ELSE bucket END AS name,
        '{RUN}' AS file, {chunk_rows()} FROM chunked""",
    "chunk_csv_manifest": SHEETS + BUCKETS + ", " + PER_BUCKET
    + f""" SELECT bucket_ord, bucket, chunk, bucket AS name, '{RUN}_' || bucket || CASE WHEN chunks > 1 THEN '_' ||
        lpad(CAST(chunk AS VARCHAR), CAST(greatest(2, length(CAST(chunk AS VARCHAR))) AS INTEGER), '0') ELSE '' END || '.csv' AS file,
        {chunk_rows()} FROM chunked""",
    "admit_files": f"""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN {HOST} || '.csv' WHEN 1 THEN upper({HOST}) || '.CSV'
        WHEN 2 THEN {HOST} || '.xlsx' WHEN 3 THEN {HOST} || '.XLSM' WHEN 4 THEN url ELSE ' ' END AS path FROM pages)
      SELECT page_id, path FROM p WHERE lower(path) SIMILAR TO '.*\\.(csv|xlsx|xlsm)'
      QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY page_id) = 1""",
    "first_n_sheets": """SELECT conv_id, turn, role FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2""",
    "select_by_glob": """SELECT p_brand, p_partkey, p_name FROM part
      WHERE lower(p_name) LIKE 'hot%' OR lower(p_name) LIKE '%l%ring' OR lower(p_name) = 'blue gear' OR p_name = 'old?bolt'
      QUALIFY row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) = 1""",
    "scan_headers": f"""WITH lines AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
      words AS (SELECT doc_id, line_no, generate_subscripts(ws, 1) - 1 AS pos, {trim('unnest(ws)')} AS header
        FROM (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM lines))
      SELECT header, doc_id AS file_ord FROM words WHERE header <> ''
      QUALIFY row_number() OVER (PARTITION BY lower(header) ORDER BY doc_id, line_no, pos) = 1""",
    "scan_table": """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderkey AS _row FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
    "scan_csv": """SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_acctbal AS VARCHAR) AS balance,
        'a, "b"' || chr(10) || c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS key FROM customer
      UNION ALL SELECT 'supplier', NULL, s_name, CAST(s_acctbal AS VARCHAR), NULL, CAST(s_suppkey AS VARCHAR) FROM supplier""",
    "scan_workbook": f"""WITH {CONTACTS} SELECT CAST(contact_id AS VARCHAR) AS contact_id, sheet, email, name, segment,
      {WHOLE.format('score')} AS score FROM contacts WHERE sheet = 'Vendors'""",
    "sink_csv": SHEETS
    + """ SELECT CASE status WHEN 'duplicate' THEN 'duplicates' ELSE status END AS status, bucket AS source, reason,
        coalesce(email, '') AS email, name, segment FROM routed""",
    "sink_dataset": SHEETS + BUCKETS + ", " + PER_BUCKET
    + f""" SELECT bucket, chunk, CASE WHEN chunks > 1 THEN bucket || '_' || CAST(chunk AS VARCHAR) ELSE bucket END AS sheet_name,
        {chunk_rows()}, {chunk_rows().replace('AS rows', 'AS written')} FROM chunked""",
    "in_place": routed(scope="segment")
    + " SELECT contact_id, email, segment FROM routed WHERE status = 'unique'",
    "incremental": SHEETS + f" SELECT {TOTALS} FROM routed GROUP BY sheet",
    "sanitize_names": """WITH n AS (SELECT p_partkey, left(replace(p_type || '/' || p_name, '/', '_'), 31) AS base FROM part),
      r AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY p_partkey) AS rn FROM n)
      SELECT p_partkey, CASE WHEN rn = 1 THEN base
        ELSE left(base, 31 - length(' (' || rn || ')')) || ' (' || rn || ')' END AS sheet_name FROM r""",
}
# Rows of a workbook come from files whose order is that of their names.
ORACLE_SQL["workbook_run"] = SHEETS + f""" SELECT CAST(contact_id AS VARCHAR) AS contact_id, {PART}, bucket, status FROM routed"""
ORACLE_SQL |= {
    "sanitize_names_many": """WITH r AS (SELECT c_custkey, 'Customers_ all' AS base, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)
      SELECT c_custkey, CASE WHEN rn = 1 THEN base ELSE left(base, 31 - length(' (' || rn || ')')) || ' (' || rn || ')' END AS sheet_name FROM r""",
    "sanitize_names_long": """WITH n AS (SELECT o_orderkey, left('Orders, whole table, priority ' || o_orderpriority, 31) AS base FROM orders),
      f AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY o_orderkey) = 1 AS is_first FROM n),
      r AS (SELECT *, 1 + row_number() OVER (PARTITION BY is_first ORDER BY o_orderkey) AS rn FROM f)
      SELECT o_orderkey, CASE WHEN is_first THEN base
        ELSE left(base, 31 - length(' (' || rn || ')')) || ' (' || rn || ')' END AS sheet_name FROM r""",
    "scan_csv_split": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
      'say "' || l_linestatus || '",' || chr(10) || l_returnflag AS note FROM lineitem""",
    "reserved_columns": "SELECT min(s_suppkey) AS suppkey, 's_suppkey,s_name' AS columns FROM supplier GROUP BY lower(trim(s_name))",
    "in_place_large": """SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus
      FROM orders GROUP BY o_custkey""",
    "incremental_default_folder": SHEETS + f" SELECT {TOTALS} FROM routed WHERE sheet = 'Vendors' GROUP BY sheet",
    "typed_options": statuses(keys=("email", "segment")),
    "scan_file_headers": """WITH w AS (SELECT DISTINCT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS brand, p_name FROM part),
      b AS (SELECT brand, CAST(row_number() OVER (ORDER BY brand) - 1 AS INTEGER) AS file_ord FROM (SELECT DISTINCT brand FROM w))
      SELECT CASE WHEN brand LIKE '%1' THEN upper(p_name) ELSE p_name END AS header, file_ord FROM w JOIN b USING (brand)
      QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY file_ord) = 1""",
    "output_order": routed()
    + """ SELECT email, name, row_number() OVER (ORDER BY contact_id, part_pos) AS position FROM routed WHERE status = 'unique'""",
    "sink_toggles": f"""SELECT 'audit' AS choice, folder, columns, rows FROM ({routed(exploded=False)}
        SELECT 'duplicates' AS folder, '_Source,{DATA}' AS columns, count(*) FILTER (status = 'duplicate') AS rows FROM routed
        UNION ALL SELECT 'invalid', '_Source,_Reason,{DATA}', count(*) FILTER (status = 'invalid') FROM routed)
      UNION ALL SELECT 'unchecked', folder, columns, rows FROM ({routed(exploded=False, checked=False)}
        SELECT 'unique' AS folder, '{DATA}' AS columns, count(*) FILTER (status = 'unique') AS rows FROM routed
        UNION ALL SELECT 'invalid', '_Source,_Reason,{DATA}', 0)""",
    "run_default_folder": routed() + f" SELECT {TOTALS} FROM routed",
}
