"""One query per operator, over the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window, functions as F

from rowsieve.functions import links, names
from rowsieve.functions.rules import reason
from rowsieve.functions.text import canon_str, norm_key, parse_delimiters, parse_list, utrim
from rowsieve.operators import buckets, chunk, columns, hygiene, report, route
from rowsieve.operators.names import sanitize_names
from rowsieve.plans.fixtures import CONTACTS, contacts, table, write_csv, write_workbooks
from rowsieve.plans.run import outcomes, run
from rowsieve.session import qualified, scratch_path
from rowsieve.sinks.inplace import replace_in_place
from rowsieve.sinks.write import CSV_OPTIONS, write_run
from rowsieve.sources import read, sheets
from rowsieve.sources import table as table_source
from rowsieve.sources.files import admit
from rowsieve.spec import (
    FILE_LINEAGE,
    Chunking,
    CleanseSpec,
    Destination,
    KeyMode,
    Lineage,
    OutputFormat,
    SheetMode,
    Validation,
)
from rowsieve.streaming.incremental import run_incremental

BOTH = Validation.EMAIL | Validation.NOT_EMPTY
EMAIL = CleanseSpec(key_columns=("email",), keep_sheets=False)
CHECKED = replace(EMAIL, validation=BOTH)
EXPLODED = replace(CHECKED, explode_multi=True)
PER_SHEET = replace(EXPLODED, keep_sheets=True)
DOCS = Lineage(order=("doc_id",), file="source")


def part_pos():
    return F.col("_part").cast("bigint").alias("part_pos")


def status():
    return F.col("_status").alias("status")


# ---- functions and projections ----

def drop_blank_rows(spark, sf):
    df = contacts(spark, sf).select(
        "contact_id", "email", F.when(F.col("contact_id") % 2 == 0, F.lit("  ")).alias("note")
    )
    return hygiene.drop_blank_rows(df, ["email", "note"]).select("contact_id")


def resolve_column(spark, sf):
    df = contacts(spark, sf).withColumnRenamed("email", " E-Mail ").withColumnRenamed("name", "Full Name")
    return df.select(
        "contact_id",
        columns.resolve(df, "e-mail").alias("email"),
        columns.resolve(df, "FULL NAME ").alias("full_name"),
        columns.resolve(df, "name").alias("missing"),
    )


def conform_columns(spark, sf):
    return columns.conform(table(spark, sf, "supplier"), ["S_SUPPKEY", "s_phone", "s_name"]).select(
        F.col("S_SUPPKEY").alias("suppkey"), F.col("s_phone").alias("phone"), F.col("s_name").alias("name")
    )


def union_by_header(spark, sf):
    a = table(spark, sf, "customer").select(
        F.col("c_name").alias(" Name"), F.col("c_acctbal").alias("Balance"), F.col("c_mktsegment").alias("segment")
    )
    b = table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("BALANCE"), F.col("s_name").alias("name "), F.col("s_nationkey").cast("bigint").alias("Nation")
    )
    return columns.union_sources([a, b])


def normalize_text(spark, sf):
    padded = F.concat(F.lit("\u00a0 \t"), F.col("text"), F.lit(" \u3000\u0085\n"))
    return table(spark, sf, "documents").select("doc_id", utrim(padded).alias("text"))


def value_to_text(spark, sf):
    df = table(spark, sf, "orders")
    price = df.schema["o_totalprice"].dataType
    return df.select(
        "o_orderkey",
        canon_str(F.col("o_totalprice"), price).alias("price"),
        canon_str(F.floor("o_totalprice").cast("double"), price).alias("whole"),
    )


def normalize_key(spark, sf):
    df = contacts(spark, sf)
    return df.select(
        "contact_id", norm_key(F.col("email")).alias("any_case"), norm_key(F.col("email"), True).alias("exact_case")
    )


def sheet_links(spark, sf):
    url = F.expr(
        """CASE page_id % 5
             WHEN 0 THEN 'https://docs.google.com/spreadsheets/d/' || md5(url) || '/edit#gid=0'
             WHEN 1 THEN 'https://drive.google.com/open?usp=sharing&id=' || md5(url)
             WHEN 2 THEN 'https://docs.google.com/spreadsheets/d/' || left(md5(url), 19) || '/edit'
             WHEN 3 THEN 'https://drive.google.com/open?id=' || md5(url) || '&x=1'
             ELSE url END"""
    )
    df = table(spark, sf, "pages").select("page_id", url.alias("link"))
    return df.select("page_id", links.sheet_id(F.col("link")).alias("id"), links.export_url(F.col("link")).alias("export_url"))


def sanitize_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", names.clean_file_name(F.col("url")).alias("file_name"))


def sanitize_sheet_names(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.concat("p_type", F.lit("/"), "p_name").alias("name"))
    return sanitize_names(df, "name", ["p_partkey"]).select("p_partkey", "sheet_name")


LONG_NAME = "Orders, whole table, priority "


def sanitize_names_many(spark, sf):
    """One name for all rows: each gets a number of its own."""
    df = table(spark, sf, "customer").select("c_custkey", F.lit("Customers: all").alias("name"))
    return sanitize_names(df, "name", ["c_custkey"]).select("c_custkey", "sheet_name")


def sanitize_names_long(spark, sf):
    """Names of 31 characters that repeat and that a number cuts to one and the same prefix."""
    df = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit(LONG_NAME), "o_orderpriority").alias("name"))
    return sanitize_names(df, "name", ["o_orderkey"]).select("o_orderkey", "sheet_name")


def output_names(spark, sf):
    df = table(spark, sf, "orders")
    return df.select(
        "o_orderkey",
        F.concat(names.run_name(F.col("o_orderdate")), F.lit("_part"), names.two_digits(F.col("o_orderkey") % 250)).alias("name"),
    )


# ---- validation ----

def _reasons(spark, sf, validation):
    df = contacts(spark, sf)
    return df.select("contact_id", reason(F.col("email"), "email", validation).alias("reason"))


def validate_not_empty(spark, sf):
    return _reasons(spark, sf, Validation.NOT_EMPTY)


def validate_email(spark, sf):
    return _reasons(spark, sf, Validation.EMAIL)


def validate_combined(spark, sf):
    return _reasons(spark, sf, BOTH)


def invalid_reason_counts(spark, sf):
    return report.reason_counts(contacts(spark, sf), PER_SHEET, CONTACTS)


def validation_only(spark, sf):
    spec = replace(CHECKED, key_mode=KeyMode.NONE, key_columns=(), validation_column="email")
    return route.cleanse(contacts(spark, sf), spec, CONTACTS).select(
        "contact_id", status(), F.col("_Reason").alias("reason")
    )


# ---- explode ----

def explode_multi_value(spark, sf):
    df = contacts(spark, sf).select("contact_id", "email", "segment")
    return hygiene.explode_multi(df, "Email", ";,|\n\r").select("contact_id", part_pos(), "email", "segment")


def explode_text_lines(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    return hygiene.explode_multi(df, "text", "\n").select("doc_id", part_pos(), "text")


# ---- dedup and routing ----

def _routed(spark, sf, spec):
    return route.cleanse(contacts(spark, sf), spec, CONTACTS).select("contact_id", part_pos(), "email", status())


def dedup_single(spark, sf):
    return _routed(spark, sf, EXPLODED)


def dedup_empty_keys(spark, sf):
    return _routed(spark, sf, EMAIL)


def dedup_validated(spark, sf):
    return _routed(spark, sf, CHECKED)


def dedup_case_sensitive(spark, sf):
    return _routed(spark, sf, replace(EXPLODED, case_sensitive=True))


def dedup_per_sheet(spark, sf):
    return _routed(spark, sf, PER_SHEET)


def dedup_multi(spark, sf):
    spec = replace(EMAIL, key_mode=KeyMode.MULTIPLE, key_columns=("email", "segment"))
    return _routed(spark, sf, spec)


def typed_options(spark, sf):
    """Names and delimiters as typed; validation falls back to the first key column."""
    spec = replace(
        EXPLODED, key_mode=KeyMode.MULTIPLE, key_columns=tuple(parse_list(" email ;\n\nsegment, ")),
        delimiters=parse_delimiters("; , |\t\n"), validation_column="  ",
    )
    return _routed(spark, sf, spec)


def dedup_multi_lineitem(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", F.col("_metadata.row_index").alias("_row")
    )
    spec = CleanseSpec(key_mode=KeyMode.MULTIPLE, key_columns=("l_returnflag", "l_linestatus", "l_quantity"))
    routed = route.cleanse(df, spec, Lineage(order=("_row",)))
    return routed.groupBy("l_returnflag", "l_linestatus", "l_quantity", status()).agg(F.count("*").alias("n"))


def dedup_part_name(spark, sf):
    spec = CleanseSpec(key_columns=("p_name",))
    routed = route.cleanse(table(spark, sf, "part").select("p_partkey", "p_name"), spec, Lineage(order=("p_partkey",)))
    return routed.select("p_partkey", "p_name", status())


def dedup_text(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    return route.cleanse(df, CleanseSpec(key_columns=("text",)), Lineage(order=("doc_id",))).select("doc_id", status())


def dedup_per_file(spark, sf):
    spec = CleanseSpec(key_columns=("text",), keep_sheets=False, destination=Destination.IN_PLACE)
    df = table(spark, sf, "documents").select("doc_id", "source", "text")
    return route.cleanse(df, spec, DOCS).select("doc_id", "source", status())


def _whole_row(df, order):
    spec = CleanseSpec(key_mode=KeyMode.ROW)
    return route.cleanse(df, spec, Lineage(order=order)).select(*order, status())


def dedup_whole_row(spark, sf):
    return _whole_row(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ("p_partkey",))


def dedup_whole_row_labels(spark, sf):
    return _whole_row(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), ("doc_id",))


def dedup_whole_row_turns(spark, sf):
    return _whole_row(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), ("conv_id", "turn"))


def dedup_user_events(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    spec = CleanseSpec(key_mode=KeyMode.MULTIPLE, key_columns=("user_id", "event_type"))
    return route.cleanse(df, spec, Lineage(order=("event_id",))).select("event_id", status())


def nested_passthrough(spark, sf):
    spec = CleanseSpec(key_columns=("label",))
    df = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    routed = route.cleanse(df, spec, Lineage(order=("vec_id",)))
    return routed.select("vec_id", status(), F.size("embedding").cast("bigint").alias("dims"))


def first_wins(spark, sf):
    unique = route.unique_rows(contacts(spark, sf), EXPLODED, CONTACTS).filter("_status = 'unique'")
    return unique.select("contact_id", part_pos(), "email", "name")


def route_status(spark, sf):
    return route.cleanse(contacts(spark, sf), PER_SHEET, CONTACTS).select(
        "contact_id", part_pos(), "email", "name", "segment", "score",
        F.col("_bucket").alias("bucket"), status(), F.col("_Reason").alias("reason"),
    )


def _audit_columns(df, *more):
    return df.select(F.col("_Source").alias("source"), *more, "email", "name", "segment", "score")


def duplicates_audit(spark, sf):
    return _audit_columns(route.duplicates(contacts(spark, sf), PER_SHEET, CONTACTS))


def invalid_audit(spark, sf):
    bad = route.invalid(contacts(spark, sf), PER_SHEET, CONTACTS)
    return _audit_columns(bad, F.col("_Reason").alias("reason"))


# ---- reports ----

def run_totals(spark, sf):
    return report.run_totals(contacts(spark, sf), EXPLODED, CONTACTS)


def bucket_counts(spark, sf):
    return report.bucket_counts(contacts(spark, sf), PER_SHEET, CONTACTS)


def bucket_order(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", F.initcap("event_type").alias("_sheet"))
    labelled = df.withColumn("_bucket", F.when(F.col("user_id") % 2 == 0, F.upper("_sheet")).otherwise(F.col("_sheet")))
    return buckets.bucket_order(labelled, ["event_id"])


def rows_per_file(spark, sf):
    df = table(spark, sf, "documents").select("source", "lang", "text")
    return report.file_counts(df, Lineage(order=(), file="source", sheet="lang"), ["text"])


def totals_by_file_rollup(spark, sf):
    spec = CleanseSpec(key_columns=("text",), keep_sheets=False, destination=Destination.IN_PLACE)
    df = table(spark, sf, "documents").select("doc_id", "source", "text")
    return report.totals_by_file(df, spec, DOCS)


# ---- order and chunks ----

def _unique_contacts(spark, sf):
    df = contacts(spark, sf)
    rows = route.unique_rows(df, PER_SHEET, CONTACTS).filter("_status = 'unique'")
    found = buckets.source_buckets(df, PER_SHEET, CONTACTS)
    return buckets.attach_bucket_names(rows, found), ["_bucket_pos", "contact_id", "_part"]


def merged_unique(spark, sf):
    rows, order = _unique_contacts(spark, sf)
    numbered = chunk.row_numbers(chunk.sorted_stage(rows, order))
    return numbered.select(F.col("_rn").alias("rn"), F.col("_bucket").alias("bucket"), "contact_id", part_pos(), "email")


def chunk_rows(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    out = chunk.with_chunk(df, ["o_custkey", "o_orderkey"], 1000)
    return out.select("o_orderkey", F.col("_rn").alias("rn"), F.col("_chunk").alias("chunk"))


def chunk_lineitem(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    out = chunk.with_chunk(table(spark, sf, "lineitem").select(*keys), keys, 10_000)
    return out.groupBy(F.col("_chunk").alias("chunk")).agg(
        F.count("*").alias("rows"),
        F.min("l_orderkey").alias("first_order"),
        F.max("l_orderkey").alias("last_order"),
        F.sum("l_partkey").alias("parts"),
    )


def chunk_per_sheet(spark, sf):
    rows, order = _unique_contacts(spark, sf)
    out = chunk.with_chunk(rows, order, 25, per="_bucket")
    return out.select("contact_id", part_pos(), F.col("_bucket").alias("bucket"), F.col("_rn").alias("rn"), F.col("_chunk").alias("chunk"))


def chunk_merged(spark, sf):
    rows, order = _unique_contacts(spark, sf)
    out = chunk.with_chunk(rows, order, 25)
    return out.select("contact_id", part_pos(), F.col("_rn").alias("rn"), F.col("_chunk").alias("chunk"))


def _manifest(spark, sf, **options):
    spec = replace(PER_SHEET, chunk_rows=25, **options)
    return chunk.manifest(report.bucket_counts(contacts(spark, sf), spec, CONTACTS), spec, "Processed_20240101_000000")


def chunk_files_manifest(spark, sf):
    return _manifest(spark, sf, chunking=Chunking.SEPARATE_FILES)


def chunk_sheets_manifest(spark, sf):
    return _manifest(spark, sf, chunking=Chunking.PER_SHEET)


def chunk_csv_manifest(spark, sf):
    return _manifest(spark, sf, chunking=Chunking.PER_SHEET, format=OutputFormat.CSV)


# ---- sources ----

def admit_files(spark, sf):
    path = F.expr(
        """CASE page_id % 6
             WHEN 0 THEN regexp_extract(url, '//([^/]+)/', 1) || '.csv'
             WHEN 1 THEN upper(regexp_extract(url, '//([^/]+)/', 1)) || '.CSV'
             WHEN 2 THEN regexp_extract(url, '//([^/]+)/', 1) || '.xlsx'
             WHEN 3 THEN regexp_extract(url, '//([^/]+)/', 1) || '.XLSM'
             WHEN 4 THEN url
             ELSE ' ' END"""
    )
    df = table(spark, sf, "pages").select("page_id", path.alias("path"))
    return admit(df, "path", ["page_id"])


def first_n_sheets(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    spec = CleanseSpec(sheets=SheetMode.FIRST_N, first_n=2)
    return sheets.select_sheets(df, spec, "conv_id", "role", "turn")


def select_by_glob(spark, sf):
    df = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    spec = CleanseSpec(sheets=SheetMode.BY_NAME, sheet_patterns=("hot*", " *L*RING ", "Blue Gear", "old?bolt", " "))
    return sheets.select_sheets(df, spec, "p_brand", "p_name", "p_partkey")


def scan_headers(spark, sf):
    docs = table(spark, sf, "documents")
    lines = docs.select(F.col("doc_id").alias("_file_ord"), F.posexplode(F.split("text", "\n")).alias("_sheet_ord", "line"))
    words = lines.select("_file_ord", "_sheet_ord", F.posexplode(F.split("line", " ")).alias("_pos", "header"))
    return read.scan_headers(words.withColumn("header", utrim(F.col("header")))).select("header", "file_ord")


def scan_file_headers(spark, sf):
    """Headers of one CSV file per brand, which are the names of its parts."""
    root = scratch_path(spark, "headers")
    brand = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("brand")
    header = F.array_join(F.array_sort(F.collect_set("p_name")), ",")
    heads = table(spark, sf, "part").groupBy(brand).agg(header.alias("header"))
    spelled = heads.select("brand", F.when(F.col("brand").endswith("1"), F.upper("header")).otherwise(F.col("header")))
    spelled.write.partitionBy("brand").option("sep", "\u0001").csv(root)
    return read.scan_headers(read.read_sources(spark, [root]).headers).select("header", "file_ord")


def scan_table(spark, sf):
    """First order of each customer, in the order the rows are stored."""
    df, lineage = table_source.read_parquet(spark, f"{sf}/orders.parquet")
    routed = route.unique_rows(df, CleanseSpec(key_columns=("o_custkey",)), lineage)
    return routed.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "_row")


def _csv_sources(spark, sf):
    """Two folders of CSV files with differing headers."""
    root = scratch_path(spark, "csv")
    customer = table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "c_name AS ` Name `", "c_acctbal AS balance", "'a, \"b\"\n' || c_mktsegment AS Segment"
    )
    supplier = table(spark, sf, "supplier").selectExpr("s_acctbal AS BALANCE", "s_name AS name", "s_suppkey AS Key")
    write_csv(customer, f"{root}/customer")
    write_csv(supplier, f"{root}/supplier")
    return [f"{root}/customer", f"{root}/supplier"]


def scan_csv(spark, sf):
    rows = read.read_sources(spark, _csv_sources(spark, sf)).rows
    kind = F.regexp_extract("_file", "/(customer|supplier)/", 1).alias("kind")
    return rows.select(kind, "id", F.col("Name").alias("name"), "balance", F.col("Segment").alias("segment"), F.col("Key").alias("key"))


def scan_csv_split(spark, sf):
    """One CSV file larger than a split, so that many tasks find its records."""
    root = scratch_path(spark, "split")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit('say "'), "l_linestatus", F.lit('",\n'), "l_returnflag").alias("note")
    )
    write_csv(rows.coalesce(1), root)
    name = "spark.sql.files.maxPartitionBytes"
    saved = {n: spark.conf.get(n) for n in (name, "spark.sql.files.openCostInBytes")}
    try:
        for n in saved:
            spark.conf.set(n, str(1 << 20))
        found = read.read_sources(spark, [root]).rows
    finally:
        for n, value in saved.items():
            spark.conf.set(n, value)
    key = [F.col(c).cast("bigint").alias(c) for c in ("l_orderkey", "l_linenumber")]
    return found.select(*key, "note")


def reserved_columns(spark, sf):
    """Input columns named like the audit columns are left out, in any case of letters."""
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.lit(1).alias("_SOURCE"), F.lit(2).alias("_reason"))
    kept = route.unique_rows(df, CleanseSpec(key_columns=("s_name",)), Lineage(order=("s_suppkey",)))
    own = route.user_columns(kept, Lineage(order=()))
    return kept.select(F.col("s_suppkey").cast("bigint").alias("suppkey"), F.lit(",".join(own)).alias("columns"))


def _workbooks(spark, sf):
    root = scratch_path(spark, "books")
    rows = contacts(spark, sf).repartitionByRange(8, "contact_id").sortWithinPartitions("contact_id")
    write_workbooks(rows, root, "sheet")
    return root


def scan_workbook(spark, sf):
    spec = CleanseSpec(sheets=SheetMode.BY_NAME, sheet_patterns=("vend*", "none"))
    rows = read.read_sources(spark, [_workbooks(spark, sf)], spec).rows
    return rows.select("contact_id", F.col("_sheet").alias("sheet"), "email", "name", "segment", "score")


def workbook_run(spark, sf):
    rows = read.read_sources(spark, [_workbooks(spark, sf)]).rows
    routed = route.cleanse(rows, PER_SHEET, FILE_LINEAGE)
    return routed.select("contact_id", part_pos(), F.col("_bucket").alias("bucket"), status())


def file_outcomes(spark, sf):
    paths = _csv_sources(spark, sf)
    books = _workbooks(spark, sf)
    spec = CleanseSpec(sheets=SheetMode.BY_NAME, sheet_patterns=("Absent",))
    sources = read.read_sources(spark, [*paths, f"{paths[0]}/gone.csv", books], spec)
    found = outcomes(sources)
    return found.groupBy("status", "message").agg(F.sum("rows_read").alias("rows_read"))


# ---- sinks ----

ALL_BUCKETS = {"emit_duplicates": True, "emit_invalid": True}


def sink_csv(spark, sf):
    path = scratch_path(spark, "out")
    spec = replace(PER_SHEET, format=OutputFormat.CSV, **ALL_BUCKETS)
    write_run(contacts(spark, sf), spec, CONTACTS, path)

    def back(name, source, reason):
        df = spark.read.options(**CSV_OPTIONS, multiLine=True).csv(f"{path}/{name}")
        email = F.coalesce("email", F.lit("")).alias("email")
        return df.select(F.lit(name).alias("status"), source.alias("source"), reason.alias("reason"), email, "name", "segment")

    nothing = F.lit(None).cast("string")
    return (
        back("unique", F.col("_bucket"), nothing)
        .unionByName(back("duplicates", F.col("_Source"), nothing))
        .unionByName(back("invalid", F.col("_Source"), F.col("_Reason")))
    )


def sink_dataset(spark, sf):
    path = scratch_path(spark, "out")
    spec = replace(PER_SHEET, chunking=Chunking.PER_SHEET, chunk_rows=25)
    write_run(contacts(spark, sf), spec, CONTACTS, path)
    rows = spark.read.parquet(f"{path}/unique").groupBy("_bucket", "_chunk").agg(F.count("*").alias("written"))
    listed = spark.read.parquet(f"{path}/manifest")
    return listed.join(rows, (F.col("bucket") == F.col("_bucket")) & (F.col("chunk") == F.col("_chunk")), "left").select(
        "bucket", "chunk", "sheet_name", "rows", F.coalesce("written", F.lit(0)).alias("written")
    )


def output_order(spark, sf):
    """Place of each unique row in the written files, taken in the order of their names."""
    path = scratch_path(spark, "out")
    write_run(contacts(spark, sf), EXPLODED, CONTACTS, path)
    rows = spark.read.parquet(f"{path}/unique").select(
        "email", "name", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")
    )
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    begins = rows.groupBy("file").agg(F.count("*").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin")
    )
    return rows.join(begins, "file").select("email", "name", (F.col("begin") + F.col("at") + 1).alias("position"))


def sink_toggles(spark, sf):
    """Which tables are there, with their columns: audit tables only; and no invalid row to write."""
    out = None
    for choice, spec in (
        ("audit", replace(CHECKED, emit_unique=False, **ALL_BUCKETS)),
        ("unchecked", replace(EMAIL, emit_invalid=True)),
    ):
        path = scratch_path(spark, "out")
        write_run(contacts(spark, sf), spec, CONTACTS, path)
        for folder in ("unique", "duplicates", "invalid"):
            if qualified(spark, f"{path}/{folder}"):
                rows = spark.read.parquet(f"{path}/{folder}")
                named = [F.lit(choice).alias("choice"), F.lit(folder).alias("folder"), F.lit(",".join(rows.columns)).alias("columns")]
                one = rows.agg(F.count("*").alias("rows")).select(*named, "rows")
                out = one if out is None else out.unionByName(one)
    return out


def run_default_folder(spark, sf):
    """Without an output folder a run is written beside the first path given."""
    root = scratch_path(spark, "default")
    write_csv(contacts(spark, sf), f"{root}/in")
    run(spark, [f"{root}/in"], replace(EXPLODED, **ALL_BUCKETS), name="run")
    return spark.read.parquet(f"{root}/run/counts").select("rows_read", "unique_rows", "duplicate_rows", "invalid_rows")


def in_place(spark, sf):
    """One CSV file per segment, each replaced by its unique rows."""
    root = scratch_path(spark, "inplace")
    rows = contacts(spark, sf).drop("sheet").withColumn("folder", F.col("segment"))
    rows = rows.repartitionByRange("folder").sortWithinPartitions("folder", "contact_id")
    rows.write.options(**CSV_OPTIONS).partitionBy("folder").csv(root)
    spec = replace(EXPLODED, destination=Destination.IN_PLACE)
    replace_in_place(spark, read.read_sources(spark, [root], spec).rows, spec, keep_backup=False)
    back = read.read_sources(spark, [root]).rows
    return back.select(F.col("contact_id").cast("bigint").alias("contact_id"), "email", "segment")


def in_place_large(spark, sf):
    """All orders as one CSV file, replaced by the first order of each customer."""
    root = scratch_path(spark, "inplace")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus").orderBy("o_orderkey")
    write_csv(orders.coalesce(1), root)
    spec = CleanseSpec(key_columns=("o_custkey",), destination=Destination.IN_PLACE)
    replace_in_place(spark, read.read_sources(spark, [root], spec).rows, spec, keep_backup=False)
    back = read.read_sources(spark, [root]).rows
    return back.select(*[F.col(c).cast("bigint").alias(c) for c in ("o_custkey", "o_orderkey")], "o_orderstatus")


def incremental_default_folder(spark, sf):
    """Without an output folder three calls on one file give one batch."""
    root = scratch_path(spark, "incremental")
    write_csv(contacts(spark, sf).filter("sheet = 'Vendors'"), f"{root}/in")
    for _ in range(3):
        run_incremental(spark, f"{root}/in", replace(EXPLODED, **ALL_BUCKETS), f"{root}/checkpoint")
    counts = spark.read.option("basePath", f"{root}/in/_processed").parquet(f"{root}/in/_processed/*/counts")
    return counts.select("rows_read", "unique_rows", "duplicate_rows", "invalid_rows")


def incremental(spark, sf):
    """Two sheets arriving one after the other as files; each run takes the new ones only."""
    root = scratch_path(spark, "incremental")
    spec = replace(EXPLODED, output_dir=f"{root}/out", **ALL_BUCKETS)
    for sheet in ("Customers", "Vendors"):
        write_csv(contacts(spark, sf).filter(F.col("sheet") == sheet), f"{root}/in/{sheet}")
        run_incremental(spark, f"{root}/in", spec, f"{root}/checkpoint")
    counts = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out/*/counts")
    return counts.select("rows_read", "unique_rows", "duplicate_rows", "invalid_rows")


QUERIES = {
    f.__name__: f
    for f in (
        bucket_counts, route_status, run_totals, invalid_reason_counts,
        dedup_single, dedup_empty_keys, dedup_validated, dedup_case_sensitive, dedup_per_sheet, dedup_multi,
        dedup_multi_lineitem, dedup_part_name, dedup_text, dedup_per_file, dedup_whole_row,
        dedup_whole_row_labels, dedup_whole_row_turns, dedup_user_events, nested_passthrough, first_wins,
        validation_only, validate_not_empty, validate_email, validate_combined,
        duplicates_audit, invalid_audit,
        explode_multi_value, explode_text_lines,
        drop_blank_rows, resolve_column, conform_columns, union_by_header, normalize_text, value_to_text,
        normalize_key, sheet_links, sanitize_paths, output_names,
        bucket_order, rows_per_file, totals_by_file_rollup, file_outcomes,
        merged_unique, chunk_rows, chunk_lineitem, chunk_per_sheet, chunk_merged,
        chunk_files_manifest, chunk_sheets_manifest, chunk_csv_manifest,
        admit_files, first_n_sheets, select_by_glob, scan_headers, scan_table, scan_csv, scan_workbook, workbook_run,
        sink_csv, sink_dataset, in_place, incremental,
        sanitize_names_many, sanitize_names_long, scan_csv_split, reserved_columns, in_place_large, incremental_default_folder,
        typed_options, scan_file_headers, output_order, sink_toggles, run_default_folder,
    )
}
QUERIES["sanitize_names"] = sanitize_sheet_names
