"""Edge rows, invariants and the shape of plans."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import Window, functions as F

from conftest import SF
from rowsieve import CleanseSpec, Destination, KeyMode, Lineage, Validation, cleanse, unique_rows
from rowsieve.functions.links import export_url, sheet_id
from rowsieve.functions.rules import reason
from rowsieve.functions.text import canon_str, compact_key, norm_key, parse_delimiters, parse_list, utrim
from rowsieve.operators import buckets, chunk, columns, dedup, hygiene, report
from rowsieve.operators.columns import INTERNAL
from rowsieve.operators.names import sanitize_names
from rowsieve.operators.report import bucket_counts, reason_counts
from rowsieve.operators.small import row_bytes
from rowsieve.plans.fixtures import CONTACTS, contacts
from rowsieve.plans.queries import EXPLODED, PER_SHEET
from rowsieve.sources.sheets import matches_any
from rowsieve.spec import Chunking, SpecError

ID = Lineage(order=("id",))


def frame(spark, values, name="v"):
    return spark.createDataFrame(list(enumerate(values)), f"id bigint, `{name}` string")


def column(df, expr):
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


def statuses(df, spec, lineage=ID):
    return [r["_status"] for r in cleanse(df, spec, lineage).orderBy("id", "_part").collect()]


# ---- text ----


def test_utrim(spark):
    df = frame(spark, [" \u0085　a b\t\n", "​a​", "  ", None])
    assert column(df, utrim(F.col("v"))) == ["a b", "​a​", "", None]


def test_norm_and_compact_key(spark):
    df = frame(spark, [" Foo ", None, "x" * 63, "x" * 64, "X" * 64])
    assert column(df, norm_key(F.col("v")))[:2] == ["foo", ""]
    assert column(df, norm_key(F.col("v"), True))[0] == "Foo"
    compact = column(df, compact_key(norm_key(F.col("v"))))
    assert {len(c) for c in compact} == {32} and compact[3] == compact[4] and len(set(compact)) == 4


def test_canon_str(spark):
    df = spark.createDataFrame([(0, 1.0), (1, -2.5), (2, 1e15), (3, 0.1), (4, float("nan")), (5, None)], "id int, v double")
    kind = df.schema["v"].dataType
    assert column(df, canon_str(F.col("v"), kind)) == ["1", "-2.5", "1.0E15", "0.1", "NaN", None]


def test_parsing():
    assert parse_list(" a, b ;c\n\n d\r,,") == ["a", "b", "c", "d"]
    assert parse_delimiters("; , |\n") == ";,|"


def test_links(spark):
    long_id = "a-B_" * 6
    df = frame(spark, [f"https://x/spreadsheets/d/{long_id}/edit", f"https://x/open?id={long_id}", "https://x/spreadsheets/d/short/", ""])
    assert column(df, sheet_id(F.col("v"))) == [long_id, long_id, None, None]
    assert column(df, export_url(F.col("v")))[0].endswith(f"/d/{long_id}/export?format=xlsx")


# ---- validation ----


def test_email_bounds(spark):
    long = "a" * 308
    cases = {"a@b.": "length", "a@b.c": "format", "a@b.co": None, f"{long}@example.com": None, f"{long}a@example.com": "length",
             "@bad.com": "format", "a@x.com;": "format", "a..b@x..co": None, "": "empty (expected email)"}
    df = frame(spark, list(cases))
    got = column(df, reason(F.col("v"), "v", Validation.EMAIL))
    for value, want in zip(got, cases.values()):
        assert (value is None) == (want is None) and (want is None or want in value)


def test_extra_rule(spark):
    df = frame(spark, ["ab", "abc"])
    short = lambda value, name: F.when(F.length(value) < 3, F.lit("short"))
    routed = cleanse(df, CleanseSpec(key_columns=("v",)), ID, rules=(short,))
    assert [r["_Reason"] for r in routed.orderBy("id").collect()] == ["short", None]


# ---- explode ----


@pytest.mark.parametrize(
    "cell, want",
    [("a@x.com;", ["a@x.com;"]), (";;", [";;"]), ("a@x.com; ;b@x.com", ["a@x.com", "b@x.com"]), (None, [None]),
     ("a|b,c\nd\re", list("abcde")), (" a ", [" a "])],
)
def test_explode(spark, cell, want):
    rows = hygiene.explode_multi(frame(spark, [cell], " V "), "v", ";,|\n\r").collect()
    assert [r[" V "] for r in sorted(rows, key=lambda r: r["_part"])] == want


@pytest.mark.parametrize("delimiters", ["]", "\\", "^-", "[a", ".", "$()"])
def test_delimiters_are_literal(spark, delimiters):
    cell = delimiters[0].join(["x", "y"]) + delimiters[-1] + "z"
    rows = hygiene.explode_multi(frame(spark, [cell]), "v", delimiters).collect()
    assert sorted(r["v"] for r in rows) == ["x", "y", "z"]


def test_trailing_delimiter_stays_invalid(spark):
    spec = CleanseSpec(key_columns=("v",), validation=Validation.EMAIL, explode_multi=True)
    assert statuses(frame(spark, ["a@x.com;"]), spec) == ["invalid"]


def test_explode_needs_a_key_column(spark):
    spec = CleanseSpec(key_mode=KeyMode.ROW, explode_multi=True, key_columns=("v",))
    assert cleanse(frame(spark, ["a;b"]), spec, ID).count() == 1


# ---- columns ----


def test_resolve(spark):
    df = spark.createDataFrame([(0, "a", "b")], ["id", " Email ", "firstname"])
    row = df.select(columns.resolve(df, "email"), columns.resolve(df, "name").alias("name")).first()
    assert row[0] == "a" and row["name"] is None


def test_reserved_columns_are_dropped(spark):
    df = spark.createDataFrame([(0, "a", "old", "old")], ["id", "v", "_Source", "_Reason"])
    out = cleanse(df, CleanseSpec(key_columns=("v",)), ID)
    assert "_Source" not in out.columns and out.first()["_Reason"] is None


def test_names_used_internally_are_refused(spark):
    df = spark.createDataFrame([(0, "a", "x")], ["id", "v", "_status"])
    with pytest.raises(SpecError):
        cleanse(df, CleanseSpec(key_columns=("v",)), ID)


def test_blank_rows_are_not_read(spark):
    df = spark.createDataFrame([(0, "", "  ", None), (1, "", "x", None)], "id int, a string, b string, c double")
    assert [r["id"] for r in cleanse(df, CleanseSpec(key_columns=("a",)), ID).collect()] == [1]


# ---- dedup ----


def test_blank_keys(spark):
    two = spark.createDataFrame([(0, "", "", "p"), (1, " ", None, "q")], "id int, a string, b string, c string")
    assert statuses(two, CleanseSpec(key_columns=("a",))) == ["unique", "unique"]
    both = CleanseSpec(key_mode=KeyMode.MULTIPLE, key_columns=("a", "b"))
    assert statuses(two, both) == ["unique", "duplicate"]
    assert statuses(two, replace(both, key_columns=("a",))) == ["unique", "unique"]


def test_case(spark):
    df = frame(spark, ["Foo", "foo", " FOO ", "foo"])
    spec = CleanseSpec(key_columns=("V",))
    assert statuses(df, spec) == ["unique", "duplicate", "duplicate", "duplicate"]
    assert statuses(df, replace(spec, case_sensitive=True)) == ["unique", "unique", "unique", "duplicate"]


def test_missing_key_column_keeps_all(spark):
    assert statuses(frame(spark, ["a", "a"]), CleanseSpec(key_columns=("other",))) == ["unique", "unique"]


def test_whole_row_parts_do_not_run_together(spark):
    df = spark.createDataFrame([(0, "a", "bc"), (1, "ab", "c"), (2, "A ", "bc")], "id int, x string, y string")
    assert statuses(df, CleanseSpec(key_mode=KeyMode.ROW)) == ["unique", "unique", "duplicate"]


@pytest.mark.parametrize("kind, values", [
    ("double", [0.0, -0.0, 1.0, 1.0, None, None, float("nan"), float("nan")]),
    ("bigint", [1, 1, None, None, 2]),
    ("boolean", [True, None, True, None]),
    ("date", ["2024-01-01", None, "2024-01-01", "2024-01-02", None]),
    ("decimal(10,2)", ["1.5", "1.50", None, None]),
    ("timestamp", ["2024-01-01 00:00:00", None, "2024-01-01 00:00:00", None]),
])
def test_keys_that_are_not_text(spark, kind, values):
    """Same result as for the texts of the values; a null key never makes rows equal."""
    source = "double" if kind == "double" else "string"
    texts = [v if v is None or source == "double" else str(v) for v in values]
    df = spark.createDataFrame(list(enumerate(texts)), f"id bigint, v {source}").select("id", F.col("v").cast(kind).alias("v"), F.lit("x").alias("w"))
    as_text = df.withColumn("v", canon_str(F.col("v"), df.schema["v"].dataType))
    for spec in (CleanseSpec(key_columns=("v",)), CleanseSpec(key_mode=KeyMode.MULTIPLE, key_columns=("v", "w")), CleanseSpec(key_mode=KeyMode.ROW)):
        got = statuses(df, spec)
        assert got == statuses(as_text, spec) and "duplicate" in got
    assert all(s == "unique" for s, v in zip(statuses(df, CleanseSpec(key_columns=("v",))), values) if v is None)


def test_invalid_rows_claim_no_key(spark):
    df = spark.createDataFrame([(0, "k", "bad"), (1, "k", "a@b.co"), (2, "K", "c@d.co")], "id int, k string, mail string")
    spec = CleanseSpec(key_columns=("k",), validation=Validation.EMAIL, validation_column="mail")
    assert statuses(df, spec) == ["invalid", "unique", "duplicate"]


def test_sheets_of_same_name_share_a_scope(spark):
    df = spark.createDataFrame([(0, "Data", "a"), (1, "data", "A"), (2, "Other", "a")], "id int, s string, v string")
    lineage = Lineage(order=("id",), sheet="s")
    assert statuses(df, CleanseSpec(key_columns=("v",)), lineage) == ["unique", "duplicate", "unique"]
    merged = CleanseSpec(key_columns=("v",), keep_sheets=False)
    assert statuses(df, merged, lineage) == ["unique", "duplicate", "duplicate"]


def test_per_file_scope(spark):
    df = spark.createDataFrame([(0, "f", "a"), (1, "g", "a"), (2, "g", "a")], "id int, f string, v string")
    spec = CleanseSpec(key_columns=("v",), keep_sheets=False, destination=Destination.IN_PLACE)
    assert statuses(df, spec, Lineage(order=("id",), file="f")) == ["unique", "unique", "duplicate"]


@pytest.mark.parametrize("spec", [EXPLODED, PER_SHEET], ids=["global", "sheet"])
def test_strategies_agree(spark, spec):
    df = contacts(spark, SF)
    full = cleanse(df, spec, CONTACTS)
    ids = lambda d: sorted((r["contact_id"], r["_part"], r["email"]) for r in d.collect())
    first = ids(full.filter("_status = 'unique'"))
    assert first == ids(unique_rows(df, spec, CONTACTS).filter("_status = 'unique'"))
    valid = full.filter("_status != 'invalid'").withColumns({"_k": norm_key(F.col("email")), "_s": F.lower("_bucket")})
    group = ["_k", "_s"] if spec.keep_sheets else ["_k"]
    order = ("contact_id", "_part")
    assert ids(dedup.mark_first(valid, dedup.winners(valid, group, order), order).filter("_first")) == first
    by_window = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    assert ids(valid.withColumn("_n", by_window).filter("_n = 1")) == first


def test_every_duplicate_has_a_winner(spark):
    rows = cleanse(contacts(spark, SF), PER_SHEET, CONTACTS).collect()
    key = lambda r: (r["_bucket"].lower(), (r["email"] or "").strip().lower())
    unique = [key(r) for r in rows if r["_status"] == "unique"]
    assert len(unique) == len(set(unique))
    assert {key(r) for r in rows if r["_status"] == "duplicate"} <= set(unique)


@pytest.mark.parametrize("partitions", ["1", "3", "17"])
def test_result_does_not_depend_on_partitions(spark, conf, partitions):
    conf("spark.sql.shuffle.partitions", partitions)
    df = contacts(spark, SF).repartition(int(partitions) * 2)
    got = cleanse(df, EXPLODED, CONTACTS).filter("_status = 'unique'")
    expected = cleanse(contacts(spark, SF), EXPLODED, CONTACTS).filter("_status = 'unique'")
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


@pytest.mark.parametrize("order", [("a",), ("a", "b"), ("b", "a"), ("a", "t"), ("a", "c"), ("_file_ord", "_row", "_part")])
def test_order_key_sorts_as_its_columns(spark, order):
    rng = random.Random(1)
    big = [-(2**63), -1, 0, 1, 2**63 - 1]
    data = [(rng.choice(big), rng.choice([-(2**31), -5, 0, 7, 2**31 - 1]), rng.choice(big), rng.choice("xyz"),
             rng.randrange(3), rng.choice([0, 2**62]), rng.randrange(3)) for _ in range(300)]
    df = spark.createDataFrame(data, "a bigint, b int, c bigint, t string, _file_ord int, _row bigint, _part int")
    keyed = df.withColumn("_o", dedup.order_key(df, order)).orderBy("_o").collect()
    tuples = [tuple(r[c] for c in order) for r in keyed]
    assert tuples == sorted(tuples)
    assert len({str(r["_o"]) for r in keyed}) == len(set(tuples))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_plan_and_result(spark, conf):
    """Half of all rows share one key: no shuffle partition may hold them all."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = spark.range(200_000).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("v"))
    spec = CleanseSpec(key_columns=("v",))
    routed = cleanse(df, spec, ID)
    text = plan(routed)
    assert "Window" not in text and "Sort" not in text.split("SortMergeJoin")[0]
    assert text.count("hashpartitioning(_pos") == 2
    assert "partial_min" in text and "SortAggregate" not in text
    n = {r["_status"]: r["count"] for r in routed.groupBy("_status").count().collect()}
    assert n == {"unique": 100_001, "duplicate": 99_999}
    unique = unique_rows(df, spec, ID)
    assert "WindowGroupLimit" in plan(unique) and "Partial" in plan(unique)
    assert unique.count() == 100_001


def test_rows_without_a_key_stay_spread(spark, conf):
    """Two thirds of the rows are invalid or have no key: they are grouped with nobody."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    values = F.when(F.col("id") % 3 == 0, F.lit("")).when(F.col("id") % 3 == 1, F.lit("bad-mail")).otherwise(
        F.concat((F.col("id") % 100).cast("string"), F.lit("@x.co")))
    df = spark.range(30_000).select("id", values.alias("v"), F.lit("x").alias("w"))
    spec = CleanseSpec(key_columns=("v",), validation=Validation.EMAIL)
    for routed in (cleanse(df, spec, ID), unique_rows(df, spec, ID)):
        sizes = [r["n"] for r in routed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert routed.filter("_status = 'invalid'").count() == 20_000
        assert max(sizes) < 3 * sum(sizes) / 8


def test_counts_shuffle_keys_only(spark):
    text = plan(report.bucket_counts(contacts(spark, SF), PER_SHEET, CONTACTS))
    exchanges = [line for line in text.splitlines() if "Exchange" in line]
    assert exchanges and all("score" not in line and "acctbal" not in line for line in exchanges)


def test_winners_read_keys_and_positions_only(spark, conf):
    """The pass that finds winners leaves all other columns unread."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")  # else it has run already, and only its bitmaps are in the plan
    df = spark.read.parquet(f"{SF}/documents.parquet")
    routed = cleanse(df, CleanseSpec(key_columns=("text",)), Lineage(order=("doc_id",)))
    schemas = [line.split("ReadSchema: ")[1] for line in plan(routed).splitlines() if "ReadSchema" in line]
    assert len(schemas) == 3 and {"struct<doc_id:bigint,text:string>", "struct<doc_id:bigint>"} <= set(schemas)
    both = CleanseSpec(key_mode=KeyMode.MULTIPLE, key_columns=("lang", "source"))
    slim = plan(cleanse(df, both, Lineage(order=("doc_id",), blank_rows=False)))
    assert "struct<doc_id:bigint,lang:string,source:string>" in slim


def test_blank_rows_may_be_ruled_out(spark):
    df = spark.createDataFrame([(0, "", "x"), (1, "k", "y"), (2, "K", "")], "id int, a string, b string")
    spec = CleanseSpec(key_columns=("a",))
    assert statuses(df, spec, Lineage(order=("id",), blank_rows=False)) == statuses(df, spec) == ["unique", "unique", "duplicate"]


@pytest.mark.parametrize("order", [("id",), ("id", "_part"), ("_file_ord", "_row"), ("_file_ord", "_row", "_part"), ("_row", "_file_ord")])
def test_winners_by_bitmap_equal_those_by_join(spark, conf, order):
    """Positions of any sign and distance, with a third of all rows under one key."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        place = rng.choice([i, -i - 1, i * 40_000, -i * 70_000 - 5])
        rows.append((place, i % 7, i * 33_000 if i % 3 else i, i % 4, "hot" if i % 3 == 0 else str(rng.randrange(200))))
    df = spark.createDataFrame(rows, "id bigint, _file_ord int, _row bigint, _part int, k string")
    first = dedup.winners(df, ["k"], order)
    by_bitmap = dedup.mark_first(df, first, order)
    plan = by_bitmap._jdf.queryExecution().optimizedPlan().toString()
    assert "_bits" in plan
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    by_join = dedup.mark_first(df, first, order)
    assert "_bits" not in by_join._jdf.queryExecution().optimizedPlan().toString()
    got, want = ({tuple(r) for r in x.collect()} for x in (by_bitmap, by_join))
    assert got == want and sum(r[-1] for r in got) == first.count()


def test_marking_leaves_wide_rows_where_they_are(spark):
    routed = cleanse(contacts(spark, SF), PER_SHEET, CONTACTS)
    routed.collect()
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "segment" in line]


# ---- buckets, chunks, names ----


def test_shuffled_join_equals_broadcast(spark, conf):
    df = contacts(spark, SF)
    labelled = df.withColumn("_bucket", F.when(F.col("contact_id") % 3 == 0, F.upper("sheet")).otherwise(F.col("sheet")))
    table = buckets.bucket_table(labelled, ["contact_id"])
    small = buckets.attach_bucket_names(labelled, table)
    assert "BroadcastHashJoin" in plan(small)
    want = sorted(map(str, small.collect()))
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = buckets.attach_bucket_names(labelled, table)
    assert "SortMergeJoin" in plan(joined) and "Broadcast" not in plan(joined)
    assert sorted(map(str, joined.collect())) == want
    assert {r["_bucket"] for r in joined.collect()} == {"CUSTOMERS", "Vendors"}


def test_size_of_text_at_any_depth(spark):
    df = spark.createDataFrame([(("x" * 1000, ["y" * 500]),)], "s struct<a:string,b:array<string>>")
    assert df.select(row_bytes(df)).first()[0] > 1500


@pytest.mark.parametrize("order", [[0, 1, 1], [0, None, 1]])
def test_row_order_must_be_unique_and_not_null(spark, order):
    """Otherwise rows would multiply, or all count as duplicates."""
    df = spark.createDataFrame([(i, "k") for i in order], "id int, v string")
    with pytest.raises(Exception, match="Lineage.order"):
        cleanse(df, CleanseSpec(key_columns=("v",)), Lineage(order=("id",))).collect()


@pytest.mark.parametrize("name", sorted(INTERNAL) + ["_k0", "_K12", "_RANK "])
def test_internal_names_are_refused(spark, name):
    df = spark.createDataFrame([(1, "a", "b")], ["id", "v", name])
    for work in (cleanse, unique_rows):
        with pytest.raises(SpecError):
            work(df, CleanseSpec(key_columns=("v",)), Lineage(order=("id",)))


def test_reasons_count_spellings_together(spark):
    df = spark.createDataFrame([(0, "S", "x"), (1, "s", "y"), (2, "s", "a@b.co")], "id int, sheet string, v string")
    spec = CleanseSpec(key_columns=("v",), validation=Validation.EMAIL)
    got = reason_counts(df, spec, Lineage(order=("id",), sheet="sheet")).collect()
    assert [(r["bucket"], r["n"]) for r in got] == [("S", 2)]


def test_no_single_task_over_buckets(spark):
    df = contacts(spark, SF)
    for made in (buckets.bucket_order(df.withColumn("_bucket", F.col("sheet")), ["contact_id"]), bucket_counts(df, CleanseSpec(key_columns=("email",)), CONTACTS)):
        windows = [x for x in plan(made).splitlines() if "Window " in x or "Window(" in x]
        assert not any("_bucket_pos" in w for w in windows)


@pytest.mark.parametrize("n, size, want", [(25, 10, [10, 10, 5]), (0, 10, [0]), (3, 0, [1, 1, 1]), (20, 10, [10, 10])])
def test_chunk_sizes(spark, n, size, want):
    totals = spark.createDataFrame([(n,)], "rows bigint")
    got = chunk.chunk_sizes(totals, "rows", size).orderBy("chunk").collect()
    assert [r["chunk_rows"] for r in got] == want


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_chunk_numbers(spark, conf, threshold):
    conf("spark.sql.autoBroadcastJoinThreshold", threshold)
    ids = list(range(1000))
    random.Random(3).shuffle(ids)
    df = spark.createDataFrame([(i, "ab"[i % 7 == 0]) for i in ids], "id int, g string").repartition(5)
    rows = chunk.with_chunk(df, ["id"], 64).collect()
    assert all(r["_rn"] == r["id"] + 1 and r["_chunk"] == r["id"] // 64 + 1 for r in rows) and len(rows) == 1000
    per = chunk.with_chunk(df, ["id"], 64, per="g").collect()
    for g in "ab":
        ranked = sorted((r for r in per if r["g"] == g), key=lambda r: r["id"])
        assert [r["_rn"] for r in ranked] == list(range(1, len(ranked) + 1))


def test_chunk_plan_has_no_global_window_over_rows(spark):
    text = plan(chunk.with_chunk(spark.range(1000), ["id"], 10))
    assert "Window" not in text.split("Scan parquet")[0] or "SinglePartition" not in text


def expected_names(names):
    taken, out = set(), []
    for name in names:
        base = (name or "").strip() or "Sheet"
        for c in "\\/?*[]:":
            base = base.replace(c, "_")
        base = base[:31]
        tries = [base] + [base[: 31 - len(f" ({i})")] + f" ({i})" for i in range(2, len(names) + 2)]
        given = next(t for t in tries if t.lower() not in taken)
        taken.add(given.lower())
        out.append(given)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_sheet_names(spark, seed):
    rng = random.Random(seed)
    long = "abcdefghijklmnopqrstuvwxyz"
    pool = ["a/b:c*", "A_b_c_", "x" * 40, "", "  ", None, "foo", "Foo (2)", "foo (2) (2)", "foo (3)", "foo (12)", "foo 12",
            long + "12345", long + "12399", long + "1 (2)", long + " (2)", long + "9", long[:24] + " (2) (3)", long[:24] + " (2",
            long[:24], long[:25] + " (99)"]
    names = [rng.choice(pool) for _ in range(250)]
    df = frame(spark, names).repartition(4)
    got = column(sanitize_names(df, "v", ["id"]), F.col("sheet_name"))
    assert got == expected_names(names)


def test_sheet_names_beyond_three_digits(spark):
    got = column(sanitize_names(frame(spark, ["s"] * 1205), "v", ["id"]), F.col("sheet_name"))
    assert got == expected_names(["s"] * 1205) and len(set(got)) == 1205


@pytest.mark.parametrize("block", [64])
def test_sheet_names_that_chase_each_other(spark, monkeypatch, block):
    """Numbered names on both sides of the rows that ask for their numbers, and names cut to one prefix."""
    monkeypatch.setattr("rowsieve.operators.names.BLOCK", block)
    long = "x" * 27
    names = [n for i in range(2, 120) for n in ([f"s ({i})"] if i % 3 else [f"s ({i})", "S", "s"])]
    names += [f"s ({i})" for i in range(40, 160)] + ["s"] * 90 + [f"s ({i})" for i in range(300, 2, -7)]
    names += [long + "abcd", long + " (2)", long + "efgh"] * 9 + [long + " (2)", long + " (3)", long[:26] + " (11)"] * 9
    names += ["s (1)", "s (01)", "s (2) (2)", "s (123456789012345678901234)"] * 2
    names += random.Random(7).sample(names, len(names))
    got = column(sanitize_names(frame(spark, names).repartition(3), "v", ["id"]), F.col("sheet_name"))
    assert got == expected_names(names)


def test_equal_long_names_spread(spark):
    """No row of a name leaves Spark or meets all others in one task."""
    n, name = 100_000, "A name of thirty-one characters"
    df = sanitize_names(spark.range(n).select("id", F.lit(name).alias("v")), "v", ["id"])
    plan = df._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan
    got = column(df, F.col("sheet_name"))
    numbers = [""] + [f" ({i})" for i in range(2, n + 1)]
    assert got == [name[: 31 - len(x)] + x for x in numbers]


def test_sheet_names_per_book(spark):
    rows = [(i, ("a", "b", None)[i % 3], "y" * 31 if i % 2 else "y" * 27 + " (3)") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, book string, v string")
    got = {r["id"]: r["sheet_name"] for r in sanitize_names(df, "v", ["id"], within=["book"]).collect()}
    for book in ("a", "b", None):
        mine = [r for r in rows if r[1] == book]
        assert [got[r[0]] for r in mine] == expected_names([r[2] for r in mine])


def test_sheet_names_of_one_stem_spread(spark):
    """Only names that could meet are settled together."""
    names = [f"Report {i // 2:06}" for i in range(20_000)]
    df = sanitize_names(frame(spark, names), "v", ["id"])
    got = column(df, F.col("sheet_name"))
    assert got[:4] == ["Report 000000", "Report 000000 (2)", "Report 000001", "Report 000001 (2)"]
    assert len(set(got)) == 20_000


@pytest.mark.parametrize(
    "pattern, name, want",
    [("Data*", "data 2024", True), ("*2024", "Data 2024", True), ("*2024", "2024 b", False), ("Sheet?", "Sheet1", False),
     ("Sheet?", "sheet?", True), (" x ", "X", True), ("a.*", "abc", False), ("a\\E*", "a\\Eb", True), ("", "x", False)],
)
def test_patterns(spark, pattern, name, want):
    assert column(frame(spark, [name]), matches_any(F.col("v"), [pattern])) == [want]


# ---- spec ----


def test_spec_checks():
    with pytest.raises(SpecError):
        CleanseSpec(key_mode=KeyMode.ROW, validation=Validation.EMAIL).check()
    with pytest.raises(SpecError):
        CleanseSpec(destination=Destination.IN_PLACE, chunking=Chunking.PER_SHEET).check()
    with pytest.raises(SpecError):
        CleanseSpec(emit_unique=False).check()
    assert CleanseSpec(key_columns=("a",), validation=Validation.EMAIL).effective_validation_column == "a"
