"""The two-workbook case and the expected counts on the contact list."""

from dataclasses import replace

import pytest

from rowsieve import CleanseSpec, KeyMode, SheetMode, Validation, cleanse
from rowsieve.operators import report
from rowsieve.plans.fixtures import CONTACTS, contacts, workbook_bytes
from rowsieve.plans.queries import CHECKED, EMAIL, EXPLODED, PER_SHEET
from rowsieve.plans.run import outcomes, run
from rowsieve.sources.read import read_sources
from rowsieve.spec import FILE_LINEAGE

HEADER = ["email", "name", "score"]
MAIN, SECOND = "Valid+BasicCheck+DEA", "CatchAll_AcceptAll"
BOOK_A = {
    MAIN: [
        HEADER,
        ["alice@example.com", "Alice", 92],
        ["BOB@Example.COM", "Bob", 81],
        ["alice@example.com", "Alice-2", 70],
        ["not-an-email", "Broken", 55],
        ["", "Empty", 0],
        ["carol@example.com", "Carol", 88],
    ],
    SECOND: [HEADER, ["dave@example.com", "Dave", 77]],
    "Ignored": [HEADER, ["should-not-appear@nope.com", "Noise", 0]],
}
BOOK_B = {
    MAIN: [
        HEADER,
        ["eve@example.com", "Eve", 95],
        ["bob@example.com", "BobDup", 60],
        ["@bad.com", "Bad", 0],
    ],
    SECOND: [HEADER, ["frank@example.com", "Frank", 85]],
}
GOLDEN = CleanseSpec(
    sheets=SheetMode.BY_NAME,
    sheet_patterns=(MAIN, SECOND),
    key_columns=("email",),
    validation=Validation.EMAIL | Validation.NOT_EMPTY,
)


@pytest.fixture
def books(tmp_path):
    (tmp_path / "sample_a.xlsx").write_bytes(workbook_bytes(BOOK_A))
    (tmp_path / "sample_b.xlsx").write_bytes(workbook_bytes(BOOK_B))
    return [str(tmp_path / "sample_a.xlsx"), str(tmp_path / "sample_b.xlsx")]


def totals(df, spec, lineage):
    return tuple(report.run_totals(df, spec, lineage).first())


@pytest.mark.parametrize("keep_sheets", [True, False])
def test_golden_counts(spark, books, keep_sheets):
    spec = replace(GOLDEN, keep_sheets=keep_sheets)
    sources = read_sources(spark, books, spec)
    assert sources.columns == HEADER
    assert totals(sources.rows, spec, FILE_LINEAGE) == (11, 6, 2, 3)


def test_golden_winners(spark, books):
    rows = cleanse(read_sources(spark, books, GOLDEN).rows, GOLDEN, FILE_LINEAGE).collect()
    by = {s: {r["name"] for r in rows if r["_status"] == s} for s in ("unique", "duplicate", "invalid")}
    assert by["unique"] == {"Alice", "Bob", "Carol", "Dave", "Eve", "Frank"}
    assert by["duplicate"] == {"Alice-2", "BobDup"}
    reasons = sorted(r["_Reason"] for r in rows if r["_Reason"])
    assert reasons == ["'email' is empty"] + ["'email' is not a valid email format"] * 2
    assert next(r["score"] for r in rows if r["name"] == "Alice") == "92"


def test_order_of_files_decides(spark, books):
    rows = cleanse(read_sources(spark, books[::-1], GOLDEN).rows, GOLDEN, FILE_LINEAGE)
    dups = {r["name"] for r in rows.filter("_status = 'duplicate'").collect()}
    assert dups == {"Alice-2", "Bob"}


def test_no_options(spark, books):
    sources = read_sources(spark, books)
    assert totals(sources.rows, CleanseSpec(), FILE_LINEAGE) == (12, 12, 0, 0)


def test_run_writes_all(spark, books, tmp_path):
    spec = replace(GOLDEN, output_dir=str(tmp_path / "out"), emit_duplicates=True, emit_invalid=True)
    result = run(spark, books, spec, name="r1")
    assert (result.rows_read, result.unique_rows, result.duplicate_rows, result.invalid_rows) == (11, 6, 2, 3)
    unique = spark.read.parquet(f"{result.path}/unique")
    assert {r["_bucket"] for r in unique.collect()} == {MAIN, SECOND}
    assert spark.read.parquet(f"{result.path}/unique/_bucket={MAIN}").columns == HEADER
    assert spark.read.parquet(f"{result.path}/duplicates").columns == ["_Source", *HEADER]
    assert spark.read.parquet(f"{result.path}/invalid").columns == ["_Source", "_Reason", *HEADER]
    listed = spark.read.parquet(f"{result.path}/manifest").orderBy("bucket_ord").collect()
    assert [(r["sheet_name"], r["rows"]) for r in listed] == [(MAIN, 4), (SECOND, 2), ("Duplicates", 2), ("Invalid", 3)]


def test_outcomes(spark, books, tmp_path):
    (tmp_path / "broken.xlsx").write_text("this is no workbook")
    (tmp_path / "c.csv").write_text("Email\nzoe@example.com\n")
    paths = [*books, str(tmp_path / "broken.xlsx"), str(tmp_path / "gone.csv"), str(tmp_path / "c.csv"), str(tmp_path / "notes.txt")]
    (tmp_path / "notes.txt").write_text("x")
    spec = CleanseSpec(sheets=SheetMode.BY_NAME, sheet_patterns=("ignored",))
    found = {r["file"].rsplit("/", 1)[1]: r for r in outcomes(read_sources(spark, paths, spec)).collect()}
    assert {k: v["status"] for k, v in found.items()} == {
        "sample_a.xlsx": "Processed",
        "sample_b.xlsx": "Skipped",
        "broken.xlsx": "Failed",
        "gone.csv": "Failed",
        "c.csv": "Processed",
    }
    assert found["sample_a.xlsx"]["rows_read"] == 1 and found["c.csv"]["rows_read"] == 1
    assert found["gone.csv"]["message"] == "File not found"


# Configurations A to G: read, unique, duplicate, invalid at sf 0.001 and 0.01.
COUNTS = {
    "A": (EMAIL, (150, 125, 25, 0), (1500, 742, 758, 0)),
    "B": (CHECKED, (150, 54, 0, 96), (1500, 97, 448, 955)),
    "C": (EXPLODED, (150, 63, 19, 96), (1500, 97, 720, 955)),
    "D": (PER_SHEET, (150, 71, 11, 96), (1500, 192, 625, 955)),
    "E": (replace(EXPLODED, case_sensitive=True), (150, 68, 14, 96), (1500, 194, 623, 955)),
    "F": (replace(EMAIL, key_mode=KeyMode.MULTIPLE, key_columns=("email", "segment")), (150, 97, 53, 0), (1500, 620, 880, 0)),
    "G": (replace(CHECKED, key_mode=KeyMode.NONE), (150, 54, 0, 96), (1500, 545, 0, 955)),
}


@pytest.mark.parametrize("name", COUNTS)
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_contact_counts(spark, name, sf):
    spec, small, large = COUNTS[name]
    want = small if sf == "0.001" else large
    df = contacts(spark, f"/root/testdata/sf{sf}")
    assert totals(df, spec, CONTACTS) == want
    rows = cleanse(df, spec, CONTACTS)
    n = {r["_status"]: r["count"] for r in rows.groupBy("_status").count().collect()}
    assert (n.get("unique", 0), n.get("duplicate", 0), n.get("invalid", 0)) == want[1:]
