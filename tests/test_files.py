"""Reading and writing files."""

import csv
import io
import os
import random
import zipfile
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from rowsieve import Chunking, CleanseSpec, Destination, OutputFormat, SheetMode, Validation
from rowsieve.plans.fixtures import CONTACTS, contacts, workbook_bytes
from rowsieve.plans.queries import PER_SHEET
from rowsieve.plans.run import outcomes, run
from rowsieve.session import scratch_root, stage
from rowsieve.sinks.inplace import replace_in_place
from rowsieve.sinks.write import CSV_OPTIONS, write_run
from rowsieve.sources import records as record_source
from rowsieve.sources.csv import first_record
from rowsieve.sources.files import ROW_BITS
from rowsieve.sources.records import UNCLOSED, cells_of, find_records, line_pieces, width_classes
from rowsieve.sources.read import read_sources, scan_headers
from rowsieve.spec import FILE_LINEAGE, SpecError
from rowsieve.streaming.incremental import run_incremental


def write(folder, name, text):
    path = folder / name
    path.write_text(text, newline="")
    return str(path)


def data(rows, *names):
    ordered = rows.orderBy("_file_ord", "_sheet_ord", "_row")
    return [tuple(r) for r in ordered.select(*names).collect()]


def test_csv_headers_that_differ(spark, tmp_path):
    a = write(tmp_path, "a.csv", 'Name, Email ,Name\r\n"x, ""q""\r\nz",x@y.co,dup\r\n')
    b = write(tmp_path, "b c+1.CSV", "﻿EMAIL,,age\n e@f.co ,skip,7\n")
    write(tmp_path, "ignored.txt", "Name\nno\n")
    sources = read_sources(spark, [b, a, a])
    assert sources.columns == ["EMAIL", "age", "Name"]
    assert data(sources.rows, "EMAIL", "age", "Name") == [(" e@f.co ", "7", None), ("x@y.co", None, 'x, "q"\nz')]
    assert [r["header"] for r in scan_headers(sources.headers).orderBy("first_at").collect()] == ["EMAIL", "age", "Name"]


def test_many_headers_in_one_scan(spark, tmp_path):
    paths = [write(tmp_path, f"f{i:02}.csv", f"id,c{i},C{(i + 1) % 5}\n{i},a{i},b{i}\n{i},d{i}\n") for i in range(5)]
    rows = read_sources(spark, paths).rows
    got = data(rows, "id", "c0", "c1", "c4")
    assert got[:4] == [("0", "a0", "b0", None), ("0", "d0", None, None), ("1", None, "a1", None), ("1", None, "d1", None)]
    assert got[8] == ("4", "b4", None, "a4")


def small_splits(conf):
    conf("spark.sql.files.maxPartitionBytes", str(1 << 20))
    conf("spark.sql.files.openCostInBytes", str(1 << 20))


def test_order_across_splits(spark, tmp_path, conf):
    """A file larger than a split is read by several tasks and keeps its row order."""
    small_splits(conf)
    lines = [f'{i},"{"x" * 40}",5" pipe' for i in range(90_000)]
    path = write(tmp_path, "big.csv", "id,pad,note\n" + "\n".join(lines) + "\n")
    rows = read_sources(spark, [path]).rows
    assert rows.select(F.shiftright("_row", ROW_BITS)).distinct().count() > 3
    ordered = rows.orderBy("_row").select(F.col("id").cast("int").alias("id"), "note").collect()
    assert [r["id"] for r in ordered] == list(range(90_000)) and {r["note"] for r in ordered} == {'5" pipe'}
    conf("spark.sql.files.openCostInBytes", "1000")
    with pytest.raises(ValueError):
        read_sources(spark, [path])


def random_cell(rng):
    kind = rng.randrange(7)
    if kind == 0:
        return ""
    if kind == 1:
        return "a,b" * rng.randrange(1, 3)
    if kind == 2:
        return "\n".join(rng.choice(["", "x", 'say "hi"', '"', ",", '","', 'end"', '"start', "p,q"]) for _ in range(rng.randrange(2, 6)))
    if kind == 3:
        return 'quote " inside'
    return "plain" * rng.randrange(1, 4)


def scan_cells(spark, path, width):
    return cells_of(find_records(spark, [path])[0].withColumn("_width", F.lit(width)), [width])


@pytest.mark.parametrize("seed", range(3))
def test_records_over_many_lines(spark, tmp_path, conf, seed):
    """Records found by many tasks equal those of a sequential reader."""
    small_splits(conf)
    rng = random.Random(seed)
    data_rows = [[str(i), *(random_cell(rng) for _ in range(3))] for i in range(30_000)]
    data_rows[15_000][1] = "\n".join(f'line {i}, "{i}"' for i in range(150_000))  # a cell larger than two splits
    data_rows[20_000][2] = 'x"y,' * 400_000
    data_rows[20_001][3] = "a,\n" + '"",' * 200_000
    path = tmp_path / "big.csv"
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["id", "two\nlines", "c", "d"])
        out.writerows(data_rows)
    rows = scan_cells(spark, str(path), 4).orderBy("_row").select("_cells").collect()
    got = [[c or "" for c in r["_cells"]] for r in rows]
    assert len(got) == len(data_rows)
    assert all(g == w for g, w in zip(got, data_rows))


def test_lines_of_a_split_are_not_shuffled(spark, tmp_path, conf, monkeypatch):
    """Lines are joined where they are read; only what crosses a split is put together by a shuffle."""
    small_splits(conf)
    count, plans = 60_000, []

    def watched(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, path)

    monkeypatch.setattr(record_source, "stage", watched)
    path = write(tmp_path, "big.csv", "id,note\n" + "".join(f'{i},"say ""{"x" * 30}"",\nplain\n{i}"\n' for i in range(count)))
    records, broken, staged = find_records(spark, [path])
    assert len(plans) == 1 and "Exchange" not in plans[0] and "Window" not in plans[0]
    pieces = spark.read.parquet(staged)
    splits = pieces.select(F.shiftright("_row", ROW_BITS)).distinct().count()
    assert splits > 2 and pieces.count() <= 1 + count + 4 * splits
    assert broken.isEmpty() and records.count() == count
    cells = cells_of(records.withColumn("_width", F.lit(2)), [2]).orderBy("_row").select("_cells").collect()
    assert [r["_cells"] for r in cells] == [[str(i), f'say "{"x" * 30}",\nplain\n{i}'] for i in range(count)]


def batches_of(lines, size):
    """``lines`` as (path, row, text, code) in batches of ``size``."""
    for i in range(0, len(lines), size):
        path, row, text, code = zip(*lines[i:i + size])
        yield pa.RecordBatch.from_arrays(
            [pa.array(path), pa.array(row, pa.int64()), pa.array(text), pa.array(code, pa.int32()), pa.array([t.strip() != "" for t in text])],
            ["_path", "_row", "_line", "_code", "_filled"],
        )


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_pieces_do_not_depend_on_batches(size):
    """Codes: 0 ends outside a cell, 1 inside, 2 leaves the state, 3 flips it."""
    at = 1 << ROW_BITS
    lines = [("file:///a%20b.csv", 0, "p", 2), ("file:///a%20b.csv", 1, '"q', 3), ("file:///a%20b.csv", 2, "r", 2)]
    lines += [("file:///a%20b.csv", 3, 's","', 1), ("file:///a%20b.csv", 4, "", 2), ("file:///a%20b.csv", 5, 't"', 0)]
    lines += [("file:///a%20b.csv", 6, " ", 2), ("file:///a%20b.csv", 7, '"open', 1), ("file:///a%20b.csv", at + 8, "u", 2)]
    lines += [("file:/c.csv", at + 9, 'v"', 0), ("file:/c.csv", at + 10, '"w', 3), ("file:/c.csv", at + 11, 'x"', 0)]
    names = ["_file", "_row", "_line", "_lines", "_length", "_filled", "_before", "_after"]

    def found(max_record):
        return [tuple(r[n] for n in names) for b in line_pieces(batches_of(lines, size), max_record) for r in b.to_pylist()]

    want = [
        ("file:/a b.csv", 0, "p", 1, 2, True, 2, 2), ("file:/a b.csv", 1, '"q', 1, 3, True, 2, 3),
        ("file:/a b.csv", 2, "r", 1, 2, True, 3, 3), ("file:/a b.csv", 3, 's","\n\nt"', 3, 9, True, 3, 0),
        ("file:/a b.csv", 6, " ", 1, 2, False, 0, 0), ("file:/a b.csv", 7, '"open', 1, 6, True, 0, 1),
        ("file:/a b.csv", at + 8, "u", 1, 2, True, 2, 2), ("file:/c.csv", at + 9, 'v"', 1, 3, True, 2, 0),
        ("file:/c.csv", at + 10, '"w\nx"', 2, 6, True, 0, 0),
    ]
    assert found(100) == want
    assert [r[:2] + r[3:] for r in found(5)] == [r[:2] + r[3:] for r in want]  # a text may be left out, its length is not


def test_first_record_reads_on():
    long = "y" * 100_000
    assert first_record(io.BytesIO(f'"a\n{long}",b\n1,2\n'.encode())) == [f"a\n{long}", "b"]
    assert first_record(io.BytesIO(b"\n\nx,y\n")) == ["x", "y"]
    assert first_record(io.BytesIO(b"")) == []


def test_empty_files(spark, tmp_path):
    a = write(tmp_path, "a.csv", "")
    b = write(tmp_path, "b.csv", "id\n")
    c = write(tmp_path, "c.csv", "id\n1\n , \n")
    assert data(read_sources(spark, [a, b, c]).rows, "id", "_file_ord")[0] == ("1", 2)


def test_workbook_cells(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c><c r="D1" t="str"><v>flag</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3" s="1"><v>45292</v></c><c r="D3" t="b"><v>1</v></c></row>'
        '<row r="4"><c r="A4"><v>1E3</v></c><c r="C4" s="2"><v>45292.5</v></c><c r="D4"><v>0.1</v></c></row>'
    )
    path = tmp_path / "t.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="r9" Target="/xl/worksheets/odd.xml"/></Relationships>')
        z.writestr("xl/worksheets/odd.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>na</t><rPh><t>zz</t></rPh></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr(
            "xl/styles.xml",
            f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;m&quot;hh"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        )
    sources = read_sources(spark, [str(path)])
    assert sources.columns == ["na", "when", "flag"]
    assert data(sources.rows, "na", "when", "flag") == [("rich", "2024-01-01", "True"), ("1000", "2024-01-01 12:00:00", "0.1")]


def test_dates_that_count_from_1904(spark, tmp_path):
    plain = workbook_bytes({"S": [["day"], ["x"]]})
    with zipfile.ZipFile(io.BytesIO(plain)) as old, zipfile.ZipFile(tmp_path / "t.xlsx", "w") as new:
        for member in old.namelist():
            text = old.read(member).decode()
            if member == "xl/workbook.xml":
                text = text.replace("<sheets>", '<workbookPr date1904="1"/><sheets>')
            if "sheets/" in member and "_rels" not in member:
                text = text.replace("</sheetData>", '<row><c s="1"><v>1</v></c></row></sheetData>')
            new.writestr(member, text)
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        new.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    assert data(read_sources(spark, [str(tmp_path / "t.xlsx")]).rows, "day") == [("x",), ("1904-01-02",)]


def test_sheet_selection(spark, tmp_path):
    sheets = {n: [["id"], [i]] for i, n in enumerate(["Data 1", "Other", "data 2"])}
    (tmp_path / "w.xlsx").write_bytes(workbook_bytes(sheets))
    picks = lambda **o: [r[0] for r in data(read_sources(spark, [str(tmp_path / "w.xlsx")], CleanseSpec(**o)).rows, "_sheet")]
    assert picks() == ["Data 1", "Other", "data 2"]
    assert picks(sheets=SheetMode.FIRST_N, first_n=0) == ["Data 1"]
    assert picks(sheets=SheetMode.BY_NAME, sheet_patterns=("DATA*", " ")) == ["Data 1", "data 2"]
    none = read_sources(spark, [str(tmp_path / "w.xlsx")], CleanseSpec(sheets=SheetMode.BY_NAME))
    assert none.rows is None and [r["header"] for r in scan_headers(none.headers).collect()] == ["id"]


def test_csv_bucket_is_the_file_name(spark, tmp_path):
    a = write(tmp_path, "Vendors.2024.csv", "id\n1\n1\n")
    spec = CleanseSpec(key_columns=("id",), output_dir=str(tmp_path / "out"))
    result = run(spark, [a], spec, name="x")
    assert [r["_bucket"] for r in spark.read.parquet(f"{result.path}/unique").collect()] == ["Vendors.2024"]
    assert (result.rows_read, result.duplicate_rows) == (2, 1)


@pytest.mark.parametrize("chunking, folders", [(Chunking.PER_SHEET, "_bucket=Vendors/_chunk=2"), (Chunking.MERGED_SHEETS, "_chunk=2")])
def test_chunked_output(spark, tmp_path, chunking, folders):
    spec = replace(PER_SHEET, chunking=chunking, chunk_rows=20)
    result = write_run(contacts(spark, SF), spec, CONTACTS, str(tmp_path / "out"))
    assert (result.rows_read, result.unique_rows, result.duplicate_rows, result.invalid_rows) == (150, 71, 11, 96)
    assert spark.read.parquet(f"{result.path}/unique/{folders}").count() <= 20
    sizes = [r["rows"] for r in spark.read.parquet(f"{result.path}/manifest").collect()]
    assert sum(sizes) == 71 and max(sizes) == 20


def test_output_keeps_source_order(spark, tmp_path):
    spec = replace(PER_SHEET, format=OutputFormat.CSV, keep_sheets=False)
    write_run(contacts(spark, SF), spec, CONTACTS, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "unique").glob("part-*.csv"))
    got = [line.split(",")[-3] for p in parts for line in p.read_text().splitlines()[1:]]
    assert got == sorted(got) and len(got) == 63


def test_empty_bucket_has_a_header(spark, tmp_path):
    spec = CleanseSpec(key_columns=("email",), validation=Validation.EMAIL, format=OutputFormat.CSV, emit_duplicates=True)
    df = contacts(spark, SF).filter("email = '@bad.com'")
    write_run(df, spec, CONTACTS, str(tmp_path / "out"))
    for folder in ("unique", "duplicates"):
        back = spark.read.options(**CSV_OPTIONS).csv(str(tmp_path / "out" / folder))
        columns = ["email", "name", "segment", "score"] + (["_bucket"] if folder == "unique" else [])
        assert back.columns[-len(columns):] == columns and back.count() == 0


IN_PLACE = CleanseSpec(
    key_columns=("email",), destination=Destination.IN_PLACE, validation=Validation.EMAIL, emit_duplicates=True, emit_invalid=True
)


def test_in_place(spark, tmp_path):
    a = write(tmp_path, "a.csv", "email,n\nx@y.co,1\nX@Y.co,2\nbad-mail,3\nz@y.co,4\n")
    b = write(tmp_path, "b.csv", "email,n\nx@y.co,5\n")
    c = write(tmp_path, "c.csv", "email,n\nnope,6\n")
    rows = read_sources(spark, [a, b, c], IN_PLACE).rows
    counts = {(r["file"].rsplit("/", 1)[1], r["status"]): r["rows"] for r in replace_in_place(spark, rows, IN_PLACE).collect()}
    assert counts == {("a.csv", "unique"): 2, ("a.csv", "duplicate"): 1, ("a.csv", "invalid"): 1, ("b.csv", "unique"): 1, ("c.csv", "invalid"): 1}
    assert (tmp_path / "a.csv").read_text() == "email,n\nx@y.co,1\nz@y.co,4\n"
    assert (tmp_path / "b.csv").read_text() == "email,n\nx@y.co,5\n"
    assert (tmp_path / "c.csv").read_text() == "email,n\n"
    assert (tmp_path / "a_Duplicates.csv").read_text() == "_Source,email,n\na,X@Y.co,2\n"
    assert (tmp_path / "a_Invalid.csv").read_text() == "_Source,_Reason,email,n\na,'email' is not a valid email format,bad-mail,3\n"
    assert (tmp_path / "a.csv.bak").read_text().startswith("email,n\nx@y.co,1\nX@Y.co,2")


def test_in_place_leaves_nothing_when_it_fails(spark, tmp_path):
    path = write(tmp_path, "a.csv", "email\nx@y.co\n")
    rows = read_sources(spark, [path], IN_PLACE).rows
    before = set(os.listdir(scratch_root(spark)))
    with pytest.raises(Exception):
        replace_in_place(spark, rows.unionByName(rows), IN_PLACE, lineage=replace(FILE_LINEAGE, order=("_row",)), keep_backup=False,
                         rules=[lambda value, name: F.raise_error(F.lit("no"))])
    assert {x for x in set(os.listdir(scratch_root(spark))) - before if x.startswith("rowsieve-inplace")} == set()
    assert os.listdir(tmp_path) == ["a.csv"]


def test_in_place_refuses_workbooks(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook_bytes({"S": [["email"], ["a@b.co"]]}))
    rows = read_sources(spark, [str(tmp_path / "w.xlsx")], IN_PLACE).rows
    with pytest.raises(SpecError):
        replace_in_place(spark, rows, IN_PLACE)
    assert (tmp_path / "w.xlsx").exists()


def test_incremental(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    spec = CleanseSpec(key_columns=("email",), output_dir=str(tmp_path / "out"))
    seen = []
    go = lambda: run_incremental(spark, str(folder), spec, str(tmp_path / "cp"), seen.append)
    write(folder, "a.csv", "email\nx@y.co\nx@y.co\n")
    go()
    write(folder, "b.csv", "mail,email\n1,x@y.co\n")
    go()
    go()
    assert [(r.rows_read, r.unique_rows, r.duplicate_rows) for r in seen] == [(2, 1, 1), (1, 1, 0)]


def test_incremental_call_is_one_run(spark, tmp_path, monkeypatch):
    """More files than a batch holds meet in one run, which a failure does not lose."""
    folder = tmp_path / "in"
    folder.mkdir()
    spec = CleanseSpec(key_columns=("email",), keep_sheets=False, output_dir=str(tmp_path / "out"))
    seen = []
    go = lambda: run_incremental(spark, str(folder), spec, str(tmp_path / "cp"), seen.append, max_files=1)
    for k in range(3):
        write(folder, f"{k}.csv", f"email\nx@y.co\n{k}@y.co\n")
    with monkeypatch.context() as broken:
        broken.setattr("rowsieve.streaming.incremental.run", lambda *_, **__: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            go()
    go()
    go()
    write(folder, "3.csv", "email\nx@y.co\n")
    go()
    assert [(r.rows_read, r.unique_rows, r.duplicate_rows) for r in seen] == [(6, 4, 2), (1, 1, 0)]


def test_in_place_run(spark, tmp_path):
    a = write(tmp_path, "a.csv", "email,n\nx@y.co;z@y.co,1\n , \nX@y.co,2\n")
    spec = CleanseSpec(key_columns=("email",), destination=Destination.IN_PLACE, explode_multi=True)
    result = run(spark, [a], spec)
    assert (result.rows_read, result.unique_rows, result.duplicate_rows) == (2, 2, 1)
    assert (tmp_path / "a.csv").read_text() == "email,n\nx@y.co,1\nz@y.co,1\n"


def test_sheet_without_rows_is_listed(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook_bytes({"Empty": [["id"]], "Full": [["id"], ["1"], ["1"]]}))
    spec = CleanseSpec(key_columns=("id",), output_dir=str(tmp_path / "out"))
    result = run(spark, [str(tmp_path / "w.xlsx")], spec, name="x")
    counts = spark.read.parquet(f"{result.path}/counts").orderBy("bucket_ord").collect()
    assert [(r["bucket"], r["rows_read"], r["unique_rows"]) for r in counts] == [("Empty", 0, 0), ("Full", 2, 1)]
    listed = spark.read.parquet(f"{result.path}/manifest").orderBy("bucket_ord").collect()
    assert [(r["name"], r["rows"]) for r in listed] == [("Empty", 0), ("Full", 1)]


@pytest.mark.parametrize("fmt", list(OutputFormat))
def test_awkward_headers(spark, tmp_path, fmt):
    a = write(tmp_path, "a.csv", "Full Name (x),a.b,`t`;=,e mail\nAnn,1,2,a@b.co\nBob,,,A@B.co\n")
    b = write(tmp_path, "b.csv", "A.B,full name (X)\n7,Zoe\n")
    spec = CleanseSpec(key_columns=("E Mail",), keep_sheets=False, output_dir=str(tmp_path / "out"), format=fmt, emit_duplicates=True)
    result = run(spark, [a, b], spec, name="x")
    assert (result.rows_read, result.unique_rows, result.duplicate_rows) == (3, 2, 1)
    reader = spark.read.options(**CSV_OPTIONS) if fmt is OutputFormat.CSV else spark.read
    back = reader.format(fmt.value).load(f"{result.path}/unique")
    assert back.columns == ["Full Name (x)", "a.b", "`t`;=", "e mail"]
    assert sorted(r[0:2] for r in map(tuple, back.collect())) == [("Ann", "1"), ("Zoe", "7")]


def test_reserved_headers_are_refused(spark, tmp_path):
    with pytest.raises(SpecError):
        read_sources(spark, [write(tmp_path, "a.csv", "id,_row\n1,2\n")])


def test_shuffles_grow_with_the_input(spark):
    from rowsieve.session import sized_shuffles

    before = spark.conf.get("spark.sql.shuffle.partitions")
    with sized_shuffles(spark, 10 << 40):
        assert spark.conf.get("spark.sql.shuffle.partitions") == str((10 << 40) // (1 << 30))
    with sized_shuffles(spark, 1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_separate_files_keep_their_sheet_name(spark, tmp_path):
    spec = replace(PER_SHEET, chunking=Chunking.SEPARATE_FILES, chunk_rows=30)
    result = write_run(contacts(spark, SF), spec, CONTACTS, str(tmp_path / "Processed_1"))
    listed = spark.read.parquet(f"{result.path}/manifest").orderBy("chunk").collect()
    assert [(r["file"], r["sheet_name"], r["rows"]) for r in listed] == [
        ("Processed_1_part01", "Unique", 30), ("Processed_1_part02", "Unique", 30), ("Processed_1_part03", "Unique", 11)
    ]


@pytest.mark.parametrize("fmt, chunks", [(OutputFormat.PARQUET, 1), (OutputFormat.CSV, 7)])
def test_splitting_sheets_that_are_not_kept(spark, tmp_path, fmt, chunks):
    spec = replace(PER_SHEET, keep_sheets=False, chunking=Chunking.PER_SHEET, chunk_rows=10, format=fmt)
    result = write_run(contacts(spark, SF), spec, CONTACTS, str(tmp_path / "out"))
    assert spark.read.parquet(f"{result.path}/manifest").count() == chunks
    assert len(list((tmp_path / "out" / "unique").glob("_chunk=*"))) == (chunks if chunks > 1 else 0)


def test_a_sheet_that_breaks_off(spark, tmp_path):
    """The run goes on; the broken file gives no rows at all."""
    from rowsieve.plans.run import outcomes

    good = workbook_bytes({"S": [["id"], ["1"]], "T": [["id"], ["2"]]})
    (tmp_path / "good.xlsx").write_bytes(good)
    with zipfile.ZipFile(io.BytesIO(good)) as old, zipfile.ZipFile(tmp_path / "bad.xlsx", "w") as new:
        for member in old.namelist():
            text = old.read(member).decode()
            if member.endswith("sheet2.xml"):
                text = text.replace("</sheetData>", "<row><c><v>3</v></broken>")
            new.writestr(member, text)
    sources = read_sources(spark, [str(tmp_path / "bad.xlsx"), str(tmp_path / "good.xlsx")])
    assert data(sources.rows, "id", "_sheet") == [("1", "S"), ("2", "T")]
    found = {r["file"].rsplit("/", 1)[1]: (r["status"], r["rows_read"]) for r in outcomes(sources).collect()}
    assert found == {"bad.xlsx": ("Failed", 0), "good.xlsx": ("Processed", 2)}


def test_run_without_a_readable_file(spark, tmp_path):
    (tmp_path / "x.xlsx").write_text("no workbook")
    spec = CleanseSpec(key_columns=("id",), output_dir=str(tmp_path / "out"))
    result = run(spark, [str(tmp_path / "x.xlsx"), str(tmp_path / "gone.csv")], spec, name="r")
    assert result.rows_read == 0
    assert {r["status"] for r in spark.read.parquet(f"{result.path}/files").collect()} == {"Failed"}
    with pytest.raises(SpecError):
        run(spark, [], spec)


@pytest.mark.parametrize("split", [1 << 20, 128 << 20])
def test_one_reader_for_every_size(spark, tmp_path, conf, split):
    """Cells do not depend on whether a file is larger than a split."""
    conf("spark.sql.files.maxPartitionBytes", str(split))
    conf("spark.sql.files.openCostInBytes", str(1 << 20))
    body = b'\xef\xbb\xbfid,a,b\r\n1,"x\ry",q"r\r\n   \r\n2,"l1\r\nl2\n""l3""",\r\n'
    body += b"".join(b'%d,"pad ""%s""",z\n' % (i, b"p" * 60) for i in range(3, 30_000))
    (tmp_path / "a.csv").write_bytes(body)
    got = data(read_sources(spark, [str(tmp_path / "a.csv")]).rows, "id", "a", "b")
    assert got[:2] == [("1", "x\ny", 'q"r'), ("2", 'l1\nl2\n"l3"', None)]
    assert len(got) == 29_999 and got[-1] == ("29999", f'pad "{"p" * 60}"', "z")


@pytest.mark.parametrize("name", ["Data[1].csv", "a%20b.csv", "100% a%20b ü+.csv", "q?{x}*.csv", "a#b.csv"])
def test_awkward_file_names(spark, tmp_path, name):
    path = write(tmp_path, name, "id\n1\n2\n")
    sources = read_sources(spark, [path])
    assert data(sources.rows, "id") == [("1",), ("2",)]
    assert [(r["status"], r["rows_read"]) for r in outcomes(sources).collect()] == [("Processed", 2)]


def test_files_that_are_left_out_are_named(spark, tmp_path):
    paths = [write(tmp_path, n, "id\n1\n") for n in ("_x.csv", "A.csv", "a.csv")]
    found = {r["file"].rsplit("/", 1)[1]: (r["status"], r["rows_read"]) for r in outcomes(read_sources(spark, paths)).collect()}
    assert found == {"_x.csv": ("Failed", 0), "A.csv": ("Processed", 1), "a.csv": ("Skipped", 0)}


def test_wide_files(spark, tmp_path):
    header = ",".join(f"c{i}" for i in range(20_600))
    path = write(tmp_path, "wide.csv", f"{header}\n{','.join(['1'] * 20_600)}\n")
    assert scan_cells(spark, path, 20_600).select(F.size("_cells")).first()[0] == 20_600


def test_a_wide_file_beside_narrow_ones(spark, tmp_path):
    """Each record is parsed at about the width of its own file."""
    assert width_classes([0, 1, 2, 9, 10, 16, 20_500]) == [1, 2, 16, 20_500]
    header = ",".join(f"c{i}" for i in range(600))
    paths = [write(tmp_path, "wide.csv", f"{header}\n{','.join(map(str, range(600)))}\n")]
    paths += [write(tmp_path, f"n{i}.csv", f"id,c{i}\n{i},\"x\ny\"\n{i},z,over\n") for i in range(3)]
    records, broken, _ = find_records(spark, paths)
    assert broken.isEmpty()
    sized = records.withColumn("_width", F.when(F.endswith("_file", F.lit("wide.csv")), 600).otherwise(2))
    found = cells_of(sized, [2, 600]).groupBy(F.size("_cells").alias("n")).count().collect()
    assert {r["n"]: r["count"] for r in found} == {2: 6, 600: 1}
    rows = read_sources(spark, paths).rows
    assert data(rows, "c0", "c2", "c599", "id") == [
        ("0", "2", "599", None), ("x\ny", None, None, "0"), ("z", None, None, "0"), (None, None, None, "1"),
        (None, None, None, "1"), (None, "x\ny", None, "2"), (None, "z", None, "2"),
    ]


def test_an_unclosed_quote_fails_its_file(spark, tmp_path, conf):
    """The lines after it never meet in one task; other files are read."""
    small_splits(conf)
    body = "".join(f"{i},plain\n" for i in range(200_000))
    bad = write(tmp_path, "bad.csv", 'id,note\n0,"whole\ncell"\n1,"open\n' + body)
    head = write(tmp_path, "head.csv", 'id,"note\n1,x\n')
    good = write(tmp_path, "good.csv", 'id,note\n7,"two\nlines"\n')
    sources = read_sources(spark, [bad, good, head])
    assert data(sources.rows, "id", "note") == [("7", "two\nlines")]
    found = {r["file"].rsplit("/", 1)[1]: (r["status"], r["message"]) for r in outcomes(sources).collect()}
    assert found["bad.csv"] == found["head.csv"] == ("Failed", UNCLOSED) and found["good.csv"][0] == "Processed"
    assert [r["_file"].rsplit("/", 1)[1] for r in sources.sheets.collect()] == ["good.csv"]
    records, broken, _ = find_records(spark, [good], max_record=10)
    assert "more than 10" in broken.first()["_broken"] and records.isEmpty()


def test_incremental_never_reads_its_output(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "a.csv", "email\nx@y.co\ny@y.co\nz@y.co\n")
    seen = []
    spec = CleanseSpec(key_columns=("email",), format=OutputFormat.CSV)
    for _ in range(3):
        run_incremental(spark, str(folder), spec, str(tmp_path / "cp"), seen.append)
    assert [r.rows_read for r in seen] == [3]
    inside = replace(spec, output_dir=str(folder / "out"))
    for _ in range(2):
        run_incremental(spark, str(folder), inside, str(tmp_path / "cp2"), seen.append)
    assert [r.rows_read for r in seen] == [3, 3]
    with pytest.raises(SpecError):
        run_incremental(spark, str(folder), IN_PLACE, str(tmp_path / "cp3"))


def test_in_place_keeps_a_file_a_file(spark, tmp_path, monkeypatch):
    """Also where its rows are written in many parts; it stays the same bucket."""
    monkeypatch.setattr("rowsieve.sinks.inplace.PIECE_BITS", 3)
    body = "".join(f'{i}@y.co,"{i},\nx"\n' for i in range(100))
    path = write(tmp_path, "large.csv", "email,n\n" + body + body)
    spec = CleanseSpec(key_columns=("email",), destination=Destination.IN_PLACE, emit_duplicates=True)
    replace_in_place(spark, read_sources(spark, [path], spec).rows, spec)
    assert (tmp_path / "large.csv").read_text() == "email,n\n" + body
    assert (tmp_path / "large_Duplicates.csv").read_text().count("large,") == 100
    assert not list(tmp_path.glob(".rowsieve*"))


def test_result_tells_failures_and_missing_columns(spark, tmp_path):
    a = write(tmp_path, "a.csv", "id\n1\n1\n")
    spec = CleanseSpec(key_columns=("mail",), output_dir=str(tmp_path / "out"))
    result = run(spark, [a, str(tmp_path / "gone.csv")], spec, name="x")
    assert not result.success and "gone.csv" in result.error and result.elapsed > 0
    assert result.missing_columns == ("mail",) and result.unique_rows == 2
    said = {r["status"]: r["message"] for r in spark.read.parquet(f"{result.path}/files").collect()}
    assert said == {"Processed": "Column not found: 'mail'", "Failed": "File not found"}
    good = run(spark, [a], replace(spec, key_columns=("id",)), name="y")
    assert good.success and good.error is None and good.missing_columns == ()


def test_audit_tables_are_listed(spark, tmp_path):
    spec = replace(PER_SHEET, emit_duplicates=True, emit_invalid=True)
    for name, wanted in (("Processed_1", spec), ("Processed_2", replace(spec, emit_unique=False))):
        result = write_run(contacts(spark, SF), wanted, CONTACTS, str(tmp_path / name))
        listed = {r["sheet_name"]: r["rows"] for r in spark.read.parquet(f"{result.path}/manifest").collect()}
        assert listed["Duplicates"] == result.duplicate_rows and listed["Invalid"] == result.invalid_rows
        assert len(listed) == (4 if wanted.emit_unique else 2)


def test_a_single_table_is_the_run_itself(spark, tmp_path):
    spec = CleanseSpec(key_columns=("email",), keep_sheets=False, format=OutputFormat.CSV)
    for name, wanted, file in (
        ("Processed_1", spec, "Processed_1.csv"),
        ("Processed_2", replace(spec, emit_duplicates=True), "Processed_2_Unique.csv"),
    ):
        result = write_run(contacts(spark, SF), wanted, CONTACTS, str(tmp_path / name))
        assert file in {r["file"] for r in spark.read.parquet(f"{result.path}/manifest").collect()}


def test_nothing_is_left_behind(spark, tmp_path):
    left = lambda: set(os.listdir(scratch_root(spark)))
    a = write(tmp_path, "a.csv", "id\n1\n1\n")
    before = left()
    run(spark, [a], CleanseSpec(key_columns=("id",), output_dir=str(tmp_path / "out")), name="x")
    with pytest.raises(Exception):
        run(spark, [a], CleanseSpec(key_columns=("id",), output_dir=str(tmp_path / "out")), name="x")
    assert {x for x in left() - before if x.startswith("rowsieve-")} == set()


def test_progress(spark, tmp_path):
    steps = []
    spec = replace(PER_SHEET, emit_duplicates=True, emit_invalid=True)
    write_run(contacts(spark, SF), spec, CONTACTS, str(tmp_path / "out"), progress=lambda *step: steps.append(step))
    assert steps == [("routed", 178), ("unique", 71), ("duplicates", 11), ("invalid", 96)]
