"""Inputs that Spark derives from the given tables: a contact list and files made of it."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from rowsieve.session import hadoop_path
from rowsieve.sinks.inplace import filesystem
from rowsieve.sinks.write import CSV_OPTIONS
from rowsieve.spec import Lineage

# Runs as it is in Spark SQL and in other SQL engines, over the table customer.
CONTACT_COLUMNS = (
    "c_custkey AS contact_id",
    "CASE WHEN c_nationkey % 2 = 0 THEN 'Customers' ELSE 'Vendors' END AS sheet",
    """CASE c_custkey % 11
         WHEN 0 THEN ''
         WHEN 1 THEN '   '
         WHEN 2 THEN 'not-an-email'
         WHEN 3 THEN 'User' || CAST(c_custkey % 97 AS STRING) || '@Example.COM'
         WHEN 4 THEN ' user' || CAST(c_custkey % 97 AS STRING) || '@example.com '
         WHEN 5 THEN 'user' || CAST(c_custkey % 97 AS STRING) || '@example.com; user'
                     || CAST(c_custkey % 89 AS STRING) || '@example.com|bad'
         WHEN 6 THEN 'user' || CAST(c_custkey % 97 AS STRING) || '@example.com;'
         WHEN 7 THEN '@bad.com'
         WHEN 8 THEN NULL
         ELSE 'user' || CAST(c_custkey % 97 AS STRING) || '@example.com' END AS email""",
    "c_name AS name",
    "c_mktsegment AS segment",
    "c_acctbal AS score",
)
CONTACTS = Lineage(order=("contact_id",), sheet="sheet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*CONTACT_COLUMNS)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV_OPTIONS).csv(path)


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A minimal workbook: per sheet a list of rows, the first one being the header."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        names = list(sheets)
        tabs = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)
        )
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{tabs}</sheets></workbook>')
        links = "".join(
            f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml" Type="{rel}/worksheet"/>'
            for i in range(1, len(names) + 1)
        )
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">{links}</Relationships>')
        for i, name in enumerate(names, 1):
            rows = "".join(f"<row>{''.join(_cell(v) for v in row)}</row>" for row in sheets[name])
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, str):
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
    return f"<c><v>{value!r}</v></c>"


def write_workbooks(df: DataFrame, folder: str, sheet: str) -> None:
    """One workbook per partition of ``df``, one sheet per value of ``sheet`` (derived test input)."""
    spark = df.sparkSession
    fs, path = hadoop_path(spark, folder)
    fs.mkdirs(path)
    target = fs.makeQualified(path).toString()
    columns = [c for c in df.columns if c != sheet]

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        pdf = pd.concat(list(batches))
        if len(pdf):
            sheets = {}
            for name, rows in pdf.groupby(sheet, sort=True):
                cells = rows[columns].astype(object).where(rows[columns].notna(), None)
                sheets[name] = [columns, *cells.values.tolist()]
            part = TaskContext.get().partitionId()
            store, root = filesystem(target)
            with store.open_output_stream(f"{root}/book-{part:05d}.xlsx", compression=None) as f:
                f.write(workbook_bytes(sheets))
        yield pd.DataFrame({"rows": [len(pdf)]})

    df.mapInPandas(write, "rows bigint").write.format("noop").mode("overwrite").save()
