"""Input files: listing, admission and reading parts of them inside tasks."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowsieve.functions.names import extension
from rowsieve.functions.text import is_blank
from rowsieve.operators.small import conf_bytes
from rowsieve.operators.dedup import keep_first
from rowsieve.session import qualified

# File types that are read.
CSV_EXTENSIONS = (".csv",)
WORKBOOK_EXTENSIONS = (".xlsx", ".xlsm")

SAME_NAME = "Another file differs in upper and lower case only"

BLOCK_BITS, ROW_BITS = 20, 33  # a block starts at a multiple of a mebibyte
FILES_SCHEMA = "path string, length bigint, file_ord int"


def admit(paths: DataFrame, path: str, order) -> DataFrame:
    """Paths worth reading: not blank, of a known type, and each only once (without case)."""
    known = extension(F.col(path)).isin(*CSV_EXTENSIONS, *WORKBOOK_EXTENSIONS)
    wanted = paths.filter(~is_blank(F.col(path)) & known)
    return keep_first(wanted.withColumn("_path_key", F.lower(path)), ["_path_key"], order).drop("_path_key")


def given_order(path: str, order: dict[str, int]) -> int:
    """Place in the given list of the entry that ``path`` is, or lies in."""
    while path not in order and "/" in path:
        path = path.rsplit("/", 1)[0]
    return order.get(path, len(order))


def extension_of(path: str) -> str | None:
    """The path's extension if files of that type are read."""
    return next((e for e in (*CSV_EXTENSIONS, *WORKBOOK_EXTENSIONS) if path.lower().endswith(e)), None)


def hidden(path: str) -> bool:
    """Names that Spark's readers pass over, wherever they are given."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.startswith((".", "_"))


def list_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """(``path``, ``file_ord``, ``length`` of admitted files, given paths that are not read and why).

    Files come in the order of ``paths``, inside a folder by path. Only the
    listing is read: ``content`` is never selected. The list of files is plan
    input, as for every file scan, so it passes through the driver.
    """
    given = list(dict.fromkeys(p for p in paths if p and p.strip()))
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(lambda p: qualified(spark, p), given))
    left = {p: "File not found" for p, q in zip(given, found) if q is None}
    left |= {q: "Names that begin with . or _ are not read" for q in found if q and hidden(q)}
    present = [q for q in found if q is not None and not hidden(q)]
    if not present:
        return spark.createDataFrame([], FILES_SCHEMA), left
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([literal(p) for p in present])
    order = {q: i for i, q in enumerate(present)}
    listed = [(r["path"], r["length"], given_order(r["path"], order)) for r in listing.select("path", "length").collect()]
    seen = {i for _, _, i in listed}
    listed += [(q, 0, i) for q, i in order.items() if i not in seen and extension_of(q)]  # empty files
    frame = spark.createDataFrame(listed, FILES_SCHEMA)
    admitted = admit(frame, "path", ["file_ord", "path"]).collect()
    admitted.sort(key=lambda r: (r["file_ord"], r["path"]))
    numbered = [(r["path"], r["length"], i) for i, r in enumerate(admitted)]
    taken = {r["path"] for r in admitted}
    left |= {p: SAME_NAME for p, _, _ in listed if p not in taken and extension_of(p)}
    return spark.createDataFrame(numbered, FILES_SCHEMA), left


def literal(path: str) -> str:
    """``path`` for a reader that takes patterns: every character stands for itself."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def task_count(spark: SparkSession, items: int) -> int:
    """Tasks for work that comes in ``items`` independent pieces."""
    return max(1, min(items, spark.sparkContext.defaultParallelism * 8))


def open_input(path: str):
    """A seekable stream on ``path``, opened inside a task."""
    scheme, _, rest = path.partition(":/") if re.match(r"[a-z0-9+.-]+:/", path) else ("", "", path)
    if scheme in ("", "file"):
        return open("/" + rest.lstrip("/") if scheme else path, "rb")
    from pyarrow import fs

    uri = "s3" + path[len(scheme):] if scheme in ("s3a", "s3n") else path
    filesystem, inner = fs.FileSystem.from_uri(uri)
    return filesystem.open_input_file(inner)


def plain_path(path: Column) -> Column:
    """One spelling for local paths, which Spark gives as file:/x or file:///x."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def plain_name(path: str) -> str:
    """The scanned file's path, as ``plain_path`` spells it, from what ``_metadata.file_path`` gives."""
    return re.sub("^file:/+", "file:/", unquote(path))


def row_position(spark: SparkSession, splittable: bool) -> Column:
    """Place of a row in its file, for a column read straight from the scan.

    A task numbers the rows of a file, or of one split of it, in order. Splits
    start at least a mebibyte apart, so their start leads and the number follows.
    """
    number = F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)
    if not splittable:
        return number
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        if conf_bytes(spark, name) < 1 << BLOCK_BITS:
            raise ValueError(f"{name} must be at least 1 MiB to read split CSV files in order")
    block = F.shiftright(F.col("_metadata.file_block_start"), BLOCK_BITS)
    return F.shiftleft(block, ROW_BITS).bitwiseOR(number)
