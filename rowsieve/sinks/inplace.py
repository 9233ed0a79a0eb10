"""Replacing CSV sources by their cleaned rows."""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowsieve.operators.columns import REASON, SOURCE, col_ref
from rowsieve.operators.hygiene import PART
from rowsieve.operators.route import BUCKET, DUPLICATE, INVALID, STATUS, UNIQUE, cleanse, user_columns
from rowsieve.session import checkpointed, dropped, hadoop_path, scratch_path, stage
from rowsieve.sinks.write import CSV_OPTIONS
from rowsieve.sources.files import task_count
from rowsieve.spec import FILE_LINEAGE, CleanseSpec, Destination, Lineage, SpecError

PIECE_BITS = 20  # rows of a file that stay together in one output part
COPY_BYTES = 8 << 20


class InPlaceError(RuntimeError):
    """The cleaned copy does not hold the rows it should; no source was touched."""


def write_by_file(rows: DataFrame, columns, path: str) -> int:
    """One folder per source file, rows in source order; returns the rows written.

    Up to a million rows of a file form one part, larger files several, which are put
    together afterwards: no task has to sort a whole large file.
    """
    piece = F.shiftright("_row", PIECE_BITS)
    placed = (
        rows.withColumn("_piece", piece)
        .repartitionByRange("_file_ord", "_piece")
        .sortWithinPartitions("_file_ord", "_row", PART)
        .select(*columns, "_file_ord")
    )
    placed.write.options(**CSV_OPTIONS | {"header": False}).partitionBy("_file_ord").csv(path)
    return rows.count()


def header_line(columns: list[str]) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(columns)
    return out.getvalue().encode()


def join_parts(spark: SparkSession, files: list[tuple[str, str]], header: bytes) -> None:
    """Put the parts of each folder together as one plain file, whatever its size.

    ``files`` are (folder of parts without header, target). A task copies one file piece
    by piece, so it needs little memory; a folder that is missing gives the header alone.
    """

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, target in zip(batch["folder"], batch["target"]):
                store, root = filesystem(folder)
                found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
                parts = sorted(f.path for f in found if f.base_name.startswith("part-"))
                place = filesystem(target)[1]
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(place, compression=None) as out:
                    out.write(header)
                    for part in parts:
                        with store.open_input_stream(part, compression=None) as source:
                            while piece := source.read(COPY_BYTES):
                                out.write(piece)
            yield batch[["target"]]

    wanted = spark.createDataFrame(files, "folder string, target string")
    wanted.repartition(task_count(spark, len(files))).mapInPandas(copy, "target string").count()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub("^file:/+", "/", path)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def swap(spark: SparkSession, new: str, target: str, backup: str | None) -> None:
    """Put the file ``new`` where ``target`` is."""
    store, target_path = hadoop_path(spark, target)
    _, new_path = hadoop_path(spark, new)
    _, backup_path = hadoop_path(spark, backup or f"{target}.{uuid.uuid4().hex}.old")
    existed = store.exists(target_path)
    if existed and not store.rename(target_path, backup_path):
        raise InPlaceError(f"cannot set {target} aside")
    if not store.rename(new_path, target_path):
        if existed:
            store.rename(backup_path, target_path)
        raise InPlaceError(f"cannot replace {target}")
    if existed and backup is None:
        store.delete(backup_path, True)


def replace_in_place(spark: SparkSession, rows: DataFrame, spec: CleanseSpec, keep_backup: bool = True, rules=(), lineage: Lineage = FILE_LINEAGE) -> DataFrame:
    """Replace each source of ``rows`` (from ``read_sources``) by its unique rows.

    Every file is deduplicated on its own, all files in one job. The cleaned rows
    are written beside the sources and counted before any source is renamed.
    Duplicates and invalid rows go to ``<name>_Duplicates.csv`` and
    ``<name>_Invalid.csv``. Returns rows per file and status.
    """
    if spec.destination is not Destination.IN_PLACE:
        raise SpecError("the spec does not ask for replacing sources in place")
    spec.check()
    files = checkpointed(rows.select("_file", "_file_ord").distinct()).collect()
    if any(not f["_file"].lower().endswith(".csv") for f in files):
        raise SpecError("only CSV files are replaced in place")
    folder = min(f["_file"].rsplit("/", 1)[0] for f in files)
    root = f"{folder}/.rowsieve-{uuid.uuid4().hex}"

    scratch = scratch_path(spark, "inplace")
    with dropped(spark, scratch, root):
        routed = stage(cleanse(rows, spec, lineage, rules), scratch)
        columns = [col_ref(c) for c in user_columns(routed, lineage)]
        plans = [(UNIQUE, columns, "")]
        if spec.emit_duplicates:
            plans.append((DUPLICATE, [F.col(BUCKET).alias(SOURCE), *columns], f"_{spec.duplicates_name}"))
        if spec.emit_invalid:
            plans.append((INVALID, [F.col(BUCKET).alias(SOURCE), F.col(REASON), *columns], f"_{spec.invalid_name}"))
        counts = routed.groupBy("_file", "_file_ord", STATUS).agg(
            F.count("*").alias("rows"), F.count_if(F.col(PART) == 0).alias("read")
        )
        counted = counts.collect()
        swaps = []
        for status, wanted, suffix in plans:
            part = routed.filter(F.col(STATUS) == status)
            written = write_by_file(part, wanted, f"{root}/{status}")
            if written:
                schema = routed.select(*wanted).schema
                text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
                back = spark.read.schema(text).options(**CSV_OPTIONS | {"header": False}, multiLine=True)
                read = back.csv(f"{root}/{status}").count()
                if read != written:
                    raise InPlaceError(f"{status}: wrote {written} rows, read back {read}")
            whole = []
            for f in files:
                base = f["_file"][: -len(".csv")]
                target = f["_file"] if status == UNIQUE else f"{base}{suffix}.csv"
                new = f"{root}/whole/{status}/{f['_file_ord']}.csv"
                whole.append((f"{root}/{status}/_file_ord={f['_file_ord']}", new))
                swaps.append((new, target, f"{target}.bak" if keep_backup and status == UNIQUE else None))
            join_parts(spark, whole, header_line(routed.select(*wanted).columns))
        with ThreadPoolExecutor(8) as pool:
            list(pool.map(lambda s: swap(spark, *s), swaps))
    return spark.createDataFrame(
        [(c["_file"], c[STATUS], c["rows"], c["read"]) for c in counted],
        "file string, status string, rows bigint, rows_read bigint",
    )
