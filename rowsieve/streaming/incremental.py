"""Runs that take only files not seen by an earlier run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowsieve.plans.run import run
from rowsieve.session import drop_path, hadoop_path
from rowsieve.sources.files import literal, plain_path
from rowsieve.spec import CleanseSpec, Destination, SpecError

OUTPUT = "_processed"
LISTING_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


MAX_FILES = 10_000


def new_files(spark: SparkSession, folder: str, max_files: int = MAX_FILES) -> DataFrame:
    """Stream of the paths of files as they appear; their content is not read."""
    listing = (
        spark.readStream.format("binaryFile")
        .schema(LISTING_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .load(literal(folder))
    )
    return listing.select("path")


def run_incremental(
    spark: SparkSession,
    folder: str,
    spec: CleanseSpec,
    checkpoint: str,
    on_run: Callable | None = None,
    max_files: int = MAX_FILES,
) -> None:
    """Process the files of ``folder`` not yet processed under ``checkpoint``, then stop.

    All new files of a call are one run; keys of earlier runs are not remembered. Batches
    of at most ``max_files`` files only note the paths beside the checkpoint's own files.
    The output is named after the first batch, and paths stay noted until their run is
    done, so a run repeated after a failure replaces its own output.

    Output is never read as input: by default it goes to a folder whose name readers
    pass over, and files below the output folder are left out. Sources replaced in
    place would look new again, so that is refused.
    """
    if spec.destination is Destination.IN_PLACE:
        raise SpecError("incremental runs cannot replace their sources")
    output = spec.output_dir or f"{folder.rstrip('/')}/{OUTPUT}"
    spec = replace(spec, output_dir=output)
    store, path = hadoop_path(spark, output)
    below = plain_path(F.lit(store.makeQualified(path).toString().rstrip("/") + "/"))

    noted = f"{checkpoint.rstrip('/')}/rowsieve"

    def note(batch: DataFrame, batch_id: int) -> None:
        found = batch.filter(~F.startswith(plain_path(F.col("path")), below))
        found.write.mode("overwrite").parquet(f"{noted}/paths/{batch_id}")

    query = (
        new_files(spark, folder, max_files)
        .writeStream.foreachBatch(note)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    done = max(_numbers(spark, f"{noted}/done"), default=-1)
    batches = [k for k in sorted(_numbers(spark, f"{noted}/paths")) if k > done]
    if batches:
        listed = spark.read.schema("path string").parquet(*(f"{noted}/paths/{k}" for k in batches))
        paths = sorted(r["path"] for r in listed.distinct().collect())
        if paths:
            result = run(spark, paths, spec, name=f"batch_{batches[0]:010d}", mode="overwrite")
        # The mark comes first: what it covers is done, also if it cannot be dropped.
        store, mark = hadoop_path(spark, f"{noted}/done/{batches[-1]}")
        store.mkdirs(mark)
        for k in batches:
            drop_path(spark, f"{noted}/paths/{k}")
        if paths and on_run:
            on_run(result)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The names of what is in ``folder``, which are numbers."""
    store, path = hadoop_path(spark, folder)
    return [int(f.getPath().getName()) for f in store.listStatus(path)] if store.exists(path) else []
