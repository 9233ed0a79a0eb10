"""The corpus pipeline: stages that each take and leave documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowsieve.llm.decontaminate import drop_contaminated
from rowsieve.llm.packing import pack
from rowsieve.llm.pii import mask_pii
from rowsieve.llm.quality import fit_quality, keep_quality
from rowsieve.llm.simhash import SIMILAR, keep_first
from rowsieve.llm.tables import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, repeated rows are judged alike."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; a null doc_id comes last."""
    return keep_first(docs, SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay, an empty benchmark drops nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their personal data masked; null and empty texts stay as they are."""
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of the documents in a sequence; repeated rows are packed each."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near copies", near_copies),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packing),
]

#: The first stage trains a model and the last encodes, so SQL cannot tell the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read by the next.

    Up to the last stage the columns are those of the documents, whatever further ones there
    are; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
