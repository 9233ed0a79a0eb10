"""SimHash fingerprints of texts and the groups that their links make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.arrow import map_rows
from rowsieve.llm.components import components
from rowsieve.llm.similar import SIMILAR, Similar, classes
from rowsieve.llm.tables import written
from rowsieve.llm.tries import CLOSE, Linking, fingerprint, links, trie_pairs  # noqa: F401  part of this module's face
from rowsieve.session import checkpointed


def fingerprints(docs: DataFrame, linking: Linking = CLOSE) -> DataFrame:
    """(doc_id, text_hash, fingerprint) of every row; a null text has no words."""

    def setup():
        return lambda rows: [(i, h, fingerprint(t, linking.width, linking.lanes, linking.once)) for i, h, t in rows]

    columns = docs.select("doc_id", F.xxhash64("text"), "text")
    return map_rows(columns, setup, "doc_id long, text_hash long, fingerprint string")


def _classes(docs: DataFrame, linking: Linking | Similar) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprints, and distinct fingerprints with root and first row.

    Fingerprints are made once and written. Each distinct one takes part in the join once,
    so exact copies cost nothing there.
    """
    if isinstance(linking, Similar):
        return classes(docs, linking)
    rows = written(fingerprints(docs, linking), "fingerprints")
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")).alias("first")
    found = rows.groupBy("fingerprint").agg(least)
    roots = components(links(found.select("fingerprint"), linking)).withColumnRenamed("node", "fingerprint")
    rooted = found.join(roots, "fingerprint", "left")
    return rows, rooted.withColumn("root", F.coalesce("root", "fingerprint"))


def near_duplicates(docs: DataFrame, linking: Linking | Similar = CLOSE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, the row's own included. Equal
    fingerprints are linked. Rows of a null doc_id get their component but never name one;
    it is null if no row in it has an id. Empty and null texts have one fingerprint (zero
    for ``Linking``) and are linked like any other. Repeated rows all appear, in one component.
    """
    rows, found = _classes(docs, linking)
    least = checkpointed(found.groupBy("root").agg(F.min("first.doc_id").alias("component_id")))
    named = found.join(least, "root").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, linking: Linking | Similar = SIMILAR) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, columns as they are.

    Repeated rows (equal doc_id and text) leave one. A null doc_id comes last.
    """
    rows, found = _classes(docs, linking)
    first = found.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    times = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    first = first.join(times, [first[c].eqNullSafe(times[c]) for c in ("doc_id", "text_hash")]).select(
        first["doc_id"].alias("_doc_id"), first["text_hash"].alias("_text_hash"), F.col("times").alias("_times")
    )
    held = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    found = held.join(
        first,
        F.col("row.doc_id").eqNullSafe(F.col("_doc_id")) & (F.xxhash64("row.text") == F.col("_text_hash")),
    )
    once = found.where("_times = 1").select("row")
    again = found.where("_times > 1").groupBy("_doc_id", "_text_hash").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(again).select("row.*")
