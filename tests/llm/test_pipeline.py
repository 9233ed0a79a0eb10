"""The pipeline stage by stage, and the queries that are registered."""

import re

import corpus_pipeline
import duckdb
import pytest
from helpers import SF, documents

import __spark_entry__ as entry_points
from rowsieve.llm import decontaminate, pii, quality, queries, simhash
from rowsieve.llm.tables import table

TABLES = ("documents", "pages", "benchmark", "labels")


def test_registered():
    names = entry_points.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES} == {str(k) for k in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert set(queries.ORACLE_SQL) <= set(entry_points.oracle_sql())
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_stages(spark):
    """What each stage leaves of its own input."""
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near copies", "decontamination", "personal data", "packing"]
    first = stages["quality rules"](spark, docs, SF)
    model = quality.fit_quality(docs, table(spark, SF, "labels"))
    kept = {r.doc_id for r in quality.judge_quality(docs, model).where("kept").collect()}
    assert {r.doc_id for r in first.collect()} == kept and 0 < len(kept) < docs.count()

    second = stages["near copies"](spark, first, SF)
    groups = simhash.near_duplicates(first, simhash.SIMILAR).collect()
    assert {r.doc_id for r in second.collect()} == {r.component_id for r in groups}

    third = stages["decontamination"](spark, second, SF)
    bad = {r.doc_id for r in decontaminate.contaminated(second, table(spark, SF, "benchmark")).collect()}
    assert bad and {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect()} - bad

    fourth = stages["personal data"](spark, third, SF)
    assert fourth.count() == third.count()
    assert all(x.schema == docs.schema for x in (first, second, third, fourth))
    assert pii.find_pii(fourth).where("n_email + n_ip + n_card + n_phone > 0").count() == 0

    packed = stages["packing"](spark, fourth, SF).collect()
    whole = corpus_pipeline.run(spark, SF).collect()
    # Which of equally long pieces gets which place is not fixed; the pieces are.
    pieces = lambda rows: sorted(r[:5] for r in rows)
    assert pieces(packed) == pieces(whole)
    assert {r.doc_id for r in packed} == {r.doc_id for r in third.collect()}


def test_awkward_rows(spark, tmp_path):
    """All stages over nulls, ties, repeats and clashing names, and over no rows."""
    spark.createDataFrame([(3, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = " ".join(f"word{k}" for k in range(80))
    more = [(20, good), (21, good), (20, good), (None, good + " x"), (22, good + " one two three four five")]
    from helpers import AWKWARD

    docs = documents(spark, AWKWARD + more)
    for rows in (docs, docs.limit(0)):
        at = rows
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, str(tmp_path))
            if name != "packing":
                assert at.schema == docs.schema
            at.collect()
