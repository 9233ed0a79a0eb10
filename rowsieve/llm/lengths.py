"""Exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.llm.arrow import map_rows
from rowsieve.llm.tables import written
from rowsieve.llm.tokens import default_tokenizer, encoder

RUN = 32


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): documents by number of token ids, written once.

    Every row of ``docs`` counts, repeated rows each; null and empty texts have no tokens.
    An empty table gives no rows. Lengths are counted before the shuffle, so what moves is
    one row per task and distinct length.
    """
    path = tokenizer or default_tokenizer()

    def setup():
        encode = encoder(path).encode
        return lambda rows: [(len(ids) // 4,) for ids in encode([t for (t,) in rows])]

    lengths = map_rows(docs.select("text"), setup, "n_tokens long")
    return written(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")


def length_report(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit:

    ``docs_at_least`` and ``tokens_at_least`` (documents of that length or more),
    ``tokens_truncated`` (all tokens if each document is cut to the limit), ``docs_at_most``
    and ``quantile`` (share of documents of that length or less).

    Suffix sums in two steps: within runs of lengths, then over the totals of runs.
    """
    rows = histogram.select(
        "n_tokens",
        "n_docs",
        (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
        F.floor(F.col("n_tokens") / RUN).alias("run"),
    )
    totals = rows.groupBy("run").agg(F.sum("n_docs").alias("run_docs"), F.sum("tokens").alias("run_tokens"))
    after = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = totals.select(
        "run",
        F.coalesce(F.sum("run_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("run_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("run_docs").over(everything).alias("docs"),
        F.sum("run_tokens").over(everything).alias("tokens_all"),
    )
    down = Window.partitionBy("run").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(totals, "run")
        .withColumns(
            {
                "docs_at_least": F.sum("n_docs").over(down) + F.col("docs_after"),
                "tokens_at_least": F.sum("tokens").over(down) + F.col("tokens_after"),
            }
        )
        .withColumns(
            {
                "tokens_truncated": F.col("tokens_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"),
                "docs_at_most": F.col("docs") - F.col("docs_at_least") + F.col("n_docs"),
            }
        )
        .withColumn("quantile", F.col("docs_at_most") / F.col("docs"))
        .select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "tokens_truncated", "docs_at_most", "quantile")
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_cut, tokens) for any given limits, from the histogram alone."""
    sums = [F.sum(F.least("n_tokens", F.lit(x)) * F.col("n_docs")) for x in limits]
    cut = [F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs")).otherwise(0)) for x in limits]
    answers = [
        F.struct(F.lit(x).alias("context"), F.coalesce(c, F.lit(0)).alias("docs_cut"), F.coalesce(s, F.lit(0)).alias("tokens"))
        for x, c, s in zip(limits, cut, sums, strict=True)
    ]
    return histogram.agg(F.array(*answers).alias("rows")).select(F.inline("rows"))


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that this share of documents does not exceed."""
    report = length_report(histogram)
    answers = [
        F.struct(F.lit(x).alias("share"), F.min(F.when(F.col("quantile") >= x, F.col("n_tokens"))).alias("n_tokens"))
        for x in shares
    ]
    return report.agg(F.array(*answers).alias("rows")).select(F.inline("rows"))
