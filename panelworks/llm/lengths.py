"""Exact token-length histogram: one aggregate answers totals for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .tokens import DEFAULT, encoder

#: Lengths are summed up in runs of this many, then run by run.
RUN = 1024


def lengths(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """``doc_id, length``: the number of ids of each whole text (null: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                tool.warm(texts)
                found = [sum(len(x) for x in tool.encode(text)) // 4 for text in texts]
                yield pa.record_batch([part.column(0), pa.array(found, pa.int64())], names=["doc_id", "length"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {ids}, length bigint")


def histogram(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """``length, n_docs, tokens, docs_from, tokens_from, truncated_total, share_to``, a row per length that occurs.

    ``docs_from`` and ``tokens_from`` are suffix sums (documents of that length
    or more, and their tokens); ``truncated_total`` is the corpus' total if each
    document is cut to ``length`` tokens; ``share_to`` is the share of documents
    no longer, so that a quantile q is the least length with share_to >= q.
    Null and empty texts have length 0; an empty table gives no rows.
    """
    counts = table(lengths(docs, path).groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")
    counts = counts.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("run", F.expr(f"length div {RUN}"))
    totals = counts.groupBy("run").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("run", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"), F.sum("d").over(every).alias("all_d"), F.sum("t").over(every).alias("all_t"))
    within = Window.partitionBy("run").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = counts.join(totals, "run").select(
        "length", "n_docs", "tokens", "all_d", "all_t", (F.sum("n_docs").over(within) + F.col("d")).alias("docs_from"), (F.sum("tokens").over(within) + F.col("t")).alias("tokens_from")
    )
    return out.select(
        "length",
        "n_docs",
        "tokens",
        "docs_from",
        "tokens_from",
        (F.col("all_t") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"),
        ((F.col("all_d") - F.col("docs_from") + F.col("n_docs")) / F.col("all_d")).alias("share_to"),
    )


def answers(hist: DataFrame, limits: list[int]) -> DataFrame:
    """``context, whole_docs, truncated_tokens``: for each limit, documents that fit and the tokens left after cutting."""
    if len(limits) > 1000:
        raise ValueError("ask for at most 1000 limits at a time")
    context = F.explode(F.array(*(F.lit(int(x)).cast("bigint") for x in limits)))
    fit = F.col("length") <= F.col("context")
    return hist.select("length", "n_docs", context.alias("context")).groupBy("context").agg(
        F.sum(F.when(fit, F.col("n_docs")).otherwise(0)).alias("whole_docs"),
        F.sum(F.least("length", "context") * F.col("n_docs")).alias("truncated_tokens"),
    )
