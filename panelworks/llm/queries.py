"""The registered queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitslice, decontaminate, html_text, language, lengths, packing, pii, quality, simhash, toxicity
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


#: The key of the registered query and of the pipeline where the session sets none.
KEY = "panelworks-demonstration-key"


def pii_key(spark: SparkSession) -> str:
    """The key of pseudonyms: the session's ``spark.panelworks.pii.key``, or one for demonstration."""
    return spark.conf.get("spark.panelworks.pii.key", KEY)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(read(spark, sf_dir, "documents"), pii_key(spark))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op6_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.histogram(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontaminate, op2_html, op3_pii, op4_quality, op5_topk, op6_lengths, op7_simhash, op8_packing, op9_toxicity, op10_language)}


OP5 = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, r.vec_id, coalesce(list_sum([q.c[i] * r.c[i] FOR i IN range(1, len(q.c) + 1)]), 0) AS score
  FROM v q JOIN v r ON q.row <> r.row AND len(q.c) = len(r.c) WHERE q.vec_id % 100 = 0
), t AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM t WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": OP5}
