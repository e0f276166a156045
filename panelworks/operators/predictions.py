"""The rules of saved predictions, as one aggregation per shard and per origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, iso
from ..functions.identity import effective_seed_column
from .forecast import AMOUNT_ESTIMATED, AMOUNT_GIVEN, FORBIDDEN, KEY, PREDICTION_COLUMNS, ForecastConfig, ShardError

#: Columns that have one value in a shard.
CONSTANT = [
    "model", "seed", "split", "logical_shard_id", "effective_seed", "model_id", "model_revision", "tokenizer_id", "tokenizer_revision",
    "implementation_revision", "temperature", "top_p", "top_k", "sample_count", "output_semantics", "batch_elapsed_seconds",
]
FINITE = ["predicted_close", "current_close", "score", "batch_elapsed_seconds"]


def check_columns(df: DataFrame) -> None:
    """Label-like or missing columns raise without a job."""
    if bad := sorted({c.lower() for c in df.columns} & FORBIDDEN):
        raise ShardError(f"label-like columns: {bad}")
    if missing := [c for c in PREDICTION_COLUMNS if c not in df.columns]:
        raise ShardError(f"missing columns: {missing}")


def _one_value(c: str, kind: str) -> Column:
    """Exactly one value, where NaN is null and null a value of its own."""
    x = F.nanvl(F.col(c), F.lit(None)) if kind == "double" else F.col(c)
    nulls = F.count(F.when(x.isNull(), 1))
    return ((F.min(x).eqNullSafe(F.max(x))) & ((nulls == 0) | (nulls == F.count(F.lit(1))))).alias(c)


def violations(df: DataFrame, config: ForecastConfig | None = None) -> DataFrame:
    """``logical_shard_id, rule, n`` for each rule that a shard's rows break, with how often.

    ``config`` adds what the rows must say about their model, and the tags under
    which shard ids and seeds are worked out anew.
    """
    check_columns(df)
    config = config or ForecastConfig()
    kinds = dict(df.dtypes)
    df = df.select(*PREDICTION_COLUMNS)
    n = lambda test: F.count_if(F.coalesce(test, F.lit(True)))
    said = {k: getattr(config, k) for k in ("model", "temperature", "top_p", "top_k", "sample_count", "model_id", "model_revision", "tokenizer_id", "tokenizer_revision", "implementation_revision", "output_semantics")}
    shard = df.groupBy("logical_shard_id").agg(
        n(F.array_contains(F.array(*(~finite(F.col(c)) for c in FINITE)), True)).alias("finite"),
        n((F.col("predicted_close") <= 0) | (F.col("current_close") <= 0)).alias("positive_prices"),
        n(F.col("batch_elapsed_seconds") < 0).alias("elapsed"),
        F.when(F.array_contains(F.array(*(F.coalesce(_one_value(c, kinds[c]), F.lit(False)) for c in CONSTANT)), False), 1).otherwise(0).alias("constant"),
        n(F.array_contains(F.array(*(~F.col(k).eqNullSafe(F.lit(v)) for k, v in said.items())), True)).alias("metadata"),
        n(~F.col("amount_source").isin(AMOUNT_GIVEN, AMOUNT_ESTIMATED)).alias("amount_source"),
        n(~F.col("input_end").eqNullSafe(F.col("origin"))).alias("input_end"),
        n(F.col("effective_seed") != effective_seed_column(F.col("seed"), F.col("logical_shard_id"), config.seed_tag)).alias("effective_seed"),
    )
    origin = df.groupBy("logical_shard_id", "model", "seed", "split", "ticker", "origin").agg(
        F.array_sort(F.collect_list(F.struct("horizon", "forecast_date"))).alias("h"),
        F.count("*").alias("rows"),
        F.min("score").alias("score"),
        F.max("score").alias("score2"),
        F.min("current_close").alias("now"),
        F.max("current_close").alias("now2"),
        F.avg("predicted_close").alias("mean"),
    )
    dates = F.transform("h", lambda x: x["forecast_date"])
    horizons = F.transform("h", lambda x: x["horizon"])
    unordered = F.exists(F.sequence(F.lit(1), F.greatest(F.size("h") - 1, F.lit(1))), lambda i: F.coalesce((i < F.size("h")) & (F.get(dates, i) <= F.get(dates, i - 1)), F.lit(True)))
    stored = F.col("score")
    by_origin = origin.withColumn("horizons", F.coalesce(horizons != F.sequence(F.lit(1), F.lit(config.horizon)), F.lit(True)))
    by_origin = by_origin.withColumn("date_order", unordered).withColumn("date_after_origin", F.coalesce(F.get(dates, F.lit(0)) <= F.col("origin"), F.lit(True)))
    by_origin = by_origin.withColumn("origin_constant", ~(F.col("score").eqNullSafe(F.col("score2")) & F.col("now").eqNullSafe(F.col("now2"))))
    again = F.abs(F.try_divide(F.col("mean"), F.col("now")) - 1 - stored) > 1e-12 + 1e-5 * F.abs(stored)
    by_origin = by_origin.withColumn("score_recomputed", F.coalesce(again, F.lit(True)))
    rules = ["horizons", "date_order", "date_after_origin", "origin_constant", "score_recomputed"]
    # the shard's name is worked out from its keys
    pair = F.array(iso(F.col("origin")), F.col("ticker"))
    named = by_origin.groupBy("logical_shard_id").agg(*(F.count_if(F.col(r)).alias(r) for r in rules), F.array_sort(F.collect_list(pair)).alias("keys"), F.min("seed").cast("bigint").alias("seed"), F.min("split").alias("split"))
    payload = F.to_json(F.struct(F.lit(config.shard_tag).alias("contract"), "keys", "seed", "split"))
    named = named.withColumn("shard_id", F.when(F.substring(F.sha2(payload, 256), 1, 24).eqNullSafe(F.col("logical_shard_id")), 0).otherwise(1))
    twice = df.groupBy("logical_shard_id", *KEY).count().where("count > 1").groupBy("logical_shard_id").agg(F.count("*").alias("n")).select("logical_shard_id", F.lit("unique_key").alias("rule"), "n")

    def long(wide: DataFrame, names: list[str]) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).cast("bigint").alias("n")) for r in names)))
        return wide.select("logical_shard_id", pairs.alias("x")).select("logical_shard_id", "x.rule", "x.n").where("n > 0")

    wide = ["finite", "positive_prices", "elapsed", "constant", "metadata", "amount_source", "input_end", "effective_seed"]
    return long(shard, wide).unionByName(long(named, [*rules, "shard_id"])).unionByName(twice)


def check(df: DataFrame, config: ForecastConfig | None = None) -> None:
    check_columns(df)
    if df.isEmpty():
        raise ShardError("no predictions")
    if found := violations(df, config).limit(10).collect():
        raise ShardError("; ".join(f"{r['logical_shard_id']}: {r['rule']} ({r['n']})" for r in found))
