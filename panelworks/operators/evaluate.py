"""Statistics of scores against labels, date by date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import guarded_corr, let
from .panel import average_rank


def rank_ic_daily(pairs: DataFrame, least: int = 3) -> DataFrame:
    """``origin, n, rank_ic`` of ``origin, ticker, score, label``: Spearman's correlation across tickers.

    Ties share average ranks; a constant side, and fewer than ``least`` rows, give null.
    """
    pairs = pairs.where("score IS NOT NULL AND label IS NOT NULL")
    ranked = pairs.select("origin", average_rank(F.col("score"), "origin").alias("a"), average_rank(F.col("label"), "origin").alias("b"))
    out = ranked.groupBy("origin").agg(F.count("*").alias("n"), guarded_corr(F.col("a"), F.col("b")).alias("rank_ic"))
    return out.withColumn("rank_ic", F.when(F.col("n") >= least, F.col("rank_ic")))


def rank_ic_mean(daily: DataFrame) -> DataFrame:
    """``dates, mean_rank_ic``: each date with a value counts alike."""
    return daily.agg(F.count("rank_ic").alias("dates"), F.avg("rank_ic").alias("mean_rank_ic"))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """``origin, ticker, a, b``: observations that both scores have."""
    return a.select("origin", "ticker", F.col("score").alias("a")).join(b.select("origin", "ticker", F.col("score").alias("b")), ["origin", "ticker"])


def mae_daily(pairs: DataFrame) -> DataFrame:
    """``origin, mae, mae_bps, zero_mae`` of raw scores, and of a score of 0."""
    out = pairs.where("score IS NOT NULL AND label IS NOT NULL").groupBy("origin").agg(F.avg(F.abs(F.col("score") - F.col("label"))).alias("mae"), F.avg(F.abs("label")).alias("zero_mae"))
    return out.select("origin", "mae", (F.col("mae") * 10_000).alias("mae_bps"), "zero_mae")


def coverage_daily(expected: DataFrame, scores: DataFrame, least: int = 3) -> DataFrame:
    """``origin, expected, scored, coverage, enough`` of expected ``origin, ticker`` keys."""
    have = scores.where("score IS NOT NULL").select("origin", "ticker", F.lit(1).alias("have"))
    out = expected.select("origin", "ticker").distinct().join(have.distinct(), ["origin", "ticker"], "left").groupBy("origin").agg(F.count("*").alias("expected"), F.count("have").alias("scored"))
    return out.withColumn("coverage", F.col("scored") / F.col("expected")).withColumn("enough", F.col("scored") >= least)


def mae_mean(daily: DataFrame) -> DataFrame:
    """``dates, mean_mae, mean_mae_bps, mean_zero_mae`` of mae_daily(): each date counts alike."""
    return daily.agg(F.count("mae").alias("dates"), F.avg("mae").alias("mean_mae"), F.avg("mae_bps").alias("mean_mae_bps"), F.avg("zero_mae").alias("mean_zero_mae"))


def paired_difference(both: DataFrame, least: int = 3) -> DataFrame:
    """``origin, n, difference`` of ``origin, ticker, a, b, label``: the first score's RankIC less the second's, on the observations they share."""
    rows = both.where("a IS NOT NULL AND b IS NOT NULL AND label IS NOT NULL")
    ranked = rows.select("origin", *(average_rank(F.col(c), "origin").alias(c) for c in ("a", "b", "label")))
    ic = lambda c: guarded_corr(F.col(c), F.col("label"))
    out = ranked.groupBy("origin").agg(F.count("*").alias("n"), (ic("a") - ic("b")).alias("difference"))
    return out.withColumn("difference", F.when(F.col("n") >= least, F.col("difference")))


def runtime(predictions: DataFrame) -> DataFrame:
    """``model, seed, shards, forecasts, seconds``: a shard's elapsed time, which all its rows repeat, counts once."""
    each = predictions.groupBy("model", "seed", "logical_shard_id").agg(F.count_if(F.col("horizon") == 1).alias("forecasts"), F.max("batch_elapsed_seconds").alias("seconds"))
    return each.groupBy("model", "seed").agg(F.count("*").alias("shards"), F.sum("forecasts").alias("forecasts"), F.sum("seconds").alias("seconds"))


def draw(*parts: Column | int) -> Column:
    """A number of 32 bits from what is told, the same in every engine that has MD5."""
    text = F.concat_ws(":", *(F.lit(str(x)) if isinstance(x, int) else x.cast("string") for x in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def block_bootstrap(daily: DataFrame, value: str, blocks: Sequence[int] = (20,), replicates: int = 2000, seed: int = 42) -> DataFrame:
    """``block, dates, mean, low, high``: moving-block bootstraps' 95 % intervals of a mean over dates.

    Blocks of ``block`` dates in a row start where an MD5 of (seed, block,
    replicate, number) says; the last is cut so that each replicate has as many
    dates as there are.  The prefix sums, a number per date of the calendar, are
    one row, so that ``daily`` is evaluated once and nothing is joined by key.
    """
    dates = daily.where(F.col(value).isNotNull()).select("origin", F.col(value).cast("double").alias("x"))
    w = Window.orderBy("origin")  # a row per date
    sums = dates.select(F.row_number().over(w).alias("i"), F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    row = sums.agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("p"), F.count("*").cast("int").alias("n"))
    row = row.select("n", F.concat(F.array(F.lit(0.0)), F.transform("p", lambda x: x["s"])).alias("p"))
    spark = daily.sparkSession
    reps = spark.range(replicates).withColumnRenamed("id", "r").withColumn("block", F.explode(F.array(*map(F.lit, blocks))))
    reps = reps.crossJoin(F.broadcast(row)).where("n > 0").withColumn("l", F.least("block", "n"))  # one row

    def part(b: Column) -> Column:
        first = F.pmod(draw(seed, F.col("block"), F.col("r"), b), F.col("n") - F.col("l") + 1).cast("int")
        return let(first, lambda f: F.get("p", f + F.least(F.col("l"), F.col("n") - b * F.col("l"))) - F.get("p", f))

    numbers = F.sequence(F.lit(0), F.expr("CAST(ceil(n / l) AS INT) - 1"))
    means = reps.select("block", "n", (F.get("p", F.col("n")) / F.col("n")).alias("mean"), (F.aggregate(numbers, F.lit(0.0), lambda a, b: a + part(b)) / F.col("n")).alias("m"))
    return means.groupBy("block").agg(F.max("n").alias("dates"), F.max("mean").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
