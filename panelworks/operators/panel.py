"""Labels, contexts, splits, features and scores over a panel of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite

#: Sessions of context and horizon.
CONTEXT, HORIZON = 90, 10


def _by_ticker():
    return Window.partitionBy("ticker").orderBy("session")


def _indexed(bars: DataFrame) -> DataFrame:
    """Bars with ``i``, the session's number in the whole panel.

    Sessions are numbered after distinct(), so the single window sees one row per session.
    """
    days = bars.select("session").distinct().withColumn("i", F.row_number().over(Window.orderBy("session")))
    return bars.join(days, "session")


def forward_label(bars: DataFrame, horizon: int = HORIZON, strict: bool = False) -> DataFrame:
    """Bars with ``label_end`` and ``label``: the mean of the next closes by this close, less 1.

    Only where all ``horizon`` rows of the ticker follow; if strict, only where
    they are the panel's very next sessions.
    """
    ahead = _by_ticker().rowsBetween(1, horizon)
    bars = _indexed(bars) if strict else bars
    whole = F.count("close").over(ahead) == horizon
    if strict:
        whole = whole & (F.lead("i", horizon).over(_by_ticker()) == F.col("i") + horizon)
    out = bars.withColumn("label_end", F.when(whole, F.lead("session", horizon).over(_by_ticker())))
    return out.withColumn("label", F.when(whole, F.avg("close").over(ahead) / F.col("close") - 1)).drop("i")


def context_complete(bars: DataFrame, context: int = CONTEXT, strict: bool = False) -> DataFrame:
    """Bars with ``context_rows`` and ``complete``: whether ``context`` rows of the ticker end here."""
    bars = _indexed(bars) if strict else bars
    rows = F.count("close").over(_by_ticker().rowsBetween(1 - context, 0))
    whole = rows == context
    if strict:
        whole = whole & F.coalesce(F.lag("i", context - 1).over(_by_ticker()) == F.col("i") - (context - 1), F.lit(False))
    return bars.withColumn("context_rows", rows).withColumn("complete", whole).drop("i")


def assign_split(labelled: DataFrame, dev_end: str, val_start: str, val_end: str, test_start: str) -> DataFrame:
    """Rows with ``split``: an origin and its label's end decide; null where neither fits."""
    day = lambda x: F.lit(x).cast("date")
    s, e = F.col("session"), F.col("label_end")
    return labelled.withColumn(
        "split",
        F.when(e <= day(dev_end), "development").when((s >= day(val_start)) & (s <= day(val_end)) & (e <= day(val_end)), "validation").when((s >= day(test_start)) & e.isNotNull(), "test"),
    )


def turnover_proxy(bars: DataFrame) -> DataFrame:
    """Bars with ``amount``: volume times the mean of open, high, low and close."""
    return bars.withColumn("amount", F.col("volume") * (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)


def causal_features(bars: DataFrame) -> DataFrame:
    """A declared set of features, none of which looks ahead or back beyond 90 rows of the ticker."""
    w = _by_ticker()
    past = lambda n: w.rowsBetween(1 - n, 0)
    close = F.col("close")
    step = F.log(close) - F.log(F.lag("close").over(w))
    bars = bars.withColumn("step", step)
    return bars.select(
        "session",
        "ticker",
        F.col("step").alias("return_1"),
        (close / F.lag("close", 4).over(w) - 1).alias("return_4"),
        (close / F.avg("close").over(past(12)) - 1).alias("to_mean_12"),
        F.stddev_samp("step").over(past(20)).alias("spread_20"),
        F.try_divide(close - F.min("low").over(past(20)), F.max("high").over(past(20)) - F.min("low").over(past(20))).alias("place_20"),
        (F.col("volume") / F.avg("volume").over(past(20))).alias("volume_20"),
        (F.log(F.col("high")) - F.log(F.col("low"))).alias("span"),
    )


def momentum_scores(bars: DataFrame, back: int = 4) -> DataFrame:
    """``origin, ticker, score``: the close by the close ``back`` rows earlier, less 1; rows without one have no score."""
    score = F.col("close") / F.lag("close", back).over(_by_ticker()) - 1
    return bars.select(F.col("session").alias("origin"), "ticker", score.alias("score")).where("score IS NOT NULL")


def average_rank(value: Column, by: str) -> Column:
    """Ranks from 1 within ``by``, ties sharing their mean."""
    w = Window.partitionBy(by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy(by, value)) - 1) / 2.0


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """``origin, ticker, score, rank``: each origin's k best finite scores, ties by ticker.

    The filter on row_number lets Spark keep k rows a task before the shuffle.
    """
    w = Window.partitionBy("origin").orderBy(F.desc("score"), "ticker")
    return scores.where(finite(F.col("score"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def signal_sessions(bars: DataFrame) -> DataFrame:
    """``session, signal_date``: the session before, whose scores are traded at this one's open."""
    return bars.select("session").distinct().withColumn("signal_date", F.lag("session").over(Window.orderBy("session")))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
