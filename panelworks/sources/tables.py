"""The driver's tables as a panel of bars."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_scan(spark: SparkSession, files: Mapping[str, str], pinned: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of one Parquet file a split, with the split's name in ``file_split``; other files of their folders aren't read.

    ``pinned`` gives the SHA-256 of the splits' files: bytes that differ raise
    before any row is read.
    """
    for name, digest in (pinned or {}).items():
        found = spark.read.format("binaryFile").load(files[name]).select(F.sha2("content", 256)).collect()  # one file, one row
        if [r[0] for r in found] != [digest]:
            raise ValueError(f"the file of {name} isn't the pinned one")
    return reduce(DataFrame.unionByName, [spark.read.parquet(path).withColumn("file_split", F.lit(name)) for name, path in files.items()])


def bars(rows: DataFrame, session, ticker, price, volume, order) -> DataFrame:
    """``session, ticker, open, high, low, close, volume`` from single trades; order must tell all of them apart.

    One aggregation with partial sums on the map side, so a ticker with a third
    of all trades costs one row per task.
    """
    rows = rows.select(session.alias("session"), ticker.alias("ticker"), price.alias("px"), volume.alias("vol"), order.alias("k"))
    return rows.groupBy("session", "ticker").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("vol").alias("volume")
    )


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of part brands by week of shipping; a line's unit price is its trade."""
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 0")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    day = F.to_date("l_shipdate")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", px.alias("px"))
    return bars(lines.join(parts, lines["l_partkey"] == parts["p_partkey"]), F.date_sub(day, F.weekday(day)), F.col("p_brand"), px, F.col("l_quantity"), key)


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of event types by hour; only positive values are trades."""
    events = read(spark, sf_dir, "events").where("value > 0")
    # the hour by arithmetic on the naive time, which no session time zone moves
    hour = F.window("ts", "1 hour")["start"]
    return bars(events, hour, F.col("event_type"), F.col("value"), F.lit(1.0), F.struct("ts", "event_id"))
