"""Sharded predictions on disk: one file a shard, replaced at once, and resuming by what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forecast import PREDICTION_COLUMNS, PREDICTION_SCHEMA, ForecastConfig, ShardError
from ..operators.predictions import check, check_columns
from .files import beside, file_system, move

ORIGIN_KEY = ["model", "seed", "ticker", "origin"]


def write(df: DataFrame, path: str, config: ForecastConfig | None = None, *, validate: bool = True) -> str:
    """Write one set of predictions, a bounded unit of inference, to the file ``path`` (.parquet) in the contract's columns.

    The file is written aside, read again, checked as it is there, and then takes
    the old one's place in one step: a failure, whenever it comes, leaves what
    was there.  Works on any Hadoop file system.
    """
    if not path.endswith(".parquet"):
        raise ShardError("a shard's path ends with .parquet")
    check_columns(df)
    spark, aside = df.sparkSession, beside(path)
    fs, folder = file_system(spark, aside)
    try:
        df.select(*PREDICTION_COLUMNS).coalesce(1).write.parquet(aside)
        made = [x.getPath().toString() for x in fs.listStatus(folder) if x.getPath().getName().endswith(".parquet")]
        if len(made) != 1:
            raise ShardError(f"{path}: {len(made)} files were written, not one")
        if validate:
            check(read(spark, made), config)
        if fs.exists(target := file_system(spark, path)[1]) and not fs.getFileStatus(target).isFile():
            raise ShardError(f"{path} is no file")
        move(spark, made[0], path)
    finally:
        fs.delete(folder, True)
    return path


def write_partitioned(df: DataFrame, directory: str) -> None:
    """All shards at once, one partition folder each; only the folders of df's shards are replaced."""
    out = df.select(*PREDICTION_COLUMNS).repartition("logical_shard_id")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "seed", "logical_shard_id").parquet(directory)


def read(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA).parquet(*sorted(paths))


def completed(predictions: DataFrame, *, check: bool = True) -> DataFrame:
    """``model, seed, ticker, origin`` of saved predictions, each once.

    A forecast that is there twice, and an origin in two shards, raise: with
    ``check`` here, by a job of its own, and otherwise where the rows are used.
    """
    each = predictions.groupBy(*ORIGIN_KEY).agg(
        (F.count("*") > F.size(F.collect_set("horizon"))).alias("twice"), (~F.min("logical_shard_id").eqNullSafe(F.max("logical_shard_id"))).alias("apart")
    )
    if check and (bad := each.where("twice OR apart").limit(1).collect()):
        raise ShardError(f"{'duplicate forecast' if bad[0]['twice'] else 'an origin in two shards'}: {bad[0].asDict()}")
    told = F.concat_ws(" ", *(F.col(c).cast("string") for c in ORIGIN_KEY))
    model = F.when(F.col("twice"), F.raise_error(F.concat(F.lit("duplicate forecast: "), told))).when(F.col("apart"), F.raise_error(F.concat(F.lit("an origin in two shards: "), told)))
    return each.select(model.otherwise(F.col("model")).alias("model"), *ORIGIN_KEY[1:])


def pending(requests: DataFrame, done: DataFrame, model: str, seed: int) -> DataFrame:
    """Requests whose (model, seed, ticker, origin) isn't done yet, whatever the split."""
    own = done.where((F.col("model") == model) & (F.col("seed") == seed)).select("ticker", "origin")
    return requests.join(own, ["ticker", "origin"], "left_anti")
