"""Plumbing that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import remove


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none (local tests), a temporary folder of this
    machine is made once and named as the checkpoint folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext._jsc.sc().isLocal() is False:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="panelworks-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_runs: dict[str, str] = {}


def run_dir(spark: SparkSession) -> str:
    """This application's own folder under the shared one, for what it writes in between; it goes when the process ends."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/panelworks/{app}-{uuid.uuid4().hex}"
        atexit.register(_clear, spark, _runs[app])
    return _runs[app]


def _clear(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception as gone:  # a session that is closed already leaves its folder to whoever keeps the shared one
        print(f"left behind: {path} ({gone.__class__.__name__})", file=sys.stderr)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._panelworks_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._panelworks_path)


def shuffled(df: DataFrame) -> DataFrame:
    """df, for a join by shuffles alone.

    Spark takes packed files, and rows that are yet to be exploded, for much
    smaller than they are, and would gather them on the driver to broadcast them.
    """
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    """The number of partitions that shuffles are set to have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id="doc_id"):
    """True where the CRC-32 of the id as text leaves no rest by 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0
