"""Small files through the session's Hadoop file systems: read, write, replace at once."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def beside(path: str) -> str:
    """A name in the same folder that no reader of data looks at."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder + '/' if folder or path.startswith('/') else ''}_{name}.{uuid.uuid4().hex}"


def move(spark: SparkSession, source: str, target: str) -> None:
    """One file takes another's place: readers see the old one or the new one at every moment.

    On a local disk that is one system call; elsewhere one call of the file
    system, which HDFS and object stores carry out as a whole.
    """
    fs, where = file_system(spark, target)
    if fs.getScheme() == "file":
        own = lambda x: unquote(urlparse(x).path) if x.startswith("file:") else x
        folder, name = os.path.split(own(target))
        # the checksum of the old file would be read against the new one
        if os.path.exists(old := os.path.join(folder, f".{name}.crc")):
            os.unlink(old)
        os.replace(own(source), own(target))
        return
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    files.rename(file_system(spark, source)[1], where, options)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file whole: a failure leaves what was there, and nothing beside it."""
    fs, where = file_system(spark, path)
    aside = beside(path)
    _, new = file_system(spark, aside)
    if where.getParent() is not None:
        fs.mkdirs(where.getParent())
    try:
        out = fs.create(new, True)
        try:
            out.write(bytearray(data))
            if hasattr(out, "hsync") and fs.getScheme() == "hdfs":
                out.hsync()
        finally:
            out.close()
        move(spark, aside, path)
    finally:
        fs.delete(new, False)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)
