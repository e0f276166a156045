"""This package as one file that Spark hands to its executors."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

from .files import file_system, write_bytes

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def archive() -> bytes:
    """The package's modules as a zip file, the same bytes for the same modules."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        for folder, _, names in sorted(os.walk(_ROOT)):
            for name in sorted(x for x in names if x.endswith(".py")):
                path = os.path.join(folder, name)
                with open(path, "rb") as f:
                    made.writestr(zipfile.ZipInfo(os.path.relpath(path, os.path.dirname(_ROOT))), f.read())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Let the session's Python workers import this package, wherever they run; once a session is enough.

    Spark fetches the file from the folder that ``spark.checkpoint.dir`` names,
    or, in local sessions without one, from a folder of this machine that goes
    with the process.
    """
    data = archive()
    name = f"panelworks-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    context = spark.sparkContext
    if name in context._python_includes:
        return
    if shared := context.getConf().get("spark.checkpoint.dir"):
        path = f"{shared.rstrip('/')}/panelworks/{name}"
        fs, where = file_system(spark, path)
        if not fs.exists(where):
            write_bytes(spark, path, data)
        context.addPyFile(fs.makeQualified(where).toString())
        return
    folder = tempfile.mkdtemp(prefix="panelworks-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with open(path := os.path.join(folder, name), "wb") as f:
        f.write(data)
    context.addPyFile(path)
