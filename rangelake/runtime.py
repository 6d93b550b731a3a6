"""Making the package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's own modules to the executors, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_rangelake_shipped", False):
        return
    home = Path(__file__).resolve().parent
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="rangelake-code-")), "rangelake.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent).as_posix())
    sc.addPyFile(to)
    sc._rangelake_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in ``spark.checkpoint.dir``, which driver and executors share; it goes when the JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rangelake-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
