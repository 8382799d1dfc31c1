"""A folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local session gets one of its own; on a cluster it is an error, as executors don't share local folders."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="cubespan-")
        spark.sparkContext.setCheckpointDir(known)
        known = spark.sparkContext.getCheckpointDir() or known
    return known.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
