"""The folder that all executors and the driver share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one of our own on a single machine; an error on a cluster,
    whose executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return found.rstrip("/")
