"""Shared scratch storage."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share for files between jobs.

    ``spark.checkpoint.dir``, then the folder given to ``setCheckpointDir``, then a folder in the
    session's warehouse. Only the last is checked: outside local mode it must not lie on a
    machine's own disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or \
        context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    on_disk = "://" not in warehouse and not warehouse.startswith("hdfs:") or \
        warehouse.startswith("file:")
    if on_disk and not context.master.startswith("local"):
        raise ValueError("no shared scratch folder: set spark.checkpoint.dir to one that all "
                         f"executors see (the warehouse {warehouse} is on local disk)")
    return f"{warehouse}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
