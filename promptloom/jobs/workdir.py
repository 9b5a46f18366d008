"""Folders for what jobs write between their steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; in a local session without it, below a temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-promptloom-"))
    return f"{base}/{name}-{uuid.uuid4().hex}"
