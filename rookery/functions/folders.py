"""Folders for files that the driver and all executors read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir. Where none is named, a session on one machine gets a temporary one,
    and any other an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="rookery-")
    return f"{root.rstrip('/')}/rookery/{name}-{uuid.uuid4().hex}"
