"""Where tables may be kept that all executors read and write."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new name in the shared folder that the cluster names; one of our own only where there are no other machines."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or '/tmp/checkpoints').rstrip('/')}/prosegauge-{uuid.uuid4().hex}"
