"""Findings on a stream of documents. The rules look at one row at a time, so nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from prosegauge.operators.findings import findings
from prosegauge.sources.rules import Pattern


def stream(spark: SparkSession, path: str, schema: StructType, patterns: list[Pattern], files_a_batch: int = 64) -> DataFrame:
    """A streaming frame of findings on the Parquet files that appear in ``path``."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return findings(docs, patterns)


def drained(found: DataFrame, output: str, checkpoint: str) -> None:
    """Write what is there now and stop; a later call goes on where this one ended."""
    query = found.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
