"""Where texts come from. A document is one whole text with a key."""

from __future__ import annotations

import sys
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Changes that give plain documents the habits the rules look for, a different one for each last digit of the key.
DECORATED = """
CASE CAST(doc_id % 10 AS INT)
 WHEN 0 THEN '- ' || replace(text, chr(10), chr(10) || '- ')
 WHEN 1 THEN '## Overview: scope' || chr(10) || text || chr(10) || '### Notes:' || chr(10) || chr(10) || 'tail'
 WHEN 2 THEN replace(text, '. ', ' — ')
 WHEN 3 THEN text || ' 🚀 ✅ done ✨'
 WHEN 4 THEN 'planning + review then a + b + c' || chr(10) || text
 WHEN 5 THEN '**Key** point and __note__' || chr(10) || text
 WHEN 6 THEN 'Furthermore, in order to leverage this robust landscape, we delve into it. ' || text
 WHEN 7 THEN '```' || chr(10) || '- x' || chr(10) || '- y' || chr(10) || '- z' || chr(10) || '```' || chr(10) || text
 WHEN 8 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10)
          || 'In this section we will explore it. Let us break this down. ' || text
 ELSE text END"""


def scan_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, text``: each file whole."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text`` of one local file. Unreadable, or no UTF-8: an error."""
    return one(spark, Path(path).read_bytes().decode("utf-8"))


def scan_stdin(spark: SparkSession, stream: TextIO | None = None) -> DataFrame:
    """``doc_id, text`` of all of standard input."""
    return one(spark, (stream or sys.stdin).read())


def one(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "doc_id long, text string")


def scan_table(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return docs.select("doc_id", "lang", F.expr(DECORATED).alias("text"))
