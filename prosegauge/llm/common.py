"""What the operators of this subpackage share: storage, folds, tables, batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once. Texts are of any length, so this is small.
BATCH_ROWS = 500


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is configured and there are no other machines."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files are whole after the write, so later stages survive lost executors
    without recomputing what came before. ``release`` deletes them.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "kept_at", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the batches that go to Python small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def row_order(docs: DataFrame) -> tuple[Column, Column]:
    """Part (a string) and number in it of each row, by which rows sort in the order of ``docs``.

    A table of Parquet files, of which columns or rows may have been taken, has the
    order it was written in: by the files' numbers, then by the rows in them. Spark
    deals files to tasks by size, so tasks don't tell that order. Other frames have
    that of their partitions.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation" and plan.relation().toString() == "parquet":
        file = docs.metadataColumn("_metadata")
        number = F.lpad(F.regexp_extract(file["file_name"], r"part-(\d+)", 1), 20, "0")
        return F.concat(number, file["file_path"]), file["row_index"]
    row = F.monotonically_increasing_id()  # 33 bits for the row, the partition above them
    return F.lpad(F.shiftright(row, 33).cast("string"), 20, "0"), row.bitwiseAND(F.lit((1 << 33) - 1))


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Gather row tuples into record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield table(held, schema)
            held = []
    if held:
        yield table(held, schema)


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cells = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)
