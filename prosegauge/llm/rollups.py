"""Token counts by source, language and tokenizer version, kept up by signed deltas.

A change to a document is an insert, a delete or a revised count. As signed rows
(a revision is the old count taken away and the new one added) changes add up in
any order, so a batch is summed before it is stored and totals are sums over
batches. A batch's rows are written to a folder of their own first. It is committed
by a marker that bears the batch's name and names the folder, a file that is
created only if there is none: whoever comes second finds it there and
changes nothing, whether a job was repeated, sent twice, sent by two at once, or
lost half-way before the marker. Nothing is ever read, changed and written back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import tokens
from prosegauge.llm.common import columns, small_batches

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = "docs long, tokens long"
DELTAS = f"source string, lang string, tokenizer_version string, {SUMS}"
CHANGES = ("insert", "delete", "revise")


def signed(changes: DataFrame) -> DataFrame:
    """``changes(kind, source, lang, tokenizer_version, n_tokens, old_tokens)`` -> signed ``(*KEYS, docs, tokens)``.

    ``kind`` is insert (n_tokens is added), delete (n_tokens is taken away) or
    revise (n_tokens in place of old_tokens). A null count is 0. Any other kind,
    null included, raises an error when the rows are read. Null keys are groups.
    """
    n, old = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long"), F.coalesce(F.col("old_tokens"), F.lit(0)).cast("long")
    sign = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0)
    known = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null")))).cast("int")).cast("long")
    return changes.select(*KEYS, known.alias("docs"), F.when(F.col("kind") == "revise", n - old).otherwise(known * n).alias("tokens"))


class Rollup:
    """A folder of committed batches of summed deltas."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def _marker(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_" for c in batch) or batch[0] == "_":
            raise ValueError(f"not a name for a batch: {batch!r}")
        return f"{self.folder}/{batch}.committed"

    def committed(self, batch: str) -> bool:
        fs, at = self._fs(self._marker(batch))
        return fs.exists(at)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the changes unless the batch is there already; whether they were added."""
        if self.committed(batch):
            return False
        name = f"_rows-{uuid.uuid4().hex}"
        signed(changes).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.folder}/{name}")
        if self._claim(batch, name):
            return True
        fs, at = self._fs(f"{self.folder}/{name}")
        fs.delete(at, True)
        return False

    def _claim(self, batch: str, name: str) -> bool:
        """Create the marker; False where there is one."""
        fs, at = self._fs(self._marker(batch))
        try:
            out = fs.create(at, False)
        except Exception:
            if fs.exists(at):
                return False
            raise
        try:
            out.write(bytearray(name, "ascii"))
        finally:
            out.close()
        return True

    def _named(self, at) -> str:
        fs = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        size = fs.getFileStatus(at).getLen()
        if not size:
            raise RuntimeError(f"{at} names no rows: its commit broke off; delete it and send the batch again")
        stream = fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("ascii")
        finally:
            stream.close()

    def totals(self) -> DataFrame:
        """Sums over all batches; groups without documents or tokens are left out."""
        fs, at = self._fs(self.folder)
        markers = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().endswith(".committed")] if fs.exists(at) else []
        paths = [f"{self.folder}/{self._named(m)}" for m in markers]
        if not paths:
            return self.spark.createDataFrame([], DELTAS)
        deltas = self.spark.read.schema(DELTAS).parquet(*paths)
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def bpe_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, exact by the byte-level vocabulary in ``path``; null or empty text: 0."""
    small_batches(docs.sparkSession)
    path = path or tokens.default_path()
    kept = [c for c in docs.columns if c not in (text, "n_tokens")]
    rows = docs.select(*kept, F.col(text).alias("_text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokens.encoder(path).ids
        for batch in it:
            (texts,) = columns(batch, "_text")
            n = pa.array([len(ids(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*batch.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in docs.select(*kept).dtypes) + ", n_tokens long")


BLANKS, WORDS, BPE = "words-0", "words-1", "byte_bpe_50k-1"


def first_counts(docs: DataFrame) -> DataFrame:
    """Inserts for three tokenizer versions: parts between blanks, words, both exact, and BPE tokens, estimated as a quarter of the bytes."""
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    counts = F.array(
        F.struct(F.lit(BLANKS).alias("tokenizer_version"), parts_between_blanks().alias("n_tokens")),
        F.struct(F.lit(WORDS).alias("tokenizer_version"), F.coalesce(words, F.lit(0)).cast("long").alias("n_tokens")),
        F.struct(F.lit(BPE).alias("tokenizer_version"), estimate().alias("n_tokens")),
    )
    rows = docs.select("source", "lang", F.explode(F.when(F.lit(True), counts)).alias("c"))
    return rows.select(F.lit("insert").alias("kind"), "source", "lang", "c.tokenizer_version", "c.n_tokens", F.lit(None).cast("long").alias("old_tokens"))


def parts_between_blanks():
    return F.coalesce(F.size(F.split("text", " ")), F.lit(0)).cast("long")


def retired(docs: DataFrame) -> DataFrame:
    """Deletes of all documents for the version that words-1 replaces."""
    none = F.lit(None).cast("long")
    return docs.select(F.lit("delete").alias("kind"), "source", "lang", F.lit(BLANKS).alias("tokenizer_version"), parts_between_blanks().alias("n_tokens"), none.alias("old_tokens"))


def estimate():
    return F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long")


def revised_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Exact BPE counts in place of the estimates."""
    exact = bpe_counts(docs.select("source", "lang", estimate().alias("old_tokens"), "text"), path=path)
    return exact.select(F.lit("revise").alias("kind"), "source", "lang", F.lit(BPE).alias("tokenizer_version"), "n_tokens", "old_tokens")


def maintain(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Load the documents, revise the estimates, delete a version that is replaced, send both once more, and return the totals.

    ``source, lang, tokenizer_version, docs, tokens``. Null sources and languages
    are groups of their own, repeated rows count as often as they occur, an empty
    table gives no rows.
    """
    store = Rollup(docs.sparkSession, folder)
    store.commit("load", first_counts(docs))
    for _ in range(2):
        store.commit("revise", revised_counts(docs, path))
        store.commit("retire", retired(docs))
    return store.totals()
