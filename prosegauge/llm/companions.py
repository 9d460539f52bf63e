"""Queries for what SQL can say of operators whose whole result it can't, each with that SQL.

They run the operator itself and keep the columns, or sums of them, that follow
from the tables by arithmetic alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import hmm, mixing, ordermin, packing, rollups, simhash
from prosegauge.llm.common import fold, read, shared_folder

WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def crc32(text: str) -> str:
    """DuckDB has no crc32: bit by bit over the bytes of an ASCII text."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS UBIGINT))"
    one = "list_reduce(list_concat([xor(c, b)], [CAST(x AS UBIGINT) FOR x IN range(8)]), lambda v, z: xor(v >> 1, CAST(3988292384 AS UBIGINT) * (v & 1)))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], {codes}), lambda c, b: {one}), CAST(4294967295 AS UBIGINT))"


def unigram_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base of op6."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held", fold("doc_id", 7) == 2)
    return hmm.language_model(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


UNIGRAM_SQL = f"""WITH t AS (SELECT doc_id, {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 2 AS held_out, list_concat(coalesce({WORDS}, []), ['']) AS ws FROM documents),
 w AS (SELECT doc_id, held_out, unnest(ws) AS word FROM t),
 c AS (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY word),
 s AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
 SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(min(n) AS BIGINT) AS train_tokens,
  round(sum(log10((coalesce(c.c, 0) + 1) / CAST(n + 1 * (v + 1) AS DOUBLE))), 4) AS base_score FROM w LEFT JOIN c USING (word) CROSS JOIN s GROUP BY doc_id, held_out"""


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and edited texts of op2."""
    return ordermin.fingerprints(read(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following, length(text) // 3 AS cut FROM t)
 SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - cut) || left(following, cut)) AS edited_sha256 FROM n"""


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 gives each source: all its documents, in blocks of 32 of which the last may be short, each in a slot of its own."""
    found = mixing.mixed(read(spark, sf_dir, "documents").select("doc_id", "source"))
    return found.groupBy("source").agg(F.count("*").alias("docs"), F.countDistinct("mix_block").alias("blocks"), F.countDistinct("mix_slot").alias("slots"), F.max("mix_place").alias("last_place"))


MIXED_SQL = """SELECT source, count(*) AS docs, CAST(ceil(count(*) / 32.0) AS BIGINT) AS blocks, CAST(ceil(count(*) / 32.0) AS BIGINT) AS slots, CAST(least(count(*), 32) - 1 AS INT) AS last_place FROM documents GROUP BY source"""


def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of op9 for words; the version that was deleted has none."""
    docs = read(spark, sf_dir, "documents").select("text", "lang", "source")
    made = rollups.maintain(docs, f"{shared_folder(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    return made.where(F.col("tokenizer_version") != rollups.BPE)


TOTALS_SQL = r"""SELECT source, lang, 'words-1' AS tokenizer_version, count(*) AS docs, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS BIGINT) AS tokens FROM documents GROUP BY source, lang"""


def packed_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That op5 fills sequences without a hole and none beyond its capacity, whatever the tokens are: no row breaks it."""
    made = packing.pack(read(spark, sf_dir, "documents"))
    sums = made.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("places"), F.count("*").alias("pieces"))
    broken = sums.where((F.col("length") > packing.CAPACITY) | (F.col("end") != F.col("length")) | (F.col("places") != F.col("pieces")))
    documents = made.agg(F.lit("documents").alias("what"), F.countDistinct("doc_id").alias("n"))
    return documents.unionByName(broken.agg(F.lit("broken sequences").alias("what"), F.count("*").alias("n")))


SHAPE_SQL = "SELECT 'documents' AS what, count(DISTINCT doc_id) AS n FROM documents UNION ALL SELECT 'broken sequences', 0"


def copies_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That op10 has equal texts in one component: for each text that occurs more than once its copies and components."""
    docs = read(spark, sf_dir, "documents")
    made = simhash.near_duplicates(docs)
    texts = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    joined = made.join(texts, "doc_id").groupBy("text_sha256")
    return joined.agg(F.count("*").alias("copies"), F.countDistinct("component_id").alias("components")).where("copies > 1")


COPIES_SQL = "SELECT sha256(coalesce(text, '')) AS text_sha256, count(*) AS copies, CAST(1 AS BIGINT) AS components FROM documents GROUP BY 1 HAVING count(*) > 1"

COMPANIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "edited_texts_of_order_minhash": (edited_texts, EDITED_SQL),
    "shape_of_best_fit_packing": (packed_shape, SHAPE_SQL),
    "base_of_hidden_markov_lm": (unigram_base, UNIGRAM_SQL),
    "sources_of_mixing": (mixed_sources, MIXED_SQL),
    "word_totals_of_token_counts": (word_totals, TOTALS_SQL),
    "copies_of_simhash_near_dedup": (copies_together, COPIES_SQL),
}
