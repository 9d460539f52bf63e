"""The ten operators over the driver's tables, as the contracts word their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from prosegauge.llm import ann, extract, hmm, langid, mixing, ordermin, packing, quality, rollups, simhash
from prosegauge.llm.companions import COMPANIONS
from prosegauge.llm.common import fold, read, shared_folder

def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = langid.train(docs.where(fold("doc_id", 5) != 0))
    found = langid.identify(docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out")), profiles)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return hmm.language_model(docs.withColumn("held", fold("doc_id", 7) == 2))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    model = quality.train(docs.where(fold("doc_id", 4) != 2), labels)
    scored = quality.score(docs.withColumn("held_out", fold("doc_id", 4) == 2), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(read(spark, sf_dir, "documents").select("doc_id", "source"))
    return found.select("doc_id", "source", "mix_phase", "mix_block", "mix_slot", "mix_place")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("text", "lang", "source")
    return rollups.maintain(docs, f"{shared_folder(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_order_minhash": op2_order_minhash,
    "op3_html_extraction": op3_html_extraction,
    "op4_permutation_index": op4_permutation_index,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_hidden_markov_lm": op6_hidden_markov_lm,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_mixing_sources": op8_mixing_sources,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

QUERIES |= {name: run for name, (run, _) in COMPANIONS.items()}
#: None of the ten results can be said whole in SQL; the companions' can.
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in COMPANIONS.items()}
