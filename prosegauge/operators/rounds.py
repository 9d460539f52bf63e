"""The loop of analysis and rewriting, for all documents at once.

Each round takes the documents that still have more findings than the target (or,
once, all of them if a rewrite is forced), asks a rewriter for their new texts and
analyses them again. A rewriter is any function from ``(key, round, text, prompt)``
rows to ``(key, response)`` rows: a table of answers, or a call to a model by
``mapInPandas``. Nothing is overwritten. Every round is written out, which also
keeps plans short.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.operators import findings, prompts
from prosegauge.sources.rules import Pattern

Rewriter = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Policy:
    """Where the two known loops differ: how answers are cleaned, and what the prompt quotes."""

    unfence: bool = False
    top: bool = False
    #: Whether an unfenced answer is also trimmed, and judged empty after that.
    trim: bool = False


PLAIN = Policy()
FENCED = Policy(unfence=True, top=True, trim=True)


def answered(table: DataFrame, key: str = "doc_id") -> Rewriter:
    """A rewriter that looks answers up in ``table(key, round, response)``."""
    return lambda asked: asked.join(table, [key, "round"]).select(key, "response")


def unfenced(text: Column) -> Column:
    """Trimmed, without one pair of fence lines around the whole answer."""
    bare = findings.trimmed(text)
    body = F.regexp_replace(F.regexp_replace(bare, r"\A```[^\n]*(?:\n|\z)", ""), r"(?:\n|\A)```[^\n]*\z", "")
    return F.when(bare.startswith("```"), findings.trimmed(body)).otherwise(bare)


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(docs: DataFrame, patterns: list[Pattern], rewriter: Rewriter, folder: str, max_rounds: int = 3, target: int = 0, force: bool = False, categories: str = "", policy: Policy = PLAIN, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(final, log)``: ``key, text`` after the last round, and ``key, round, phase, match_count``.

    An answer that is missing or blank raises an error before anything of its
    round is kept. ``folder`` must be one that all executors share.
    """
    spark = docs.sparkSession
    now = _written(with_counts(docs.select(key, text), patterns, key, text), folder, "round-0")
    logs = []
    limit = max(max_rounds, 1) if force else max_rounds
    for number in range(1, limit + 1):
        active = now.where(F.col("match_count") > target) if not (force and number == 1) else now
        if not active.limit(1).count():
            break
        found = findings.matched(active.select(key, text), patterns, text)
        asked = prompts.rewrite(found, categories, number, policy.top, key, text, (text,)).withColumn("round", F.lit(number))
        got = rewriter(asked)
        response = unfenced(F.col("response")) if policy.unfence else F.col("response")
        new = active.select(key, "match_count").withColumnRenamed("match_count", "before").join(got.select(key, response.alias("_new")), key, "left")
        new = _written(new, folder, f"answers-{number}")
        if blank := new.where(F.coalesce(findings.trimmed(F.col("_new")), F.lit("")) == "").select(key).limit(3).collect():
            raise ValueError(f"round {number}: no rewrite for {[r[0] for r in blank]}")
        after = _written(with_counts(new.select(key, F.col("_new").alias(text)), patterns, key, text), folder, f"round-{number}")
        logs.append(new.select(key, F.lit(number).alias("round"), F.lit("before").alias("phase"), F.col("before").alias("match_count")))
        logs.append(after.select(key, F.lit(number).alias("round"), F.lit("after").alias("phase"), "match_count"))
        now = _written(now.join(new.select(key), key, "left_anti").unionByName(after), folder, f"texts-{number}")
    log = reduce(DataFrame.unionByName, logs) if logs else spark.createDataFrame([], f"{key} {dict(docs.dtypes)[key]}, round int, phase string, match_count bigint")
    return now.select(key, text), log


def with_counts(docs: DataFrame, patterns: list[Pattern], key: str, text: str) -> DataFrame:
    """``key, text, match_count``, counted within the row."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.size((findings.whole_text if p.is_multiline else findings.per_line)(F.coalesce(F.col(text), F.lit("")), p.java_regex))
    return docs.select(key, text, total.cast("bigint").alias("match_count"))


def deltas(log: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, round, before, after, change`` of each round."""
    wide = log.groupBy(key, "round").agg(F.max(F.when(F.col("phase") == "before", F.col("match_count"))).alias("before"), F.max(F.when(F.col("phase") == "after", F.col("match_count"))).alias("after"))
    return wide.withColumn("change", F.col("after") - F.col("before"))
