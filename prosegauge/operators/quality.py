"""Assessments of rewrites, and other models' answers, read and checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.operators import prompts

AXES = ("coherence", "completeness", "readability", "fidelity")
# The fields of an answer, their allowed names, and the warning's limit.
LOW = 0.6
COMPONENTS = ("BWD", "SPV", "RHY", "META", "MD")
CATEGORIES = ("banned_word", "banned_phrase", "structural_pattern", "rhythm_issue", "markdown_overuse", "meta_commentary", "over_polish", "unknown")
SEVERITIES = ("low", "medium", "high", "critical")
# Ours.
DOUBT = "overall %.2f, under 0.60: the new text may be worse than the old one."
REPORT = "struct<" + ",".join(f"{a}:double" for a in AXES) + ",notes:string,_bad:string>"
ANSWER = (
    "struct<findings:array<struct<span:array<int>,line:int,category:string,severity:string,text:string,context:string,suggested_fix:string,evidence:string>>,"
    "components:struct<" + ",".join(f"{c}:double" for c in COMPONENTS) + ">,_bad:string>"
)


def json_object(text: Column) -> Column:
    """From the first opening brace to the last closing one; null without such a pair."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & (F.instr(F.reverse(text), "}") > 0) & (last > first), F.substring(text, first, last - first + 1))


def _parsed(text: Column, shape: str) -> Column:
    return F.from_json(text, shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "true"})


def problem(report: Column) -> Column:
    """Why a record of scores is no good, naming the field; null if it is."""
    out = F.when(report.isNull() | report["_bad"].isNotNull(), "the assessment is not valid JSON")
    for a in AXES:
        x = report[a]
        out = out.when(x.isNull(), f"missing field {a}").when(F.isnan(x) | (F.abs(x) == float("inf")), f"{a} score must be finite").when(~x.between(0, 1), f"{a} score must be between 0.0 and 1.0")
    return out


def parse(answers: DataFrame, key: str = "doc_id", response: str = "response") -> DataFrame:
    """``key``, the four axes, ``overall``, ``notes``, ``low`` and ``error``.

    The answer is read whole, or else from its first brace to its last. ``overall``
    is always computed, whatever the answer says. With an error the scores are null.
    """
    text = F.trim(F.coalesce(F.col(response), F.lit("")))
    whole, within = _parsed(text, REPORT), _parsed(json_object(text), REPORT)
    rows = answers.select(key, F.when(problem(whole).isNull(), whole).otherwise(F.coalesce(within, whole)).alias("r"))
    rows = rows.withColumn("error", problem(F.col("r")))
    good = F.col("error").isNull()
    a, b, c, d = (F.col(f"r.{x}") for x in AXES)
    overall = (a + b + c + d) * 0.25
    scores = [F.when(good, F.col(f"r.{x}")).alias(x) for x in AXES]
    return rows.select(key, *scores, F.when(good, overall).alias("overall"), F.when(good, F.coalesce("r.notes", F.lit(""))).alias("notes"), F.when(good, overall < LOW).alias("low"), "error")


def assess(pairs: DataFrame, assessor: Callable[[DataFrame], DataFrame], key: str = "doc_id", original: str = "original", rewritten: str = "rewritten") -> DataFrame:
    """``parse`` of what an assessor says of each pair of texts.

    ``assessor`` is any function from ``(key, prompt)`` rows to ``(key, response)``
    rows: a table of answers, or a call to a model by ``mapInPandas``. A pair
    without an answer has an error.
    """
    asked = prompts.assess(pairs, key, original, rewritten)
    return parse(pairs.select(key).join(assessor(asked).select(key, "response"), key, "left"), key)


def beside(scored: DataFrame, reviews: DataFrame, key: str = "doc_id", review: str = "naturalness") -> DataFrame:
    """``scored`` with a model's opinion as ``llm_naturalness_score``, which takes no part in the score. Null without one."""
    return scored.join(reviews.select(key, F.col(review).cast("double").alias("llm_naturalness_score")), key, "left")


def as_json(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, report``: the record with its overall score."""
    return parsed.select(key, F.to_json(F.struct(*AXES, "overall", "notes")).alias("report"))


def text_lines(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, report``: the scores to two places, and a warning below the limit."""
    rows = [F.format_string(f"  {x}: %.2f\n", F.col(x)) for x in (*AXES, "overall")]
    notes = F.when(F.trim("notes") != "", F.concat(F.lit("  notes: "), F.trim("notes"), F.lit("\n"))).otherwise("")
    warning = F.when(F.col("low"), F.format_string("WARNING: " + DOUBT + "\n", "overall")).otherwise("")
    return parsed.select(key, F.concat(F.lit("Quality assessment:\n"), *rows, notes, warning).alias("report"))


def check_answers(answers: DataFrame, key: str = "doc_id", response: str = "response") -> DataFrame:
    """``key, answer, errors``: a model's findings and component scores, and what is wrong with them."""
    rows = answers.select(key, _parsed(F.col(response), ANSWER).alias("answer"))
    a = F.col("answer")

    def bad(f: Column) -> Column:
        span = f["span"].isNotNull() & ((F.size(f["span"]) != 2) | F.exists(f["span"], lambda n: n.isNull() | (n < 0)))
        return F.coalesce(~f["category"].isin(*CATEGORIES), F.lit(True)) | F.coalesce(~f["severity"].isin(*SEVERITIES), F.lit(True)) | f["text"].isNull() | F.coalesce(f["line"] < 1, F.lit(False)) | span

    found = F.array_compact(
        F.array(
            F.when(a.isNull() | a["_bad"].isNotNull(), "not valid JSON"),
            F.when(a["findings"].isNull(), "findings are missing"),
            F.when(F.exists(a["findings"], bad), "a finding breaks the schema"),
            *[F.when(a["components"][c].isNull() | ~a["components"][c].between(0, 1) | F.isnan(a["components"][c]), f"{c} must be between 0 and 1") for c in COMPONENTS],
        )
    )
    return rows.select(key, "answer", found.alias("errors"))
