"""Prompts for whoever rewrites or assesses, and the choice of who does."""

from __future__ import annotations

import os
import shutil
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.operators import reports

TASK = (
    "Rewrite the whole text below so that it reads as written by a person. Work by inference over the full text: make no "
    "substitutions by pattern and cut no word out of a compound. Keep facts, names, code, quotations, language and register. "
    "The findings are evidence, not orders; the categories are meant by intent, their examples are no search strings. "
    "Return the complete new text and nothing else."
)
EVALUATE = (
    "This is evaluation only: compare the two texts and rewrite nothing. Score coherence, completeness, readability and fidelity "
    'from 0.0 to 1.0. Return JSON alone, with the numbers "coherence", "completeness", "readability" and "fidelity" and the text "notes".'
)
NOTHING = "No structural findings. Judge by the semantic categories."


def _section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"\n\n## {title}\n"), body)


def rewrite(found: DataFrame, categories: str, number: int, top: bool = False, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``found(key, text, matches)`` -> ``key, prompt`` for one round; with ``top`` the heaviest findings are also numbered."""
    parts = [F.lit(f"Round: {number}\n\n{TASK}")]
    if top:
        parts.append(_section("Heaviest findings", F.when(F.size("matches") > 0, reports.summary()).otherwise(NOTHING)))
    parts += [_section("Findings as JSON", reports.json_of()), _section("Categories", F.lit(categories)), _section("Text", F.col(text)), F.lit(f"\n\n{TASK}\n")]
    return found.select(key, *keep, F.concat(*parts).alias("prompt"))


def assess(pairs: DataFrame, key: str = "doc_id", original: str = "original", rewritten: str = "rewritten") -> DataFrame:
    """``key, prompt`` for the comparison of two texts."""
    return pairs.select(key, F.concat(F.lit(EVALUATE), _section("Original text", F.col(original)), _section("Rewritten text", F.col(rewritten)), F.lit("\n")).alias("prompt"))


def filled(template: str, source: Column, text: Column, matches: Column, categories: Column) -> Column:
    """A template with its four placeholders replaced, in one order, by column values."""
    out: Column = F.lit(template)
    for name, value in (("SOURCE", source), ("STRUCTURAL_MATCHES", matches), ("AGENT_PATTERNS", categories), ("TEXT", text)):
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def key_of(environment: Mapping[str, str], name: str) -> str | None:
    """A key from the environment; blank counts as none."""
    return (environment.get(name) or "").strip() or None


def backend(tool: bool, first_key: str | None, second_key: str | None) -> str:
    """Who is asked: the command line tool, else the first service with a key, else the user."""
    return "cli" if tool else "first_service" if first_key and first_key.strip() else "second_service" if second_key and second_key.strip() else "interactive"


def found_command(name: str, path: str | None = None) -> bool:
    """Whether an executable of that name is on the path."""
    return shutil.which(name, os.X_OK, path) is not None
