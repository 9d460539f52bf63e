"""Views of a text that the score is computed on, as column expressions.

Nothing is cut out: code, front matter and code spans are overwritten with blanks,
so that offsets and line numbers stay those of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "﷖", "﷗"
FENCED = r"(?m)^[ \t]{0,3}```(?s:.*?)(?:^[ \t]{0,3}```[^\n]*$|\z)|^[ \t]{0,3}~~~(?s:.*?)(?:^[ \t]{0,3}~~~[^\n]*$|\z)"
FRONT = r"\A(?:---[ \t]*\n(?s:.*?)\n---[ \t]*(?:\n|\z)|\+\+\+[ \t]*\n(?s:.*?)\n\+\+\+[ \t]*(?:\n|\z))"
CODE_SPAN = r"`[^`\n]+`"
WORD = r"[\p{L}\p{M}\p{N}]+(?:'[\p{L}\p{M}\p{N}]+)*"
SENTENCE_END = r"[.!?]+|\n[ \t]*\n"
PARAGRAPH_END = r"\n[ \t]*\n"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, through which no filter on a computed column is pushed.

    A pushed filter repeats the expressions that it names, and theirs, down to the scan.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def blanked(text: Column, regex: str) -> Column:
    """The text with spaces in place of every match, line feeds kept."""

    def cut(parts: Column) -> Column:
        def one(p: Column, k: Column) -> Column:
            inside = F.regexp_replace(F.substring_index(p, CLOSE, 1), r"[^\n]", " ")
            return F.when(k == 0, p).otherwise(F.concat(inside, F.substring_index(p, CLOSE, -1)))

        return F.array_join(F.transform(parts, one), "")

    marked = F.regexp_replace(text, F.lit(regex), F.lit(f"{OPEN}$0{CLOSE}"))
    return let(F.split(marked, OPEN), cut)


def prose(text: Column) -> Column:
    """Without carriage returns at line ends, marks, front matter and fenced code."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{OPEN}{CLOSE}]", " "), "\r\n", "\n")
    return blanked(blanked(plain, FRONT), FENCED)


def clean(prose_text: Column) -> Column:
    """Prose without code spans, in lower case, with straight apostrophes."""
    return F.lower(F.replace(blanked(prose_text, CODE_SPAN), F.lit("’"), F.lit("'")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def padded(tokens: Column) -> Column:
    """The words with a space on both sides of each, so that a pattern of padded words meets whole words only."""
    return F.array_join(F.transform(tokens, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")


def phrase(text: str) -> str:
    """The padded words of a phrase, which match its words however they are spaced or joined."""
    import regex

    return "".join(f" {w} " for w in regex.findall(WORD, text.lower().replace("’", "'")))


def either(phrases: list[str]) -> str:
    """An expression for any of the phrases; the longest wins where several start."""
    return "(?:" + "|".join(sorted({phrase(p) for p in phrases}, key=lambda p: (-p.count("  "), -len(p), p))) + ")"


def any_of(phrases: list[str]) -> str:
    """Like ``either``, as a tree of shared beginnings: few branches are tried where a long list would be gone through."""
    tree: dict = {}
    for p in phrases:
        node = tree
        for c in phrase(p):
            node = node.setdefault(c, {})
        node[""] = {}
    return _branches(tree)


def _branches(node: dict) -> str:
    ways = [re.escape(c) + _branches(node[c]) for c in sorted(node) if c]
    if not ways:
        return ""
    one = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
    return one + "?" if "" in node else one  # greedy, so the longest phrase wins


def sentences(clean_text: Column) -> Column:
    """Word lists of the sentences that have words."""
    return F.filter(F.transform(F.split(clean_text, SENTENCE_END), words), lambda s: F.size(s) > 0)


def paragraphs(clean_text: Column) -> Column:
    return F.filter(F.transform(F.split(clean_text, PARAGRAPH_END), words), lambda s: F.size(s) > 0)


def clip01(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def runs(values: Column, least: int) -> Column:
    """How many values are in a run of at least ``least`` equals; the array is sorted or in order."""
    near = range(1 - least, 1)

    def member(x: Column, k: Column) -> Column:
        spans = [(F.get(values, k + a) == x) & (F.get(values, k + a + least - 1) == x) & ((k + a) >= 0) for a in near]
        hit = spans[0]
        for s in spans[1:]:
            hit = F.coalesce(hit, F.lit(False)) | F.coalesce(s, F.lit(False))
        return F.coalesce(hit, F.lit(False))

    return F.size(F.filter(values, member))


def run_lengths(values: Column) -> Column:
    """The lengths of the maximal runs of equals, in order."""
    starts = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda k: (k == 0) | (F.get(values, k) != F.get(values, F.greatest(k - 1, F.lit(0)))))
    lengths = let(starts, lambda at: F.transform(at, lambda s, k: F.coalesce(F.get(at, k + 1), F.size(values)) - s))
    return F.when(F.size(values) > 0, lengths).otherwise(F.array().cast("array<int>"))
