"""Structural findings: rules matched over documents.

One projection per rule pack, no shuffle: every rule is a literal expression, so
it is compiled once, and its matches are an array within the row. Counts, ranks
and reports are made from that array, within the row too; findings become rows of
their own only where these are asked for. A rule whose
text asks for it is matched on the whole text, the others line by line. Order is
kept as columns: rules in the order of the pack, matches by position.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import prose
from prosegauge.functions.regexes import compiles, to_java
from prosegauge.sources.rules import Pattern

#: Pairs of noncharacters that set matches off; the first pair that a text doesn't hold is used.
MARKS = [("﷐", "﷑"), ("﷒", "﷓"), ("﷔", "﷕")]
#: What a trim takes off: white space in Unicode's sense.
SPACE = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"

FINDING = "array<struct<matched_text:string,line_number:int>>"
FIELDS = ("rule_ord", "match_ord", "pattern_name", "severity", "weight", "matched_text", "line_number")
MATCHES = "array<struct<rule_ord:int,match_ord:int,pattern_name:string,severity:string,weight:double,matched_text:string,line_number:int>>"


def lines(text: Column) -> Column:
    """Lines without their ends; a carriage return before a line feed belongs to the end."""
    return F.split(text, "\r?\n")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}\\z", "")


def per_line(text: Column, java_regex: str) -> Column:
    """Every match within a line, as it is, with the line's number."""
    found = F.transform(
        lines(text),
        lambda line, k: F.transform(F.regexp_extract_all(line, F.lit(java_regex), F.lit(0)), lambda m: F.struct(m.alias("matched_text"), (k + 1).alias("line_number"))),
    )
    return F.flatten(found).cast(FINDING)


def whole_text(text: Column, java_regex: str) -> Column:
    """Every match in the text: its first line, trimmed, and the number of the line that it starts in.

    Matches are set off by marks, and the marked text is read line by line: what
    follows an opening mark, up to the closing one or the line's end, is the first
    line of a match that starts there.
    """
    chosen = F.lit(len(MARKS) - 1)
    for k in range(len(MARKS) - 2, -1, -1):
        chosen = F.when(~F.contains(text, F.lit(MARKS[k][0])) & ~F.contains(text, F.lit(MARKS[k][1])), k).otherwise(chosen)

    def rows(chosen: Column) -> Column:  # bound once for the text
        out = None
        for k, (opening, closing) in enumerate(MARKS):
            # in a text that holds every pair the last one's signs are unreadable signs from here on
            free = text if k < len(MARKS) - 1 else F.translate(text, opening + closing, "\ufffd\ufffd")
            found = marked_rows(F.regexp_replace(free, F.lit(java_regex), F.lit(f"{opening}$0{closing}")), opening, closing)
            out = F.when(chosen == k, found) if out is None else out.when(chosen == k, found)
        return out

    return F.get(F.transform(F.array(chosen), rows), 0).cast(FINDING)


def marked_rows(marked: Column, opening: str, closing: str) -> Column:
    def starts(line: Column, k: Column) -> Column:
        parts = F.split(line, opening)
        one = lambda p: F.struct(trimmed(F.substring_index(p, closing, 1)).alias("matched_text"), (k + 1).alias("line_number"))
        return F.transform(F.slice(parts, F.lit(2), F.size(parts)), one)

    return F.flatten(F.transform(F.split(marked, "\n"), starts))


def matched(docs: DataFrame, patterns: list[Pattern], text: str = "text", lang: str = "auto", name: str = "matches") -> DataFrame:
    """``docs`` with an array of all findings, in the order of rules and places.

    ``lang`` is taken and has no effect: all rules run on all texts. A null text
    has no findings. Words of the pack are never matched. A row is a document,
    whatever its key; a column called ``name`` is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def one(k: int, p: Pattern) -> Column:
        fixed = [F.lit(k).alias("rule_ord"), F.lit(p.name).alias("pattern_name"), F.lit(p.severity).alias("severity"), F.lit(float(p.weight)).alias("weight")]
        found = (whole_text if p.is_multiline else per_line)(body, p.java_regex)
        return F.transform(found, lambda m, j: F.struct(fixed[0], j.alias("match_ord"), *fixed[1:], m["matched_text"].alias("matched_text"), m["line_number"].alias("line_number")))

    every = F.concat(*[one(k, p) for k, p in enumerate(patterns)]) if patterns else F.array()
    return prose.settled(docs.withColumn(name, every.cast(MATCHES)))


def findings(docs: DataFrame, patterns: list[Pattern], key: str = "doc_id", text: str = "text", lang: str = "auto") -> DataFrame:
    """``key, rule_ord, match_ord, pattern_name, severity, weight, matched_text, line_number``, a row for each finding."""
    rows = matched(docs.select(key, text), patterns, text, lang).select(key, F.explode("matches").alias("m"))
    return rows.select(key, *[F.col(f"m.{f}").alias(f) for f in FIELDS])


def counted(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``found(key, matches)`` -> ``key, match_count``, 0 for documents without findings."""
    return found.select(key, F.size("matches").cast("bigint").alias("match_count"))


def weighed(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, weight``: the sum of the weights, for documents that have findings."""
    total = F.aggregate("matches", F.lit(0.0), lambda w, m: w + m["weight"])
    return found.where(F.size("matches") > 0).select(key, total.alias("weight"))


def over_target(counts: DataFrame, target: int = 0) -> DataFrame:
    """Documents that have more findings than the target."""
    return counts.where(F.col("match_count") > target)


def ignored(ignore: str) -> list[str]:
    """The expressions of a list, one a line; # starts a remark. One that doesn't compile is left out with a warning."""
    out = []
    for line in map(str.strip, ignore.splitlines()):
        if line and not line.startswith("#"):
            if compiles(line):
                out.append(to_java(line))
            else:
                warnings.warn(f"not a regular expression, left out of the ignore list: {line}", stacklevel=2)
    return out


def suppressed(found: DataFrame, ignore: str) -> DataFrame:
    """Rows of findings less those whose text matches a line of ``ignore``."""
    for rule in ignored(ignore):
        found = found.where(~F.col("matched_text").rlike(rule))
    return found
