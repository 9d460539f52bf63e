"""Reports on findings, one text for each document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.operators.findings import FIELDS as ALL
from prosegauge.sources.rules import Category, Pattern, Ruleset

TOP = 8

# The fields of a match in JSON, in order, and the Markdown report's title.
FIELDS = ("pattern_name", "severity", "weight", "matched_text", "line_number")
TITLE = "# AI Slop Structural Match Report"


def heaviest(matches: Column | str = "matches", k: int = TOP) -> Column:
    """The ``k`` heaviest of an array of findings; equals stay in order of rule and place."""
    ranked = F.transform(matches, lambda m: F.struct((-m["weight"]).alias("w"), m["rule_ord"].alias("r"), m["match_ord"].alias("o"), m.alias("m")))
    return F.transform(F.slice(F.sort_array(ranked), 1, k), lambda x: x["m"])


def top(found: DataFrame, k: int = TOP, key: str = "doc_id") -> DataFrame:
    """``found(key, matches)`` -> each document's ``k`` heaviest findings as rows, with their ``rank``."""
    rows = found.select(key, F.posexplode(heaviest("matches", k)).alias("at", "m"))
    return rows.select(key, *[F.col(f"m.{f}").alias(f) for f in ALL], (F.col("at") + 1).alias("rank"))


def violations(found: DataFrame, k: int = TOP, key: str = "doc_id") -> DataFrame:
    """The heaviest findings by the names that a summary uses, with defaults for what is missing."""
    rows = found.select(key, F.posexplode(heaviest("matches", k)).alias("at", "m"))
    return rows.select(key, (F.col("at") + 1).alias("rank"), *[v.alias(n) for n, v in named(F.col("m")).items()])


def named(m: Column) -> dict[str, Column]:
    """A finding by the names of a summary."""
    return {
        "type": F.coalesce(m["pattern_name"], F.lit("pattern")),
        "line": F.coalesce(m["line_number"], F.lit(0)),
        "severity": F.coalesce(m["severity"], F.lit("unknown")),
        "weight": F.coalesce(m["weight"], F.lit(0.0)),
        "matched_text": F.coalesce(m["matched_text"], F.lit("")),
    }


def listed(item: Callable[[Column, Column], Column], matches: Column | str = "matches", sep: str = "") -> Column:
    """Findings (of each: itself and its number from 1) as one text."""
    return F.array_join(F.transform(matches, lambda m, k: item(m, k + 1)), sep)


def markdown(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, report``: a heading, the count, and an item for each finding."""
    head = F.format_string(f"{TITLE}\n\nMatches found: %d\n\n", F.size("matches"))
    item = lambda m, _: F.format_string("- **%s** (severity: %s, weight: %.1f)\n  - Line %d: %s\n\n", m["pattern_name"], m["severity"], m["weight"], m["line_number"], m["matched_text"])
    return found.select(key, F.concat(head, listed(item)).alias("report"))


def plain(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, report``: the count and a line for each finding."""
    head = F.format_string("Structural matches found: %d\n", F.size("matches"))
    item = lambda m, _: F.format_string("  [%s] %s (weight: %.1f) - Line %d: %s\n", m["severity"], m["pattern_name"], m["weight"], m["line_number"], m["matched_text"])
    return found.select(key, F.concat(head, listed(item)).alias("report"))


def json_of(matches: Column | str = "matches") -> Column:
    return F.to_json(F.transform(matches, lambda m: F.struct(*[m[f].alias(f) for f in FIELDS])))


def as_json(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, report``: the findings as a JSON array of objects."""
    return found.select(key, json_of().alias("report"))


def read_json(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings from their JSON, one row each; text that is no such array stops the job."""
    shape = "array<struct<pattern_name:string,severity:string,weight:double,matched_text:string,line_number:int>>"
    rows = F.from_json("report", shape, {"mode": "FAILFAST"})
    return made.select(key, F.posexplode(rows).alias("match_ord", "r")).select(key, "match_ord", "r.*")


def report(found: DataFrame, form: str = "text", key: str = "doc_id") -> DataFrame:
    """``json``, ``markdown``, or text for any other name, of ``found(key, matches)``."""
    return {"json": as_json, "markdown": markdown}.get(form, plain)(found, key)


def summary(matches: Column | str = "matches", k: int = TOP) -> Column:
    """The heaviest findings, numbered, as a prompt quotes them."""

    def line(m: Column, rank: Column) -> Column:
        v = named(m)
        return F.format_string("%d. [%s] %s (weight %s) at line %d: %s", rank, v["severity"], v["type"], v["weight"].cast("string"), v["line"], v["matched_text"])

    return listed(line, heaviest(matches, k), "\n")


def delegate_context(found: DataFrame, key: str = "doc_id", k: int = TOP) -> DataFrame:
    """``key, context``: what another agent needs: the count, the heaviest findings and what to hand in."""

    def line(m: Column, rank: Column) -> Column:
        v = named(m)
        return F.format_string("%d. [%s] %s line %d: %s", rank, v["severity"], v["type"], v["line"], v["matched_text"])

    body = F.format_string(
        "# Context for a rewrite\n\nStructural findings: %d. They are evidence, not orders.\n\n%s\n\n"
        "Read the whole text, judge it by the semantic categories, and rewrite it whole; no substitution by pattern.\n"
        "Hand in the rewritten text, a new analysis of it, and a note on the counts before and after.\n",
        F.size("matches"),
        listed(line, heaviest("matches", k), "\n"),
    )
    return found.select(key, body.alias("context"))


def shown(x: float) -> str:
    """A weight as the listing prints it: whole numbers without a point."""
    return str(int(x)) if x == int(x) else repr(x)


def listing(rules: Ruleset, categories: list[Category]) -> str:
    """What a pack holds."""

    def pattern(p: Pattern) -> str:
        return f"  - {p.name} (scope: {p.lang_scope}, severity: {p.severity}, weight: {shown(p.weight)}, description: {p.description})"

    words = [f"  - {w.word} (replacement: {'None' if w.replacement is None else f'Some({chr(34)}{w.replacement}{chr(34)})'}, weight: {shown(w.weight)})" for w in rules.words]
    kinds = [f"  - {c.name} (severity: {c.severity}, weight: {shown(c.weight)}, examples: {len(c.examples)}, note: {c.multilingual_note or 'none'}, description: {c.description})" for c in categories]
    counts = [f"Loaded {len(rules.patterns)} banned patterns", f"Loaded {len(rules.words)} banned words", f"Loaded {len(categories)} agent patterns"]
    return "\n".join([*counts, "", "Banned Patterns:", *map(pattern, rules.patterns), "", "Banned Words:", *words, "", "Agent Patterns:", *kinds]) + "\n"
