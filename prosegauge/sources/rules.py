"""Rule packs: markdown tables and sections, read on the driver.

A pack is a folder with a table of structural patterns and tables of words, and
may have a catalogue of semantic categories. Columns are found by their header,
in lower case; a line that is no table row ends a table, and every table of a file
is read. A word table needs a column ``word``: tables that call it otherwise add
nothing.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from prosegauge.functions import regexes

SHIPPED = Path(__file__).resolve().parent.parent / "rules"

# The names of a pack's files and of the columns and fields in them.
PATTERNS, WORDS, CATEGORIES = "banned-patterns.md", "banned-words.md", "patterns-agent.md"
SEVERITY, WEIGHT, DESCRIPTION, NOTE = "- **Severity:**", "- **Weight:**", "- **Description:**", "- **Multilingual note:**"
EXAMPLES = ("- **Examples:**", "**Examples:**")


@dataclass(frozen=True)
class Pattern:
    name: str
    lang_scope: str
    severity: str
    weight: float
    regex: str
    description: str

    @property
    def java_regex(self) -> str:
        return regexes.to_java(self.regex)

    @property
    def is_multiline(self) -> bool:
        """Matched on the whole text rather than line by line: a matter of the expression's text."""
        return "(?m)" in self.regex or "\n" in self.regex


@dataclass(frozen=True)
class Word:
    word: str
    replacement: str | None
    weight: float


@dataclass
class Category:
    name: str
    severity: str = ""
    weight: float = 1.0
    description: str = ""
    examples: list[str] = field(default_factory=list)
    multilingual_note: str | None = None


@dataclass(frozen=True)
class Ruleset:
    patterns: list[Pattern]
    words: list[Word]


def number(text: str | None) -> float:
    """A weight; 1.0 where there is none or it can't be read."""
    try:
        return float((text or "").strip().replace("_", "x"))
    except ValueError:
        return 1.0


def split_row(row: str) -> list[str]:
    """Cells of a table row. Between backticks a pipe is text; an empty first or last cell is left out."""
    cells, cell, quoted = [], [], False
    for c in row.strip():
        quoted ^= c == "`"
        if c == "|" and not quoted:
            cells.append("".join(cell).strip())
            cell = []
        else:
            cell.append(c)
    cells.append("".join(cell).strip())
    while cells and not cells[0]:  # leading empties come before any cell has been kept
        cells.pop(0)
    return cells[:-1] if cells and not cells[-1] else cells


def table_rows(text: str) -> Iterator[dict[str, str]]:
    """Rows of all tables by lower-case header; rows shorter than their header and rules of dashes are left out."""
    header: list[str] | None = None
    for line in text.splitlines():
        if not line.strip().startswith("|"):
            header = None
            continue
        cells = split_row(line)
        if header is None:
            header = [c.lower() for c in cells]
        elif not (len(cells) >= 2 and cells[0].startswith("-")) and len(cells) >= len(header):
            yield dict(zip(header, cells, strict=False))


def parse_patterns(text: str, compiles: Callable[[str], bool] = regexes.compiles) -> list[Pattern]:
    """Patterns of all tables. One whose expression doesn't compile is left out with a warning."""
    found = []
    for row in table_rows(text):
        name = row.get("name", "")
        regex = row.get("regex", "").strip("`").replace("\\|", "|")
        scope = row.get("lang scope", "korean" if name.startswith("ko_") else "english")
        if compiles(regex):
            found.append(Pattern(name, scope, row.get("severity", ""), number(row.get("weight")), regex, row.get("description", "")))
        else:
            warnings.warn(f"pattern {name!r} is left out, its expression does not compile: {regex}", stacklevel=2)
    return found


def parse_words(text: str) -> list[Word]:
    return [Word(row["word"], row.get("replacement") or None, number(row.get("weight"))) for row in table_rows(text) if row.get("word")]


def parse_categories(text: str) -> list[Category]:
    """Sections headed ``###`` that have a severity or a description."""
    found: list[Category] = []
    within = False
    for line in map(str.strip, text.splitlines()):
        if line.startswith("### "):
            found.append(Category(line[4:].strip()))
            within = False
            continue
        if not found:
            continue
        now = found[-1]
        value = line.partition(":**")[2].strip()
        if line.startswith(SEVERITY):
            now.severity = value
        elif line.startswith(WEIGHT):
            now.weight = number(value)
        elif line.startswith(DESCRIPTION):
            now.description = value
        elif line.startswith(NOTE):
            now.multilingual_note, within = value, False
        elif line in EXAMPLES:
            within = True
        elif within and line.startswith("- "):
            while line.startswith("- "):
                line = line[2:]
            if line.strip():
                now.examples.append(line.strip())
        elif line and not line.startswith(("-", "**")):
            within = False
    return [c for c in found if c.severity or c.description]


def load(folder: str | Path = SHIPPED, compiles: Callable[[str], bool] = regexes.compiles) -> Ruleset:
    """Both tables of a pack; either file missing is an error."""
    folder = Path(folder)
    return Ruleset(parse_patterns((folder / PATTERNS).read_text(encoding="utf-8"), compiles), parse_words((folder / WORDS).read_text(encoding="utf-8")))


def load_categories(path: str | Path = SHIPPED / CATEGORIES) -> list[Category]:
    return parse_categories(Path(path).read_text(encoding="utf-8"))


def raw_categories(path: str | Path = SHIPPED / CATEGORIES) -> str:
    """The catalogue as it is, for prompts; a missing file is an error."""
    return Path(path).read_text(encoding="utf-8")


def lexicon(path: str | Path = SHIPPED / "lexicon.md") -> list[tuple[str, str, str]]:
    """(section, entry, replacement) of the score's word list; entries that share a row are taken apart."""
    rows = table_rows(Path(path).read_text(encoding="utf-8"))
    return [(r["section"], entry, r.get("replacement", "")) for r in rows for entry in entries(r["section"], r["entry"])]


def entries(section: str, cell: str) -> list[str]:
    """One cell's entries; only a table of single words lists several with commas."""
    return [e.strip() for e in cell.split(",")] if section == "verbs" else [cell]


def pattern_table(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    rows = [(k, p.name, p.lang_scope, p.severity, p.weight, p.regex, p.java_regex, p.is_multiline, p.description) for k, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "rule_ord int, name string, lang_scope string, severity string, weight double, regex string, java_regex string, is_multiline boolean, description string")


def word_table(spark: SparkSession, words: list[Word]) -> DataFrame:
    return spark.createDataFrame([(k, w.word, w.replacement, w.weight) for k, w in enumerate(words)], "word_ord int, word string, replacement string, weight double")


def category_table(spark: SparkSession, categories: list[Category]) -> DataFrame:
    rows = [(k, c.name, c.severity, c.weight, c.description, c.examples, c.multilingual_note) for k, c in enumerate(categories)]
    return spark.createDataFrame(rows, "category_ord int, name string, severity string, weight double, description string, examples array<string>, multilingual_note string")
