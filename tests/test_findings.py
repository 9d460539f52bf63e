"""Findings and reports."""

import json
import re

import pytest

from prosegauge.operators import findings, reports
from prosegauge.sources import rules


@pytest.fixture(scope="module")
def patterns(spark):
    return rules.load().patterns


def found(spark, patterns, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r) for r in findings.findings(docs, patterns).orderBy("doc_id", "rule_ord", "match_ord").collect()]


def named(spark, patterns, text):
    return [(r[3], r[6], r[7]) for r in found(spark, patterns, text)]


def own(name, regex):
    return rules.Pattern(name, "universal", "high", 2.0, regex, "")


def test_simple_rule_and_clean_text(spark):
    rule = own("test_pattern", r"(?i)\btest\b")
    assert [r[3] for r in found(spark, [rule], "One Test of a rule, and more.")] == ["test_pattern"]
    assert found(spark, [rule], "No rule of ours is in here.", "Plain words, nothing else.", None, "") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It reads German + Dutch pages.", ["German + Dutch"]),
        ("They sell bread + butter at the gate.", ["bread + butter"]),
        ("सुबह चाय + नाश्ता मिलता है", ["चाय + नाश्ता"]),
        ("Count 7+8 in D++ or 4 + 4.", []),
        ("a + b + c", ["a + b"]),
        ("one +\ntwo", []),
        ("我们卖苹果 + 香蕉", ["我们卖苹果 + 香蕉"]),
    ],
)
def test_plus(spark, patterns, text, want):
    assert [m for n, m, _ in named(spark, patterns, text) if n == "plus_conjunction"] == want


def test_signs(spark, patterns):
    assert named(spark, patterns, "Rain 🚀 then sun ✨ then ⚠️") == [("emoji_decoration", c, 1) for c in "🚀✨⚠"]
    assert named(spark, patterns, "A door — it is red —\r\nopens — slowly") == [("em_dash", "—", 1), ("em_dash", "—", 1), ("em_dash", "—", 2)]
    assert named(spark, patterns, "오늘 🚀 비가 온다") == [("emoji_decoration", "🚀", 1)]
    assert named(spark, patterns, "**a** __b__ **x__ ****") == [("bold_emphasis", m, 1) for m in ("**a**", "__b__", "**x__")]


def test_bullets(spark, patterns):
    assert named(spark, patterns, "x\n- a\n- b\n- c\nend") == [("bullet_block", "- a", 2)]
    assert named(spark, patterns, "- a\n- b\nend") == []
    assert named(spark, patterns, "x\n\n* a\n\n+ b\n- c") == [("bullet_block", "", 2)]  # the match starts on the blank line
    assert named(spark, patterns, "-\xa0a\n- b\n- c d") == [("bullet_block", "-\xa0a", 1)]
    assert named(spark, patterns, "1. a\n2. b\n3. c") == []
    assert named(spark, patterns, "- a\n- b\n- c\ntext\n- d\n- e\n- f") == [("bullet_block", "- a", 1), ("bullet_block", "- d", 5)]
    assert named(spark, patterns, "- item\n" * 100_000) == [("bullet_block", "- item", 1)]


def test_headings(spark, patterns):
    assert named(spark, patterns, "## Title: Sub\n\ntext\n### Note:\n\nbody") == [("colon_heading", "## Title: Sub", 1), ("colon_heading", "### Note:", 4)]
    assert named(spark, patterns, "#tag: v") == [("colon_heading", "#tag: v", 1)]
    assert named(spark, patterns, "## Title\ntext") == []


def test_marks_in_the_text(spark, patterns):
    for some in (findings.MARKS[:2], findings.MARKS):
        text = "".join(a + b for a, b in some) + "\n- a\n- b\n- c"
        assert named(spark, patterns, text) == [("bullet_block", "- a", 2)]


def test_against_a_plain_matcher(spark, patterns):
    import random

    r = random.Random(0)
    texts = ["".join(r.choices(["- ", "* ", "+ ", "a", " ", "\n", "\n\n", "\t", "\xa0", "# ", ": ", "**", "—", "x y"], k=r.randint(0, 40))) for _ in range(400)]
    want = []
    for i, t in enumerate(texts):
        for k, rx in ((0, r"(?m)(?:^\s*[-*+]\s+[^\n]+\n?){3,}"), (2, r"(?m)^\s{0,3}#{1,6}\s*(?:\*\*)?[^:\n]{1,80}(?:\*\*)?\s*:\s+\S[^\n]*$")):
            for j, m in enumerate(re.finditer(rx, t)):
                want.append((i, k, j, m[0].split("\n")[0].strip(), t.count("\n", 0, m.start()) + 1))
    got = [(r[0], r[1], r[2], r[6], r[7]) for r in found(spark, patterns, *texts) if r[1] in (0, 2)]
    assert got == want


def test_order_counts_and_suppression(spark, patterns):
    docs = spark.createDataFrame([(1, "**b** — 🚀"), (2, "clean"), (3, None)], "doc_id long, text string")
    rows = findings.findings(docs, patterns, lang="auto")
    assert [r["pattern_name"] for r in rows.orderBy("rule_ord", "match_ord").collect()] == ["emoji_decoration", "bold_emphasis", "em_dash"]
    counts = findings.counted(findings.matched(docs, patterns))
    assert {r["doc_id"]: r["match_count"] for r in counts.collect()} == {1: 3, 2: 0, 3: 0}
    assert [r["doc_id"] for r in findings.over_target(counts, 2).collect()] == [1]
    assert findings.suppressed(rows, "# remark\n\n^—$\n\\*\\*").count() == 1
    assert findings.findings(docs, []).count() == 0


def test_reports(spark, patterns):
    docs = spark.createDataFrame([(1, "**b** —"), (2, "clean")], "doc_id long, text string")
    rows = findings.matched(docs, patterns)
    text = {r["doc_id"]: r["report"] for r in reports.report(rows, "anything").collect()}
    assert text == {1: "Structural matches found: 2\n  [medium] bold_emphasis (weight: 0.5) - Line 1: **b**\n  [high] em_dash (weight: 2.0) - Line 1: —\n", 2: "Structural matches found: 0\n"}
    md = {r["doc_id"]: r["report"] for r in reports.report(rows, "markdown").collect()}
    assert md[2].endswith("Matches found: 0\n\n") and "- **em_dash** (severity: high, weight: 2.0)\n  - Line 1: —\n\n" in md[1]
    out = {r["doc_id"]: json.loads(r["report"]) for r in reports.report(rows, "json").collect()}
    assert out[2] == [] and list(out[1][0]) == list(reports.FIELDS) and out[1][1]["weight"] == 2.0
    assert "2. [medium] bold_emphasis (weight 0.5) at line 1: **b**" in rows.where("doc_id = 1").select(reports.summary()).first()[0]
    context = {r["doc_id"]: r["context"] for r in reports.delegate_context(rows).collect()}
    assert "Structural findings: 2." in context[1] and "1. [high] em_dash line 1: —" in context[1] and "Structural findings: 0." in context[2]


def test_top_keeps_the_order_of_equals(spark, patterns):
    rows = findings.matched(spark.createDataFrame([(1, "— 🚀 — ✨ — — — — — 🔥")], "doc_id long, text string"), patterns)
    top = reports.top(rows).orderBy("rank").collect()
    assert [r["pattern_name"] for r in top] == ["emoji_decoration"] * 3 + ["em_dash"] * 5
    assert [r["match_ord"] for r in top] == [0, 1, 2, 0, 1, 2, 3, 4]


def test_listing():
    text = reports.listing(rules.load(), rules.load_categories())
    assert text.startswith("Loaded 6 banned patterns\nLoaded 87 banned words\nLoaded 9 agent patterns\n\nBanned Patterns:\n")
    assert "(scope: universal, severity: medium, weight: 0.5, description:" in text and "(replacement: None, weight: 0.3)" in text
    assert '  - delve (replacement: Some("explore"), weight: 1)' in text and "severity: high, weight: 2, examples: 8" in text
