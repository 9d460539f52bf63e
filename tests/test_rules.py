"""Rule packs and the spelling of their expressions."""

import warnings

import pytest

from prosegauge.functions import regexes
from prosegauge.sources import rules


def test_shipped_pack():
    pack = rules.load()
    assert [p.name for p in pack.patterns] == ["bullet_block", "emoji_decoration", "colon_heading", "bold_emphasis", "em_dash", "plus_conjunction"]
    assert {p.lang_scope for p in pack.patterns} == {"universal"}
    assert [p.weight for p in pack.patterns] == [1.0, 2.0, 2.0, 0.5, 2.0, 1.5]
    assert [p.is_multiline for p in pack.patterns] == [True, False, True, False, False, False]
    assert len(pack.words) == 87  # the table headed Phrase adds none
    assert pack.words[0] == rules.Word("delve into", "explore", 1.0)
    assert pack.words[61].replacement is None and pack.words[61].weight == 0.3


def test_shipped_categories():
    found = rules.load_categories()
    assert len(found) == 9 and [len(c.examples) for c in found] == [8] + [6] * 8
    assert [c.weight for c in found] == [2.0, 2.0, 1.5, 1.5, 1.25, 1.25, 1.5, 1.25, 1.25]
    assert [c.severity for c in found] == ["high"] * 2 + ["medium"] * 7
    assert all(c.multilingual_note and c.description for c in found)


def test_rows_are_split_outside_backticks():
    assert rules.split_row("| a | `x|y` | b |") == ["a", "`x|y`", "b"]
    assert rules.split_row("| a | | b |") == ["a", "", "b"]
    assert rules.split_row("| a | |") == ["a", ""]
    assert rules.split_row("|| a |") == ["a"]
    assert rules.split_row("a | b") == ["a", "b"]
    assert rules.split_row("|") == []


def test_table_quirks():
    text = (
        "| Name | Regex |\n|---|---|\n| ko_one | `a\\|b` |\n| short |\n| -dash | `x` |\n\n"
        "| NAME | Lang Scope | Weight | Regex |\n|---|---|---|---|\n| two | universal | heavy | x{2} |\n| ko_three | any | 0.25 | `y` | more |\n"
    )
    found = rules.parse_patterns(text, lambda r: True)
    assert [(p.name, p.lang_scope, p.weight, p.regex) for p in found] == [("ko_one", "korean", 1.0, "a|b"), ("two", "universal", 1.0, "x{2}"), ("ko_three", "any", 0.25, "y")]
    assert rules.parse_patterns("| Name | Regex |\n| x | `a` |\n", lambda r: True)[0].lang_scope == "english"
    words = rules.parse_words("| Word | Replacement |\n|---|---|\n| a | |\n| | b |\n| c | d |\n\n| Phrase | Replacement |\n|---|---|\n| e | f |\n")
    assert words == [rules.Word("a", None, 1.0), rules.Word("c", "d", 1.0)]


def test_invalid_expressions_are_left_out_with_a_warning(spark):
    text = "| Name | Regex |\n|---|---|\n| bad | `a(b` |\n| ahead | `a(?=b)` |\n| back | `(a)\\1` |\n| good | `a+` |\n"
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert [p.name for p in rules.parse_patterns(text)] == ["good"]
    assert len(said) == 3


def test_category_quirks():
    text = (
        "- **Severity:** high\n### first\n- **Severity:** low\n- **Weight:** many\n- **Detection rule:** unread\n- **Examples:**\n  - - one\n  - two\n\n  - three\n- **Multilingual note:** kept\n  dropped\n"
        "### empty\n- **Weight:** 2\n### last\n- **Description:** d\n**Examples:**\n- four\ntext\n- not an example\n"
    )
    first, last = rules.parse_categories(text)
    assert (first.name, first.severity, first.weight, first.examples, first.multilingual_note) == ("first", "low", 1.0, ["one", "two", "three"], "kept")
    assert (last.name, last.examples, last.multilingual_note, last.weight) == ("last", ["four"], None, 1.0)


def test_missing_files_are_errors(tmp_path):
    with pytest.raises(FileNotFoundError):
        rules.load(tmp_path)
    (tmp_path / rules.PATTERNS).write_text("")
    with pytest.raises(FileNotFoundError):
        rules.load(tmp_path)
    with pytest.raises(FileNotFoundError):
        rules.raw_categories(tmp_path / "none.md")


def test_java_spelling():
    assert regexes.to_java("(?m)(?:^a.+\\n?){3,}") == "(?Udm)(?:^a.+\\n?){3}(?:^a.+\\n?)*+"
    assert regexes.to_java("(?u)a") == "(?Ud)a"
    assert regexes.to_java("(?i)\\btest$") == "(?Udi)\\btest\\z"
    assert regexes.to_java("a\\$[$]") == "(?Ud)a\\$[$]"
    assert regexes.to_java("(?P<n>a)") == "(?Ud)(?<n>a)"
    for bad in ("a(?!b)", "(?<=a)b", "(a)\\1", "(?U)a*", "(?>a)"):
        with pytest.raises(ValueError):
            regexes.to_java(bad)


def test_tables(spark):
    pack = rules.load()
    assert rules.pattern_table(spark, pack.patterns).count() == 6
    assert rules.word_table(spark, pack.words).where("replacement is null").count() == 4
    assert rules.category_table(spark, rules.load_categories()).selectExpr("sum(size(examples))").first()[0] == 56
