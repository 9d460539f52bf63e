"""The score: views of the text, counts, components, bands."""

import json
import math

import pytest
from pyspark.sql import functions as F

from prosegauge.functions import prose
from prosegauge.operators import score


def one(spark, text):
    return score.scored(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def view(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_code_and_front_matter_are_blanked_in_place(spark):
    text = "---\ntitle: x\n---\nA `code` b\r\n```py\nleverage\n```\nend\n~~~\nopen to the end"
    got = view(spark, text, prose.prose)
    plain = text.replace("\r\n", "\n")
    assert len(got) == len(plain) and got.count("\n") == plain.count("\n")
    assert got.split() == ["A", "`code`", "b", "end"]
    assert view(spark, text, lambda t: prose.clean(prose.prose(t))).split() == ["a", "b", "end"]
    assert view(spark, None, prose.prose) == "" and view(spark, "+++\na\n+++\nb", prose.prose).split() == ["b"]


def test_words_and_sentences(spark):
    assert view(spark, "don't stop—it's 3 o'clock naïve 'quoted'", prose.words) == ["don't", "stop", "it's", "3", "o'clock", "naïve", "quoted"]
    assert [len(s) for s in view(spark, "One two. Three!? four five six\n\nseven... .", prose.sentences)] == [2, 1, 3, 1]


def test_worked_example(spark):
    row = spark.range(1).select(score.final(*[F.lit(x) for x in (0.5, 0.3, 0.4, 0.5, 0.25)]).alias("s")).select("s", score.band(F.col("s")).alias("b")).first()
    assert tuple(row) == (39, "noticeable")


@pytest.mark.parametrize(("n", "name"), [(0, "clean"), (9, "clean"), (10, "trace"), (24, "trace"), (25, "noticeable"), (44, "noticeable"), (45, "heavy"), (64, "heavy"), (65, "severe"), (84, "severe"), (85, "critical"), (100, "critical")])
def test_bands(spark, n, name):
    assert spark.range(1).select(score.band(F.lit(n)).alias("b")).first()["b"] == name


def test_banned_density(spark):
    row = one(spark, "Furthermore, in  order\nto leverage this robust cutting-edge landscape, we delve into it. Harness’s harnessed.")
    assert (row["banned_words"], row["banned_phrases"]) == (5, 2)  # delve into is one; harness's and harnessed are other words
    assert math.isclose(row["banned_density"], 1000 * 9 / row["w"]) and row["bwd"] == 1.0 and row["bwd_signal"] == "severe"
    assert one(spark, "```\nleverage\n```\n`delve` plain text")["banned_hits"] == 0
    assert one(spark, "결론적으로 이것은 매우 좋다")["banned_words"] == 2


def test_rhythm(spark):
    flat = "the a of to in on at by. " * 12
    row = one(spark, flat)
    assert row["cv"] == 0 and row["longest_streak"] == 12 and row["openers_repeated"] == 12
    assert math.isclose(row["rhy"], 0.5 + 0.2 + 0.2 + 0.1)
    few = one(spark, "One. Two. Three. Four.")
    assert few["rhy"] == 0 and few["rhythm_sample_confidence"] == "low"
    varied = one(spark, "Go. " + "word " * 30 + ". She ran home quickly. " + "A b c d e f g h i j k l. It was over then.")
    assert varied["cv_penalty"] == 0


def test_short_sentences_halve_the_penalty(spark):
    row = one(spark, "he ran far. she sat down. we saw it. they had two. you ate some. i read that.")
    assert row["mean_length"] == 3 and row["cv"] == 0 and row["cv_penalty"] == 0.5


def test_structure(spark):
    row = one(spark, "It is not a tool, it is a revolution. First, we go. Second, we stop. Third, we rest. There are three types of it. Imagine a world. Let's unpack this. To summarize, fine.")
    assert (row["redefinition"], row["over_numbered"], row["pre_classification"], row["imagine"], row["progress"], row["closing_summary"]) == (1, 1, 1, 1, 1, 1)
    mold = one(spark, "# T\nintro\n- a\n- b\nclosing\n" * 3)
    assert mold["section_mold"] == 1 and one(spark, "# T\nintro\n- a\nclosing\n" * 2)["section_mold"] == 0
    assert one(spark, "Therefore a.\n\nTherefore b.\n\nTherefore c.")["connector_monotony"] == 1
    assert one(spark, "```\nx\n```\nFirst we define it.\n```\ny\n```\nOther text.")["post_code"] == 1


def test_meta_and_the_roadmap(spark):
    assert one(spark, "In this section we look. Here it is. In this section again.")["meta_hits"] == 2
    long = "In this guide we go.\n" + "plain words go here now and then.\n" * 200
    row = one(spark, long)
    assert row["allowed_roadmap"] and row["meta_hits"] == 0
    assert not one(spark, long + "In this guide it ends.")["allowed_roadmap"]


def test_markdown(spark):
    row = one(spark, "# H\n\n- a\n- [ ] b\n1. c\n| x | y |\n| --- | --- |\n> quote\n***\ntext **bold** and *it* and `code` — end")
    assert (row["l"], row["heading_lines"], row["bullet_lines"], row["table_lines"], row["quote_lines"], row["rule_lines"], row["em_dashes"], row["code_spans"]) == (9, 1, 3, 2, 1, 1, 1, 1)
    assert row["bold_italic"] == 2
    assert 0 <= row["md"] <= 1


def test_bounds_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "leverage " * 500), (5, "- a: b\n" * 400)], "doc_id long, text string")
    for r in score.scored(docs).collect():
        assert 0 <= r["score"] <= 100 and all(0 <= r[c] <= 1 for c in score.WEIGHTS)
    assert {r["doc_id"] for r in score.scored(docs).where("bwd >= 0.8").collect()} == {4}
    assert score.scored(docs.where("doc_id = 4")).first()["guarded"] == ["bwd"]


def test_places(spark):
    text = "```\nleverage\n```\nWe leverage it,  in\norder to delve into.\nLet's dive in. `robust`"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sorted((r["start"], r["stop"], r["line"], r["component"], r["category"]) for r in score.located(docs).collect())
    assert [text.replace("’", "'")[a:b].lower() for a, b, *_ in rows] == ["leverage", "in\norder to", "delve into", "let's dive in", "let's dive in", "let's dive in"]
    assert [r[2] for r in rows] == [4, 4, 5, 6, 6, 6]
    assert {r[3] for r in rows if r[2] == 6} == {"bwd", "meta", "spv"}


def test_report_can_be_computed_by_hand(spark):
    docs = spark.createDataFrame([(1, "Furthermore, we leverage it. " * 8), (2, "plain")], "doc_id long, text string")
    out = {r["doc_id"]: json.loads(r["j"]) for r in score.report(docs).select("doc_id", F.to_json("report").alias("j")).collect()}
    parts = out[1]["components"]
    assert out[1]["slop_score"] == math.floor(100 * sum(p["weight"] * p["score"] for p in parts.values()) + 0.5)
    assert parts["banned_word_density"]["weighted_hits"] == 24 and len(out[1]["findings"]) == 16
    assert out[1]["findings"][0]["span"] == [0, 11] and out[2]["findings"] == []
