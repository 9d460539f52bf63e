"""Assessments, prompts, the loop, streaming and the command line."""

import io
import json

import pytest
from pyspark.sql import functions as F

from prosegauge import cli
from prosegauge.operators import prompts, quality, rounds
from prosegauge.sources import documents, rules
from prosegauge.streaming import files

GOOD = '{"coherence": 0.8, "completeness": 0.6, "readability": 1.0, "fidelity": 0.9, "notes": "fine"}'


def parsed(spark, text):
    return quality.parse(spark.createDataFrame([(1, text)], "doc_id long, response string")).first()


def test_answers_are_parsed(spark):
    row = parsed(spark, GOOD)
    assert row["overall"] == 0.825 and row["notes"] == "fine" and not row["low"] and row["error"] is None
    assert parsed(spark, f"Sure: {GOOD} as asked")["overall"] == 0.825
    assert parsed(spark, GOOD.replace(', "notes": "fine"', ', "overall": 0.1'))["overall"] == 0.825
    assert parsed(spark, GOOD.replace("0.8,", "0.0,").replace("0.9", "0.5"))["low"]
    again = quality.as_json(quality.parse(spark.createDataFrame([(1, GOOD)], "doc_id long, response string"))).first()["report"]
    assert json.loads(again) | {"overall": 0} == json.loads(GOOD) | {"overall": 0}


@pytest.mark.parametrize(("text", "error"), [("", "not valid JSON"), ("no", "not valid JSON"), ("} {", "not valid JSON"), (None, "not valid JSON"), ("{}", "coherence"), (GOOD.replace("0.8", "1.2"), "coherence"), (GOOD.replace("0.9", "-0.1"), "fidelity"), (GOOD.replace("1.0", "NaN"), "readability")])
def test_bad_answers_name_what_is_wrong(spark, text, error):
    row = parsed(spark, text)
    assert error in row["error"] and row["overall"] is None


def test_models_answers(spark):
    good = {"findings": [{"category": "unknown", "severity": "low", "text": "x", "span": None, "line": 1, "extra": 1}], "components": {"BWD": 0, "SPV": 1, "RHY": 0.5, "META": 0.5, "MD": 0.1}}
    cases = [good, good | {"findings": [{"category": "odd", "severity": "low", "text": "x"}]}, {k: v for k, v in good.items() if k != "findings"}, good | {"components": {"BWD": 2}}]
    rows = quality.check_answers(spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(9, "nope")], "doc_id long, response string"))
    errors = {r["doc_id"]: r["errors"] for r in rows.collect()}
    assert errors[0] == [] and errors[1] == ["a finding breaks the schema"] and errors[2] == ["findings are missing"] and len(errors[3]) == 5 and errors[9]


def test_prompts_and_backends(spark):
    docs = spark.createDataFrame([(1, "a — b"), (2, "c")], "doc_id long, text string")
    from prosegauge.operators.findings import matched

    found = matched(docs, rules.load().patterns)
    made = {r["doc_id"]: r["prompt"] for r in prompts.rewrite(found, "CATALOGUE", 2, top=True).collect()}
    assert all(x in made[1] for x in ("Round: 2", "CATALOGUE", "a — b", '"pattern_name":"em_dash"', "1. [high] em_dash", prompts.TASK))
    assert prompts.NOTHING in made[2]
    pair = spark.createDataFrame([(1, "old", "new")], "doc_id long, original string, rewritten string")
    text = prompts.assess(pair).first()["prompt"]
    assert "evaluation only" in text and all(a in text for a in (*quality.AXES, "notes", "old", "new"))
    assert prompts.backend(True, "k", "k") == "cli" and prompts.backend(False, "k", "k") == "first_service"
    assert prompts.backend(False, " ", "k") == "second_service" and prompts.backend(False, "", None) == "interactive"
    assert prompts.key_of({"K": "  "}, "K") is None and prompts.key_of({"K": " v "}, "K") == "v" and prompts.key_of({}, "K") is None
    assert prompts.found_command("sh") and not prompts.found_command("no-such-command-here")
    filled = spark.range(1).select(prompts.filled("{{SOURCE}}|{{TEXT}}|{{STRUCTURAL_MATCHES}}|{{AGENT_PATTERNS}}", F.lit("s"), F.lit("t {{SOURCE}}"), F.lit("m"), F.lit("c"))).first()[0]
    assert filled == "s|t {{SOURCE}}|m|c"


def loop(spark, tmp_path, texts, answers, **options):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame([(i, n, t) for (i, n), t in answers.items()] or [(-1, 0, "")], "doc_id long, round int, response string")
    final, log = rounds.run(docs, rules.load().patterns, rounds.answered(table), str(tmp_path), **options)
    return {r["doc_id"]: r["text"] for r in final.collect()}, sorted(tuple(r) for r in log.collect())


def test_rounds(spark, tmp_path):
    final, log = loop(spark, tmp_path, {1: "a — b — c", 2: "calm", 3: "x —"}, {(1, 1): "a — b", (1, 2): "a b", (3, 1): "x"})
    assert final == {1: "a b", 2: "calm", 3: "x"}
    assert log == [(1, 1, "after", 1), (1, 1, "before", 2), (1, 2, "after", 0), (1, 2, "before", 1), (3, 1, "after", 0), (3, 1, "before", 1)]


def test_targets_limits_and_force(spark, tmp_path):
    assert loop(spark, tmp_path, {1: "a —"}, {}, target=1) == ({1: "a —"}, [])
    assert loop(spark, tmp_path, {1: "a —"}, {}, max_rounds=0) == ({1: "a —"}, [])
    final, log = loop(spark, tmp_path, {1: "a"}, {(1, 1): "b"}, max_rounds=0, force=True)
    assert final == {1: "b"} and [r[1] for r in log] == [1, 1]
    final, log = loop(spark, tmp_path, {1: "—"}, {(1, n): "—" for n in (1, 2)}, max_rounds=2)
    assert [r[1] for r in log] == [1, 1, 2, 2]


@pytest.mark.parametrize("answer", ["", " \n　", None])
def test_blank_rewrites_are_errors(spark, tmp_path, answer):
    with pytest.raises(ValueError, match="no rewrite"):
        loop(spark, tmp_path, {1: "—"}, {(1, 1): answer})


def test_fences_are_taken_off(spark, tmp_path):
    cases = {"```md\na\nb\n```": "a\nb", "  ```\na\n```\n ": "a", "a ``` b": "a ``` b", "```\nopen": "open", " plain ": "plain", "```\n```": "", "```": ""}
    rows = spark.createDataFrame([(k, k) for k in cases], "k string, t string").select("k", rounds.unfenced(F.col("t")).alias("x")).collect()
    assert {r["k"]: r["x"] for r in rows} == cases
    final, _ = loop(spark, tmp_path, {1: "—"}, {(1, 1): "```\nnew\n```"}, policy=rounds.FENCED)
    assert final == {1: "new"}


def test_streaming_goes_on_where_it_ended(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a —"), (2, "b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    found = lambda: files.stream(spark, str(tmp_path / "in"), docs.schema, rules.load().patterns)
    for n in (1, 1):
        files.drained(found(), str(tmp_path / "out"), str(tmp_path / "state"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
    docs.write.mode("append").parquet(str(tmp_path / "in"))
    files.drained(found(), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("zeile eins\r\nzwei — ü".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    assert documents.scan_file(spark, str(tmp_path / "a.txt")).first()["text"] == "zeile eins\r\nzwei — ü"
    with pytest.raises(UnicodeDecodeError):
        documents.scan_file(spark, str(tmp_path / "b.txt"))
    assert documents.scan_stdin(spark, io.StringIO("x\ny")).first()["text"] == "x\ny"
    got = documents.scan_files(spark, str(tmp_path / "a.txt")).first()
    assert got["path"].endswith("a.txt") and got["text"].startswith("zeile")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.txt").write_text("a — b")
    assert cli.main(["analyze", str(tmp_path / "a.txt")], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["pattern_name"] == "em_dash"
    assert cli.main(["score", str(tmp_path / "a.txt"), "-f", "markdown"], spark) == 0
    said = capsys.readouterr()
    assert "Matches found: 1" in said.out and "deprecated" in said.err
    monkeypatch.setattr("sys.stdin", io.StringIO("calm"))
    assert cli.main(["-l", "ko", "stdin"], spark) == 0
    assert "Structural matches found: 0" in capsys.readouterr().out
    assert cli.main(["rules"], spark) == 0
    assert "Loaded 87 banned words" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO(GOOD))
    assert cli.main(["assess", str(tmp_path / "a.txt"), str(tmp_path / "a.txt")], spark) == 0
    assert json.loads(capsys.readouterr().out)["overall"] == 0.825
    monkeypatch.setattr("sys.stdin", io.StringIO("a and b"))
    assert cli.main(["deslop", str(tmp_path / "a.txt"), "--no-assess", "--max-rounds", "1"], spark) == 0
    assert (tmp_path / "a.txt").read_text() == "a and b" and capsys.readouterr().out == "a and b"


def test_rounds_of_a_file(spark, tmp_path, capsys, monkeypatch):
    file, keep = tmp_path / "a.txt", tmp_path / "kept"
    file.write_text("a — b")
    monkeypatch.setattr("sys.stdin", io.StringIO(f"a — c\n.\nall calm\n.\n{GOOD}"))
    assert cli.main(["deslop", str(file), "--keep", str(keep)], spark) == 0
    said = capsys.readouterr()
    assert file.read_text() == said.out == "all calm\n" and "overall: 0.8" in said.err
    assert sorted(p.name for p in keep.iterdir()) == ["cleaned.txt", *(f"round-{n}-{x}" for n in (1, 2) for x in ("after.json", "before.json", "prompt.md", "rewrite.txt"))]
    assert json.loads((keep / "round-1-after.json").read_text())[0]["pattern_name"] == "em_dash" and json.loads((keep / "round-2-after.json").read_text()) == []


def test_answers_in_files(spark, tmp_path, capsys):
    file, answers = tmp_path / "a.txt", tmp_path / "answers"
    file.write_text("a — b")
    call = ["deslop", str(file), "--answers", str(answers), "--policy", "fenced"]
    with pytest.raises(SystemExit, match="round-1-response.txt"):
        cli.main(call, spark)
    assert "Heaviest findings" in (answers / "round-1-prompt.md").read_text() and file.read_text() == "a — b"
    (answers / "round-1-response.txt").write_text("```text\na, b\n```\n")
    (answers / "assessment.json").write_text(GOOD)
    assert cli.main(call, spark) == 0
    assert file.read_text() == "a, b" == capsys.readouterr().out


def test_functions_that_answer(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.txt").write_text("a — b")
    monkeypatch.setattr(cli.os, "environ", {cli.SECOND_KEY: "k"})
    assert cli.chosen({"second_service": len}, {cli.SECOND_KEY: "k"}) is len and cli.chosen({"cli": len}, {}) is cli.interactive
    assert cli.chosen({"cli": len}, {cli.TOOL: "sh"}) is len and cli.chosen({"cli": len}, {cli.TOOL: "no-such-command-here"}) is cli.interactive
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "doc_id long, original string, rewritten string")
    answer = lambda asked: asked.where("doc_id = 1").selectExpr("doc_id", f"'{GOOD}' AS response")
    got = {r["doc_id"]: (r["overall"], r["error"]) for r in quality.assess(pairs, answer).collect()}
    assert got == {1: (0.825, None), 2: (None, "the assessment is not valid JSON")}
    scored = spark.createDataFrame([(1, 40), (2, 10)], "doc_id long, score int")
    beside = quality.beside(scored, spark.createDataFrame([(1, 0.5)], "doc_id long, naturalness double"))
    assert {tuple(r) for r in beside.collect()} == {(1, 40, 0.5), (2, 10, None)}


def test_arguments():
    args = cli.parser().parse_args(["deslop", "f"])
    assert (args.max_rounds, args.target_matches, args.force_rewrite, args.assess) == (3, 0, False, True)
    assert not cli.parser().parse_args(["deslop", "f", "--no-assess"]).assess
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["deslop", "f", "--assess", "--no-assess"])
    assert cli.parser().parse_args(["-r", "x", "deslop", "f", "--rules-dir", "y"]).own_rules_dir == "y"
