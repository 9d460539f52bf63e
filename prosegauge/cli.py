"""Command line: analyze, score, stdin, rounds, assess, rules."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.operators import findings, prompts, quality, reports, rounds
from prosegauge.shared import folder
from prosegauge.sources import documents, rules

#: Ends an answer on standard input, so that there may be another.
STOP = "."
#: The tool that is looked for on the path, and where keys of services are looked for.
TOOL, FIRST_KEY, SECOND_KEY = "PROSEGAUGE_TOOL", "PROSEGAUGE_FIRST_KEY", "PROSEGAUGE_SECOND_KEY"

Ask = Callable[[str], str]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="prosegauge", description="Find structural habits of generated prose.")
    top.add_argument("-r", "--rules-dir", default=str(rules.SHIPPED), help="folder of the rule pack")
    top.add_argument("-l", "--lang", default="auto", help="taken and without effect: rules hold for all languages")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("analyze", help="findings of a file as JSON").add_argument("file")
    old = sub.add_parser("score", help="deprecated: findings of a file, no score")
    old.add_argument("file")
    old.add_argument("-f", "--format", default="text")
    sub.add_parser("stdin", help="findings of standard input").add_argument("-f", "--format", default="text")
    loop = sub.add_parser("deslop", help="rounds of rewriting and analysis of a file")
    loop.add_argument("file")
    loop.add_argument("--max-rounds", type=int, default=3)
    loop.add_argument("--target-matches", type=int, default=0)
    loop.add_argument("--rules-dir", dest="own_rules_dir")
    loop.add_argument("--patterns-agent")
    loop.add_argument("--force-rewrite", action="store_true")
    loop.add_argument("--answers", help="folder of answers: round-N-response.txt, assessment.json; prompts are written there")
    loop.add_argument("--keep", help="folder for each round's findings, prompt and text")
    loop.add_argument("--policy", choices=("plain", "fenced"), default="plain", help="fenced: quote the heaviest findings, take fences off answers")
    either = loop.add_mutually_exclusive_group()
    either.add_argument("--assess", dest="assess", action="store_true", default=True)
    either.add_argument("--no-assess", dest="assess", action="store_false")
    pair = sub.add_parser("assess", help="compare a file with its rewrite")
    pair.add_argument("original")
    pair.add_argument("rewritten")
    sub.add_parser("rules", help="list the rule pack")
    return top


def interactive(prompt: str) -> str:
    """Show the prompt, read the answer from standard input: up to a line with a full stop alone, or to its end."""
    print(prompt, file=sys.stderr)
    lines = []
    for line in sys.stdin:
        if line.rstrip("\r\n") == STOP:
            break
        lines.append(line)
    return "".join(lines)


def chosen(backends: Mapping[str, Ask] | None, environment: Mapping[str, str] = os.environ) -> Ask:
    """Who is asked: of the given functions the one for what is found (tool, first, second service), else the user."""
    tool = prompts.key_of(environment, TOOL)
    name = prompts.backend(bool(tool) and prompts.found_command(tool), prompts.key_of(environment, FIRST_KEY), prompts.key_of(environment, SECOND_KEY))
    return (backends or {}).get(name, interactive)


class Loop:
    """Rounds on one file: who answers, and what is kept of each round under names that stay the same."""

    def __init__(self, file: str, ask: Ask, patterns: list[rules.Pattern], answers: str | None = None, keep: str | None = None):
        self.file, self.ask, self.patterns = Path(file), ask, patterns
        self.answers, self.keep, self.rounds = Path(answers) if answers else None, Path(keep) if keep else None, 0

    def kept(self, name: str, text: str) -> None:
        if self.keep:
            self.keep.mkdir(parents=True, exist_ok=True)
            (self.keep / name).write_text(text, encoding="utf-8")

    def answer(self, name: str, file: str, prompt: str) -> str:
        """From the folder of answers, where the prompt is left beside; else from whoever is asked."""
        if not self.answers:
            return self.ask(prompt)
        self.answers.mkdir(parents=True, exist_ok=True)
        (self.answers / f"{name}-prompt.md").write_text(prompt, encoding="utf-8")
        if not (self.answers / file).exists():
            raise SystemExit(f"no {self.answers / file}: put the answer to {name}-prompt.md there and call again")
        return (self.answers / file).read_text(encoding="utf-8")

    def findings_of(self, spark: SparkSession, text: str) -> str:
        return reports.as_json(findings.matched(documents.one(spark, text), self.patterns)).first()["report"]

    def rewriter(self, policy: rounds.Policy) -> rounds.Rewriter:
        def run(asked: DataFrame) -> DataFrame:
            spark, out = asked.sparkSession, []
            for r in asked.select("doc_id", "round", "text", "prompt").collect():  # one file
                self.rounds = r["round"]
                before = self.findings_of(spark, r["text"])
                if self.rounds > 1:
                    self.kept(f"round-{self.rounds - 1}-after.json", before)
                self.kept(f"round-{self.rounds}-before.json", before)
                self.kept(f"round-{self.rounds}-prompt.md", r["prompt"])
                response = self.answer(f"round-{self.rounds}", f"round-{self.rounds}-response.txt", r["prompt"])
                clean = F.lit(response)
                text = spark.range(1).select(rounds.unfenced(clean) if policy.unfence else clean).first()[0]
                self.kept(f"round-{self.rounds}-rewrite.txt", text)
                if text.strip():
                    self.file.write_text(text, encoding="utf-8")
                out.append((r["doc_id"], response))
            return spark.createDataFrame(out, "doc_id long, response string")

        return run

    def ended(self, spark: SparkSession, text: str) -> None:
        if self.rounds:
            self.kept(f"round-{self.rounds}-after.json", self.findings_of(spark, text))
        self.kept("cleaned.txt", text)


def assessed(spark: SparkSession, original: str, rewritten: str, ask: Ask) -> DataFrame:
    pair = spark.createDataFrame([(0, original, rewritten)], "doc_id long, original string, rewritten string")
    one_by_one = lambda asked: spark.createDataFrame([(r["doc_id"], ask(r["prompt"])) for r in asked.collect()], "doc_id long, response string")
    return quality.assess(pair, one_by_one)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, backends: Mapping[str, Ask] | None = None) -> int:
    """``backends`` are functions from a prompt to an answer, for cli, first_service and second_service."""
    args = parser().parse_args(argv)
    ask = chosen(backends)
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    pack = Path(getattr(args, "own_rules_dir", None) or args.rules_dir)
    if args.command in ("analyze", "score", "stdin"):
        if args.command == "score":
            print("Warning: 'score' is deprecated and computes no score; use 'analyze' for the findings.", file=sys.stderr)
        docs = documents.scan_stdin(spark) if args.command == "stdin" else documents.scan_file(spark, args.file)
        found = findings.matched(docs, rules.load(pack).patterns, lang=args.lang)
        form = "json" if args.command == "analyze" else args.format
        text = reports.report(found, form).first()["report"]
        print(json.dumps(json.loads(text), indent=2, ensure_ascii=False) if form == "json" else text)
    elif args.command == "rules":
        catalogue = pack / rules.CATEGORIES
        print(reports.listing(rules.load(pack), rules.load_categories(catalogue) if catalogue.exists() else []), end="")
    elif args.command == "assess":
        parsed = assessed(spark, Path(args.original).read_text(encoding="utf-8"), Path(args.rewritten).read_text(encoding="utf-8"), ask)
        return told(parsed)
    else:
        docs = documents.scan_file(spark, args.file)
        categories = rules.raw_categories(args.patterns_agent or pack / rules.CATEGORIES)
        patterns, policy = rules.load(pack).patterns, rounds.FENCED if args.policy == "fenced" else rounds.PLAIN
        before = docs.first()["text"]
        loop = Loop(args.file, ask, patterns, args.answers, args.keep)
        final, log = rounds.run(docs, patterns, loop.rewriter(policy), folder(spark), args.max_rounds, args.target_matches, args.force_rewrite, categories, policy)
        for r in log.where("phase = 'after'").orderBy("round").collect():
            print(f"round {r['round']}: {r['match_count']} structural matches remain", file=sys.stderr)
        text = final.first()["text"]
        loop.ended(spark, text)
        if args.assess:
            told(assessed(spark, before, text, lambda prompt: loop.answer("assessment", "assessment.json", prompt)), sys.stderr)
        print(text, end="")
    return 0


def told(parsed: DataFrame, stream=None) -> int:
    row = parsed.withColumn("json", F.to_json(F.struct(*quality.AXES, "overall", "notes"))).first()
    if row["error"]:
        print(row["error"], file=sys.stderr)
        return 1
    print(quality.text_lines(parsed).first()["report"] if stream else json.dumps(json.loads(row["json"]), indent=2, ensure_ascii=False), file=stream or sys.stdout)
    if row["low"] and not stream:
        print("WARNING: " + quality.DOUBT % row["overall"], file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
