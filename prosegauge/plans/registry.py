"""Named queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions import prose
from prosegauge.operators import findings, habits, prompts, quality, reports, rounds, score
from prosegauge.plans import oracles as sql
from prosegauge.shared import folder
from prosegauge.sources import documents, rules
from prosegauge.streaming import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


@cache
def pack() -> rules.Ruleset:
    return rules.load()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.findings(documents.decorated(spark, sf_dir), pack().patterns)


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.matched(documents.decorated(spark, sf_dir), pack().patterns)


def r4(*names: str):
    return [F.round(F.col(x), 4).alias(x) for x in names]


def r4_sql(*names: str) -> str:
    return ", ".join(f"round({x}, 4) AS {x}" for x in names)


# Catalogues


@query("rule_catalog", sql.values("rule_ord, name, lang_scope, severity, weight, is_multiline", [(k, name, "universal", sev, w, multi) for k, (name, sev, w, multi, _) in enumerate(sql.RULES)]))
def rule_catalog(spark, sf_dir):
    return rules.pattern_table(spark, pack().patterns).select("rule_ord", "name", "lang_scope", "severity", "weight", "is_multiline")


@query("word_catalog", sql.values("word_ord, word, replacement, weight", sql.word_rows()))
def word_catalog(spark, sf_dir):
    return rules.word_table(spark, pack().words)


# The categories' names, severities, weights and numbers of examples.
CATEGORIES = [
    ("translationese", "high", 2.0, 8), ("structural_monotony", "high", 2.0, 6), ("cliche_formulaic", "medium", 1.5, 6), ("rhythm", "medium", 1.5, 6), ("modifier_abuse", "medium", 1.25, 6),
    ("hedging", "medium", 1.25, 6), ("meta_commentary", "medium", 1.5, 6), ("connector_abuse", "medium", 1.25, 6), ("dependency_clause_overuse", "medium", 1.25, 6),
]


@query("agent_catalog", sql.values("name, severity, weight, examples", CATEGORIES))
def agent_catalog(spark, sf_dir):
    return rules.category_table(spark, rules.load_categories()).select("name", "severity", "weight", F.size("examples").alias("examples"))


# Findings


def _scan(k: int) -> Query:
    return lambda spark, sf_dir: findings.findings(documents.decorated(spark, sf_dir), [pack().patterns[k]]).withColumn("rule_ord", F.lit(k))


for _k, _name in enumerate(("bullet_block", "emoji", "colon_heading", "bold", "em_dash", "plus")):
    query(f"scan_{_name}", sql.found(only=_k) + f"SELECT {sql.COLUMNS} FROM found")(_scan(_k))

query("findings_all", sql.found() + f"SELECT {sql.COLUMNS} FROM found")(found)


@query("findings_raw_documents", sql.found(sql.RAW_VIEW) + f"SELECT {sql.COLUMNS} FROM found")
def findings_raw_documents(spark, sf_dir):
    return findings.findings(documents.scan_table(spark, sf_dir), pack().patterns)


@query("findings_pages", sql.found("docs AS (SELECT page_id AS doc_id, html AS text FROM pages)") + f"SELECT {sql.COLUMNS} FROM found")
def findings_pages(spark, sf_dir):
    return findings.findings(documents.scan_table(spark, sf_dir, "pages", "page_id", "html"), pack().patterns)


@query("match_count_per_doc", sql.found() + "SELECT doc_id, count(rule_ord) AS match_count FROM docs LEFT JOIN found USING (doc_id) GROUP BY doc_id")
def match_count_per_doc(spark, sf_dir):
    return findings.counted(matched(spark, sf_dir))


@query("count_by_pattern", sql.found() + "SELECT pattern_name, count(*) AS matches, count(DISTINCT doc_id) AS docs FROM found GROUP BY pattern_name")
def count_by_pattern(spark, sf_dir):
    return found(spark, sf_dir).groupBy("pattern_name").agg(F.count("*").alias("matches"), F.countDistinct("doc_id").alias("docs"))


@query("count_by_severity", sql.found() + "SELECT severity, count(*) AS matches, sum(weight) AS weight FROM found GROUP BY severity")
def count_by_severity(spark, sf_dir):
    return found(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("matches"), F.sum("weight").alias("weight"))


@query("weight_sum_per_doc", sql.found() + "SELECT doc_id, sum(weight) AS weight FROM found GROUP BY doc_id")
def weight_sum_per_doc(spark, sf_dir):
    return findings.weighed(matched(spark, sf_dir))


@query("docs_over_target", sql.found() + "SELECT doc_id, count(*) AS match_count FROM found GROUP BY doc_id HAVING count(*) > 2")
def docs_over_target(spark, sf_dir):
    return findings.over_target(match_count_per_doc(spark, sf_dir), 2)


@query("docs_with_findings", sql.found() + "SELECT doc_id, lang FROM docs WHERE doc_id IN (SELECT doc_id FROM found)")
def docs_with_findings(spark, sf_dir):
    return matched(spark, sf_dir).where(F.size("matches") > 0).select("doc_id", "lang")


@query("clean_docs", sql.found() + "SELECT doc_id, lang FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM found)")
def clean_docs(spark, sf_dir):
    return matched(spark, sf_dir).where(F.size("matches") == 0).select("doc_id", "lang")


@query("slopignore_filter", sql.found() + f"SELECT {sql.COLUMNS} FROM found WHERE NOT regexp_matches(matched_text, '^- ') AND NOT regexp_matches(matched_text, 'planning')")
def slopignore_filter(spark, sf_dir):
    return findings.suppressed(found(spark, sf_dir), "# kept as it is\n\n^- \nplanning\n")


# Reports

_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, rule_ord, match_ord) AS rank FROM found)"


@query("top8_violations", sql.found() + f', {_RANKED} SELECT doc_id, CAST(rank AS INT) AS rank, pattern_name AS type, line_number AS line, severity, weight, matched_text FROM ranked WHERE rank <= 8')
def top8_violations(spark, sf_dir):
    return reports.violations(matched(spark, sf_dir))


_TEXT_LINE = "'  [' || severity || '] ' || pattern_name || ' (weight: ' || printf('%.1f', weight) || ') - Line ' || line_number || ': ' || matched_text || chr(10)"
_MD_LINE = "'- **' || pattern_name || '** (severity: ' || severity || ', weight: ' || printf('%.1f', weight) || ')' || chr(10) || '  - Line ' || line_number || ': ' || matched_text || chr(10) || chr(10)"


def _report_sql(head: str, line: str) -> str:
    rows = f"rows AS (SELECT doc_id, count(*) AS n, string_agg({line}, '' ORDER BY rule_ord, match_ord) AS body FROM found GROUP BY doc_id)"
    return sql.found() + f", {rows} SELECT doc_id, {head} || coalesce(body, '') AS report FROM docs LEFT JOIN rows USING (doc_id)"


@query("report_text", _report_sql("'Structural matches found: ' || coalesce(n, 0) || chr(10)", _TEXT_LINE))
def report_text(spark, sf_dir):
    return reports.plain(matched(spark, sf_dir))


@query("report_markdown", _report_sql("'# AI Slop Structural Match Report' || chr(10) || chr(10) || 'Matches found: ' || coalesce(n, 0) || chr(10) || chr(10)", _MD_LINE))
def report_markdown(spark, sf_dir):
    return reports.markdown(matched(spark, sf_dir))


@query("report_json", sql.found() + "SELECT doc_id, pattern_name, severity, weight, matched_text, line_number FROM found")
def report_json(spark, sf_dir):
    """The JSON text, read back: the spacing of JSON differs between engines."""
    return reports.read_json(reports.as_json(matched(spark, sf_dir))).drop("match_ord")


_SUMMARY = "'. [' || severity || '] ' || pattern_name"


@query("delegate_context", sql.found() + f", {_RANKED}, top AS (SELECT doc_id, string_agg(rank || {_SUMMARY} || ' line ' || line_number || ': ' || matched_text, chr(10) ORDER BY rank) AS e FROM ranked WHERE rank <= 8 GROUP BY doc_id), counts AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id) SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n, coalesce(e, '') AS evidence FROM docs LEFT JOIN top USING (doc_id) LEFT JOIN counts USING (doc_id)")
def delegate_context(spark, sf_dir):
    made = reports.delegate_context(matched(spark, sf_dir))
    parts = F.split("context", "\n\n")
    body = F.array_join(F.slice(parts, F.lit(3), F.size(parts) - 3), "\n\n")
    return made.select("doc_id", F.regexp_extract("context", r"findings: (\d+)\.", 1).cast("int").alias("n"), body.alias("evidence"))


@query("rules_listing", sql.listing_rows(CATEGORIES))
def rules_listing(spark, sf_dir):
    """The lines up to notes and descriptions, which are free text."""
    lines = reports.listing(pack(), rules.load_categories()).splitlines()
    listed = spark.createDataFrame(list(enumerate(lines)), "line_number int, line string")
    return listed.withColumn("line", F.regexp_replace("line", r"(?:, note: .*)?, description: .*$", ""))


# Views of the text


@query("prep_lines", sql.with_(sql.DECORATED_VIEW, sql.VIEWS[0]) + "SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INT) AS line_number, unnest(l) AS line FROM (SELECT doc_id, string_split(prose, chr(10)) AS l FROM prosed)")
def prep_lines(spark, sf_dir):
    lines = documents.decorated(spark, sf_dir).select("doc_id", F.posexplode(F.split(prose.prose(F.col("text")), "\n")).alias("k", "line"))
    return lines.select("doc_id", (F.col("k") + 1).alias("line_number"), "line")


@query("prep_words", sql.with_(sql.DECORATED_VIEW, *sql.VIEWS) + "SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM sized) GROUP BY word")
def prep_words(spark, sf_dir):
    return score.views(documents.decorated(spark, sf_dir)).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("prep_sentences", sql.with_(sql.DECORATED_VIEW, *sql.VIEWS) + "SELECT doc_id, CAST(unnest(range(len(sentences))) AS INT) AS k, array_to_string(unnest(sentences), ' ') AS sentence FROM sized")
def prep_sentences(spark, sf_dir):
    rows = score.views(documents.decorated(spark, sf_dir)).select("doc_id", F.posexplode("sentences").alias("k", "s"))
    return rows.select("doc_id", "k", F.array_join("s", " ").alias("sentence"))


# The score

_COUNTS = "w s l banned_words banned_phrases redefinition template_streak section_mold over_numbered field_dump closing_summary connector_monotony progress pre_classification imagine post_code length_sum length_squares openers_repeated endings_repeated longest_streak meta_hits allowed_roadmap bullet_lines heading_lines table_lines bold_italic code_spans quote_lines rule_lines em_dashes".split()


@query("score_counts", sql.with_(sql.DECORATED_VIEW, *sql.score_parts()) + f"SELECT doc_id, {', '.join(_COUNTS)} FROM counts")
def score_counts(spark, sf_dir):
    return score.counts(score.views(documents.decorated(spark, sf_dir)))


def scored(spark, sf_dir) -> DataFrame:
    return score.scored(documents.decorated(spark, sf_dir))


def _component(name: str, exact: list[str], rounded: list[str]) -> None:
    chosen = f"SELECT doc_id, {', '.join([*exact, r4_sql(*rounded)])} FROM banded"
    query(name, sql.scored(chosen))(lambda spark, sf_dir: scored(spark, sf_dir).select("doc_id", *exact, *r4(*rounded)))


_component("bwd", ["banned_words", "banned_phrases"], ["banned_density", "bwd"])
_component("spv", ["template_streak", "section_mold"], ["structural_hits", "structural_density", "spv"])
_component("rhy", ["s", "rhythm_sample_confidence"], ["mean_length", "cv", "rhy"])
_component("meta", ["meta_hits", "allowed_roadmap"], ["meta_density", "meta"])
_component("md", ["bullet_lines", "table_lines"], ["bullet_ratio", "heading_ratio", "table_ratio", "emphasis_density", "md"])
_component("slop_score", ["score", "band"], ["bwd", "spv", "rhy", "meta", "md"])


@query("slop_score_raw", sql.scored("SELECT doc_id, score, band FROM banded", sql.RAW_VIEW))
def slop_score_raw(spark, sf_dir):
    return score.scored(documents.scan_table(spark, sf_dir)).select("doc_id", "score", "band")


@query("band_distribution", sql.scored("SELECT lang, band, count(*) AS docs, sum(score) AS total FROM banded JOIN docs USING (doc_id) GROUP BY ROLLUP (lang, band)"))
def band_distribution(spark, sf_dir):
    docs = documents.decorated(spark, sf_dir).select(F.struct("doc_id", "lang").alias("row"), "text")
    return score.scored(docs, "row").select("row.lang", "band", "score").rollup("lang", "band").agg(F.count("*").alias("docs"), F.sum("score").alias("total"))


@query("guardrail", sql.scored("SELECT doc_id, score, array_to_string(list_filter(['bwd', 'spv', 'rhy', 'meta', 'md'], lambda n: CASE n WHEN 'bwd' THEN bwd WHEN 'spv' THEN spv WHEN 'rhy' THEN rhy WHEN 'meta' THEN meta ELSE md END >= 0.8), ',') AS guarded FROM banded WHERE greatest(bwd, spv, rhy, meta, md) >= 0.8"))
def guardrail(spark, sf_dir):
    return scored(spark, sf_dir).where(F.size("guarded") > 0).select("doc_id", "score", F.array_join("guarded", ",").alias("guarded"))


@query("score_ignoring", sql.scored("SELECT doc_id, banned_words, banned_phrases, meta_hits FROM banded").replace("lambda h: h NOT IN", "lambda h: h != ' robust ' AND h NOT IN").replace("lambda h: h IN", "lambda h: h != ' in  order  to ' AND h IN"))
def score_ignoring(spark, sf_dir):
    """Hits that a list of expressions suppresses don't count."""
    counts = score.scored(documents.decorated(spark, sf_dir), ignore="# ours\n^robust$\n^in order to$")
    return counts.select("doc_id", "banned_words", "banned_phrases", "meta_hits")


@query("signal_labels", sql.scored("""SELECT doc_id,
 CASE WHEN banned_density <= 0 THEN 'clean' WHEN banned_density < 2 THEN 'trace' WHEN banned_density < 5 THEN 'light' WHEN banned_density < 8 THEN 'moderate' WHEN banned_density < 16 THEN 'high' ELSE 'severe' END AS bwd_signal,
 CASE WHEN structural_density < 1 THEN 'clean/trace' WHEN structural_density < 3 THEN 'light' WHEN structural_density < 5 THEN 'moderate' WHEN structural_density < 10 THEN 'high' ELSE 'severe' END AS spv_signal,
 CASE WHEN meta_density <= 0 THEN 'clean' WHEN meta_density < 1 THEN 'trace' WHEN meta_density < 2 THEN 'light' WHEN meta_density < CAST(3.33 AS DOUBLE) THEN 'moderate' WHEN meta_density < 6 THEN 'high' ELSE 'severe' END AS meta_signal FROM banded"""))
def signal_labels(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "bwd_signal", "spv_signal", "meta_signal")


@query("checklist_flags", sql.scored("SELECT doc_id, bullet_ratio >= CAST(0.8 AS DOUBLE) AS mostly_bullets, meta_hits * 300 > w AS much_meta, s >= 5 AND cv < CAST(0.1 AS DOUBLE) AS flat_lengths FROM banded"))
def checklist_flags(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", (F.col("bullet_ratio") >= 0.8).alias("mostly_bullets"), (F.col("meta_hits") * 300 > F.col("w")).alias("much_meta"), ((F.col("s") >= 5) & (F.col("cv") < 0.1)).alias("flat_lengths"))


# Diagnostics beside the score


@query("korean_catalog", sql.korean_rows())
def korean_catalog(spark, sf_dir):
    return spark.createDataFrame([h[:2] for h in habits.KOREAN], "habit string, name string")


@query("korean_hits", sql.korean_hits(habits.KOREAN))
def korean_hits(spark, sf_dir):
    """Habits in documents to which a Korean sentence is added."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", F.expr(sql.korean_text("char(10)")).alias("text"))
    return habits.korean(docs)


@query("human_signs", sql.human_rows(habits.HUMAN))
def human_signs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", F.expr(sql.SIGNED).alias("text"))
    return habits.human(docs)


@query("checklist_changes", sql.change_rows())
def checklist_changes(spark, sf_dir):
    """Documents against their decorated texts."""
    plain = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", F.col("text").alias("original"), F.expr(documents.DECORATED).alias("rewritten"))
    return habits.checklist(plain)


@query("uniform_paragraphs", sql.uniform_rows())
def uniform_paragraphs(spark, sf_dir):
    return habits.uniform_paragraphs(documents.decorated(spark, sf_dir))


_WORDS, _PHRASES = score.lexicon_phrases()
_LEXICON = [(prose.phrase(p), kind) for kind, ps in (("word", _WORDS), ("phrase", _PHRASES)) for p in ps]


def _hit_sql(kind: str | None) -> str:
    keep = f" WHERE kind = '{kind}'" if kind else ""
    table = f"lexicon AS ({sql.values('entry, kind', sorted(set(_LEXICON)))})"
    hit = f"hit AS (SELECT doc_id, unnest(regexp_extract_all(padded, {sql.q(prose.either(_WORDS + _PHRASES))})) AS entry FROM sized)"
    return sql.with_(sql.DECORATED_VIEW, *sql.VIEWS, table, hit) + f"SELECT doc_id, trim(replace(entry, '  ', ' ')) AS entry, kind, count(*) AS hits FROM hit JOIN lexicon USING (entry){keep} GROUP BY ALL"


def hit_rows(spark, sf_dir) -> DataFrame:
    """Lexicon hits by document, entry and kind; the lexicon has a fixed, small size."""
    table = spark.createDataFrame(sorted(set(_LEXICON)), "entry string, kind string")
    rows = score.views(documents.decorated(spark, sf_dir)).select("doc_id", F.explode(F.regexp_extract_all("padded", F.lit(prose.any_of(_WORDS + _PHRASES)), F.lit(0))).alias("entry"))
    joined = rows.join(F.broadcast(table), "entry")
    return joined.groupBy("doc_id", F.trim(F.replace("entry", F.lit("  "), F.lit(" "))).alias("entry"), "kind").agg(F.count("*").alias("hits"))


query("banned_hits", _hit_sql(None))(hit_rows)
query("phrase_hits", _hit_sql("phrase"))(lambda spark, sf_dir: hit_rows(spark, sf_dir).where("kind = 'phrase'"))
query("word_minus_phrase", _hit_sql("word"))(lambda spark, sf_dir: hit_rows(spark, sf_dir).where("kind = 'word'"))

_TOLD = sql.with_(sql.DECORATED_VIEW, *sql.VIEWS, sql._sentences())


def _sentence_rows(spark, sf_dir) -> DataFrame:
    viewed = score.views(documents.decorated(spark, sf_dir))
    rows = viewed.select("doc_id", F.posexplode("sentences").alias("k", "s"))
    return rows.select("doc_id", "k", F.get("s", F.lit(0)).alias("opener"), score._ending(F.col("s")).alias("ending"), score._told_apart(score._skeleton(F.col("s")), F.col("k")).alias("skeleton"))


@query("template_streaks", _TOLD + "SELECT doc_id, skeleton, CAST(min(k) AS INT) AS first, count(*) AS length FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id, skeleton ORDER BY k) AS island FROM told) GROUP BY doc_id, skeleton, island HAVING count(*) >= 3")
def template_streaks(spark, sf_dir):
    viewed = score.views(documents.decorated(spark, sf_dir)).select("doc_id", F.transform("sentences", lambda s, k: score._told_apart(score._skeleton(s), k)).alias("sk"))
    viewed = prose.settled(viewed)
    starts = F.filter(F.sequence(F.lit(0), F.size("sk") - 1), lambda k: (k == 0) | (F.get("sk", k) != F.get("sk", F.greatest(k - 1, F.lit(0)))))
    rows = viewed.where(F.size("sk") > 0).withColumn("at", starts)
    rows = rows.select("doc_id", "sk", "at", F.posexplode("at").alias("i", "first"))
    rows = rows.select("doc_id", F.get("sk", F.col("first")).alias("skeleton"), "first", (F.coalesce(F.get("at", F.col("i") + 1), F.size("sk")) - F.col("first")).cast("bigint").alias("length"))
    return rows.where("length >= 3")


@query("opener_repeats", _TOLD + "SELECT doc_id, opener, count(*) AS n FROM told GROUP BY doc_id, opener HAVING count(*) >= 3")
def opener_repeats(spark, sf_dir):
    return _sentence_rows(spark, sf_dir).groupBy("doc_id", "opener").agg(F.count("*").alias("n")).where("n >= 3")


@query("ending_repeats", _TOLD + "SELECT doc_id, ending, count(*) AS n FROM told GROUP BY doc_id, ending HAVING count(*) >= 2")
def ending_repeats(spark, sf_dir):
    return _sentence_rows(spark, sf_dir).groupBy("doc_id", "ending").agg(F.count("*").alias("n")).where("n >= 2")


_PLACED = "doc_id, component, category, severity, text, start, stop, line, suggested_fix"


@query("score_findings", sql.with_(sql.DECORATED_VIEW, *sql.VIEWS, *sql.placed_parts()) + f"SELECT {_PLACED} FROM placed")
def score_findings(spark, sf_dir):
    return score.located(documents.decorated(spark, sf_dir))


def linked_docs(spark, sf_dir) -> DataFrame:
    """Documents of which a third have phrases that count for both."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", F.expr(sql.LINKED.replace("chr(10)", "char(10)").replace("''", "\\'")).alias("text"))


@query("meta_spv_links", sql.with_(sql.LINKED_VIEW, *sql.VIEWS, *sql.placed_parts()) + "SELECT m.doc_id, m.start AS meta_start, m.stop AS meta_stop, h.start AS spv_start, h.stop AS spv_stop, m.line FROM placed m JOIN placed h ON m.doc_id = h.doc_id AND m.component = 'meta' AND h.component = 'spv' AND m.start < h.stop AND h.start < m.stop")
def meta_spv_links(spark, sf_dir):
    """Places that count both as meta commentary and as a structural habit."""
    return score.links(linked_docs(spark, sf_dir))


@query("score_report", sql.report_rows())
def score_report(spark, sf_dir):
    """The JSON text, read back: the spacing of JSON differs between engines."""
    made = score.report(documents.decorated(spark, sf_dir))
    back = prose.settled(made.select("doc_id", F.from_json(F.to_json("report"), made.schema["report"].dataType).alias("r")))
    part = {n: F.col(f"r.components.{long}") for n, long in score.NAMES.items()}
    told = lambda f: F.concat_ws(" ", F.concat_ws("-", f["span"][0], f["span"][1]), f["line"], f["category"], f["severity"], f["component"], f["text"], F.coalesce(f["suggested_fix"], F.lit("-")))
    return back.select(
        "doc_id",
        "r.version",
        "r.slop_score",
        "r.band",
        "r.word_count",
        "r.sentence_count",
        *[part[n]["score"].alias(n) for n in part],
        part["bwd"]["density_per_1000_words"].alias("banned_density"),
        part["rhy"]["coefficient_of_variation"].alias("cv"),
        part["meta"]["density_per_1000_words"].alias("meta_density"),
        part["md"]["bullet_ratio"].alias("bullet_ratio"),
        part["md"]["emphasis_density_per_1000_words"].alias("emphasis_density"),
        part["meta"]["allowed_roadmap"].alias("allowed_roadmap"),
        F.array_join(F.transform("r.findings", told), ";").alias("findings"),
    )


@query("score_from_components", "SELECT CAST(39 AS INT) AS score, 'noticeable' AS band")
def score_from_components(spark, sf_dir):
    """The worked example: .50, .30, .40, .50 and .25 make 39."""
    example = score.final(*[F.lit(x) for x in (0.5, 0.3, 0.4, 0.5, 0.25)])
    return spark.range(1).select(example.alias("score"), score.band(example).alias("band"))


# Assessments


def _answers(spark, sf_dir) -> DataFrame:
    """Made answers: plain, wrapped in prose, out of range, or no JSON, by the key's last digit."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    body = F.expr("""concat('{"coherence": ', doc_id % 11 / 10.0D, ', "completeness": 0.6, "readability": 1.0, "fidelity": 0.9', if(doc_id % 2 = 0, ', "notes": "n"', ''), '}')""")
    text = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("Here it is: "), body, F.lit(" as asked."))).when(F.col("doc_id") % 10 == 4, "no answer").when(F.col("doc_id") % 10 == 5, F.replace(body, F.lit('completeness": 0.6'), F.lit('completeness": 1.6'))).otherwise(body)
    return docs.select("doc_id", text.alias("response"))


@query("quality_parse", f"""WITH a AS (SELECT doc_id, (doc_id % 11) / {sql.d(10)} AS c, doc_id % 10 AS k FROM documents),
 b AS (SELECT *, CASE WHEN k = 4 THEN 'the assessment is not valid JSON' WHEN k = 5 THEN 'completeness score must be between 0.0 and 1.0' END AS error FROM a)
 SELECT doc_id, CASE WHEN error IS NULL THEN c END AS coherence, CASE WHEN error IS NULL THEN round((c + {sql.d(0.6)} + {sql.d(1)} + {sql.d(0.9)}) * {sql.d(0.25)}, 4) END AS overall,
 CASE WHEN error IS NULL THEN CASE WHEN doc_id % 2 = 0 THEN 'n' ELSE '' END END AS notes, CASE WHEN error IS NULL THEN (c + {sql.d(0.6)} + {sql.d(1)} + {sql.d(0.9)}) * {sql.d(0.25)} < {sql.d(0.6)} END AS low, error FROM b""")
def quality_parse(spark, sf_dir):
    parsed = quality.parse(_answers(spark, sf_dir))
    return parsed.select("doc_id", "coherence", *r4("overall"), "notes", "low", "error")


@query("quality_report", f"""SELECT doc_id, 'Quality assessment:' || chr(10) || '  coherence: ' || printf('%.2f', (doc_id % 11) / {sql.d(10)}) || chr(10) || '  completeness: 0.60' || chr(10) || '  readability: 1.00' || chr(10) || '  fidelity: 0.90' || chr(10) AS head
 FROM documents WHERE doc_id % 10 NOT IN (4, 5)""")
def quality_report(spark, sf_dir):
    parsed = quality.parse(_answers(spark, sf_dir)).where("error is null")
    return quality.text_lines(parsed).select("doc_id", F.regexp_extract("report", r"(?s)\A(.*?)  overall", 1).alias("head"))


@query("agent_answers", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'MD must be between 0 and 1' ELSE 'a finding breaks the schema' END AS errors FROM documents""")
def agent_answers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    text = F.expr("""concat('{"findings": [{"category": "', if(doc_id % 3 = 2, 'nonsense', 'banned_word'), '", "severity": "low", "text": "x", "line": 1, "span": [0, 1]}], "components": {"BWD": 0.5, "SPV": 0, "RHY": 1, "META": 0.25, "MD": ', if(doc_id % 3 = 1, '1.5', '0.5'), '}}')""")
    return quality.check_answers(docs.select("doc_id", text.alias("response"))).select("doc_id", F.array_join("errors", ";").alias("errors"))


# Rounds

_CALM = "A calm text."


def _loop(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = documents.decorated(spark, sf_dir)
    plain = documents.scan_table(spark, sf_dir)
    first = plain.select("doc_id", F.lit(1).alias("round"), F.when(F.trim("text") == "", _CALM).otherwise(F.col("text")).alias("response"))
    later = plain.select("doc_id", F.lit(2).alias("round"), F.lit(_CALM).alias("response"))
    return rounds.run(docs, pack().patterns, rounds.answered(first.unionByName(later)), folder(spark), max_rounds=3)


_BOTH = sql.with_(sql.DECORATED_VIEW, "found AS (" + " UNION ALL ".join(map(sql.one_rule, range(6))) + ")", "a AS (SELECT doc_id, count(rule_ord) AS n FROM docs LEFT JOIN found USING (doc_id) GROUP BY doc_id)")
_AFTER = sql.found(sql.RAW_VIEW).replace("WITH ", "", 1).replace("docs AS (", "plain AS (", 1).replace("found AS (", "later AS (", 1).replace("FROM docs", "FROM plain")
_LOG = _BOTH + ", " + _AFTER + """, b AS (SELECT doc_id, count(rule_ord) AS n FROM plain LEFT JOIN later USING (doc_id) GROUP BY doc_id),
 log AS (SELECT doc_id, 1 AS round, 'before' AS phase, n AS match_count FROM a WHERE n > 0 UNION ALL SELECT doc_id, 1, 'after', b.n FROM b JOIN a USING (doc_id) WHERE a.n > 0
 UNION ALL SELECT doc_id, 2, 'before', b.n FROM b JOIN a USING (doc_id) WHERE a.n > 0 AND b.n > 0 UNION ALL SELECT doc_id, 2, 'after', 0 FROM b JOIN a USING (doc_id) WHERE a.n > 0 AND b.n > 0) """


@query("rewrite_rounds", _LOG + "SELECT doc_id, round, phase, match_count FROM log")
def rewrite_rounds(spark, sf_dir):
    return _loop(spark, sf_dir)[1]


@query("round_delta", _LOG + "SELECT doc_id, round, max(match_count) FILTER (WHERE phase = 'before') AS before, max(match_count) FILTER (WHERE phase = 'after') AS after, max(match_count) FILTER (WHERE phase = 'after') - max(match_count) FILTER (WHERE phase = 'before') AS change FROM log GROUP BY doc_id, round")
def round_delta(spark, sf_dir):
    return rounds.deltas(_loop(spark, sf_dir)[1])


@query("rewrite_prompts", sql.prompt_rows())
def rewrite_prompts(spark, sf_dir):
    return prompts.rewrite(matched(spark, sf_dir), rules.raw_categories(), 1, top=True)


@query("clean_responses", "SELECT doc_id, regexp_replace(text, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g') AS response FROM documents WHERE regexp_replace(text, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g') NOT LIKE '```%'")
def clean_responses(spark, sf_dir):
    """Answers in fences come out as they were without."""
    docs = documents.scan_table(spark, sf_dir)
    fenced = F.concat(F.lit("\n```text\n"), F.col("text"), F.lit("\n```\n"))
    return docs.where(~findings.trimmed(F.col("text")).startswith("```")).select("doc_id", rounds.unfenced(fenced).alias("response"))


# Streaming


@query("streaming_findings", sql.found(sql.RAW_VIEW) + f"SELECT {sql.COLUMNS} FROM found")
def streaming_findings(spark, sf_dir):
    at = folder(spark)
    table = f"{sf_dir.rstrip('/')}/documents.parquet"
    schema = spark.read.parquet(table).schema
    streamed = files.stream(spark, table + "*", schema, pack().patterns)
    files.drained(streamed, f"{at}/found", f"{at}/state")
    return spark.read.schema(streamed.schema).parquet(f"{at}/found")
