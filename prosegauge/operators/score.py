"""The 0 to 100 score of a text and its five components.

Pure column expressions over the text of one row: no shuffle, no Python. The
detectors of structural habits and of meta commentary are lists of phrases and
expressions of our own, English only; what needs a reader is not attempted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import prose
from prosegauge.functions.prose import clip01, any_of, phrase
from prosegauge.operators.findings import ignored
from prosegauge.sources.rules import lexicon

# Weights of the components and of the structural habits, bands and labels.
WEIGHTS = {"bwd": 0.25, "spv": 0.25, "rhy": 0.20, "meta": 0.15, "md": 0.15}
NAMES = {"bwd": "banned_word_density", "spv": "structural_pattern_violations", "rhy": "rhythm_monotony", "meta": "meta_commentary_density", "md": "markdown_overuse"}
HABITS = {"redefinition": 2.0, "template_streak": 2.0, "section_mold": 2.0, "over_numbered": 1.5, "field_dump": 1.5, "closing_summary": 1.0, "connector_monotony": 1.0, "progress": 1.0, "pre_classification": 1.0, "imagine": 1.0, "post_code": 1.0}
BANDS = [(9, "clean"), (24, "trace"), (44, "noticeable"), (64, "heavy"), (84, "severe"), (100, "critical")]
FUNCTION_WORDS = "a an the of to in for with and or but is are was were".split()
GUARD = 0.8
LEAST_SENTENCES = 5
LONG = 1000

# Our own choices: closed classes for the sentence skeleton, and the detectors' phrases, among which are those that the
# specification gives as examples.
CLASSES = {
    "p": "i you he she it we they me him her us them this that these those who which".split(),
    "d": "a an the my your his its our their each every some any no".split(),
    "r": "of to in for with on at by from about into over after under between through during before against".split(),
    "c": "and or but nor so yet because although while if when since unless".split(),
}
META_PHRASES = [
    "in this section", "in this article", "in this chapter", "in this guide", "this section explores", "this section covers", "this article explores",
    "by now you should", "the key takeaway", "here's what you need to know", "let's break this down", "let's dive in", "let's explore", "to summarize",
    "in summary", "in conclusion", "it's important to note", "it is important to note", "it's worth noting", "as we have seen", "as mentioned earlier",
]
CLOSING = ["to summarize", "in summary", "in conclusion", "to sum up", "in short", "to recap", "put simply", "at the end of the day"]
PROGRESS = ["let's take a closer look", "we'll examine", "we will examine", "let's unpack", "let's dig deeper", "let's explore", "let's dive in", "let's examine"]
CLASSIFYING = [f"there are {n} {kind}" for n in "two three four five several".split() for kind in "types kinds categories ways branches".split()] + ["we can divide this into", "can be divided into"]
IMAGINE = ["imagine a", "imagine that", "imagine you", "picture a", "picture this", "visualize the", "visualize a"]
AFTER_CODE = ["first we", "here we", "this code", "this snippet", "in this code", "the code above"]
CONNECTORS = "therefore moreover furthermore additionally however consequently thus also finally similarly".split()
REDEFINITION = r" (?:is|are|was|were)  not (?: [^ ]+ ){1,12}? (?:it|they|this|that)  (?:is|are|was|were) | isn't (?: [^ ]+ ){1,12}? it's | not (?: [^ ]+ ){1,8}? but | rather  than (?: [^ ]+ ){1,12}? it  is "
FIELD_DUMP = r"(?:contains|includes|consists of|has)[^.:\n]{0,60}:[ \t]*[\p{L}_]+[ \t]*(?::|,[ \t]*[\p{L}_]+[ \t]*,)"

HEADING = r"^[ ]{0,3}#{1,6}(?:[ \t]|$)"
BULLET = r"^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+"
TABLE = r"\|.*\||^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$"
QUOTE = r"^[ ]{0,3}>"
RULE = r"^[ ]{0,3}(?:-[ \t]*){3,}$|^[ ]{0,3}(?:\*[ \t]*){3,}$|^[ ]{0,3}(?:_[ \t]*){3,}$"
BOLD = r"(?:\*\*|__)[^*_\n]{1,80}(?:\*\*|__)"
ITALIC = r"\*[^*\s][^*\n]*\*|(?:^|[^\p{L}\p{N}_])_[^_\s][^_\n]*_"


def lexicon_phrases() -> tuple[list[str], list[str]]:
    """Single words (hyphenated ones count as such) and phrases."""
    single, several = [], []
    for section, entry, _ in lexicon():
        words = section in ("verbs", "adjectives", "nouns", "english_in_korean", "korean_adverbs") or (section == "korean" and " " not in entry)
        (single if words else several).append(entry)
    return single, several


def _count(text: Column, regex: str) -> Column:
    return F.regexp_count(text, F.lit(regex))


def _lines(column: Column, regex: str) -> Column:
    return F.size(F.filter(column, lambda x: x.rlike(regex)))


def _skeleton(sentence: Column) -> Column:
    """The coarse classes of the first eight words. Words of no class known here are all "o"."""

    def coarse(w: Column) -> Column:
        out = F.when(w.isin(CLASSES["p"]), "p")
        for code in "drc":
            out = out.when(w.isin(CLASSES[code]), code)
        return out.when(w.rlike(r"^[0-9]"), "n").when(w.endswith("ly"), "v").otherwise("o")

    return F.array_join(F.transform(F.slice(sentence, 1, 8), coarse), "")


def _told_apart(skeleton: Column, k: Column) -> Column:
    """A skeleton without a single known class says nothing, so it is made unlike its neighbours."""
    return F.when(skeleton.rlike("^o*$"), F.concat(skeleton, k.cast("string"))).otherwise(skeleton)


def _ending(sentence: Column) -> Column:
    """The last two content words, or else the last word."""
    content = F.filter(sentence, lambda w: ~w.isin(FUNCTION_WORDS))
    two = F.array_join(F.slice(content, -2, 2), " ")
    return F.when(F.size(content) >= 2, two).otherwise(F.element_at(sentence, -1))


def views(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the views of the text that the components share."""
    out = docs.select(key, prose.prose(F.col(text)).alias("prose"), prose.padded(F.flatten(_after_code(F.col(text)))).alias("after_code"))
    out = out.withColumn("clean", prose.clean(F.col("prose")))
    out = out.withColumn("words", prose.words(F.col("clean"))).withColumn("sentences", prose.sentences(F.col("clean")))
    out = out.withColumn("padded", prose.padded(F.col("words"))).withColumn("lines", F.split("prose", "\n"))
    out = out.withColumn("paragraphs", prose.paragraphs(F.col("clean")))
    return out.withColumn("w", F.greatest(F.size("words"), F.lit(1))).withColumn("s", F.size("sentences")).withColumn("l", F.greatest(_lines(F.col("lines"), r"[^ \t\r]"), F.lit(1)))


def _after_code(text: Column) -> Column:
    """For each fenced block the first three words after it, with a word that ends them."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(prose.FENCED), F.lit(f"{prose.OPEN}"))
    parts = F.split(marked, prose.OPEN)
    after = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(after, lambda p: F.concat(F.slice(prose.words(F.lower(F.replace(p, F.lit("’"), F.lit("'")))), 1, 3), F.array(F.lit("|"))))


def counts(viewed: DataFrame, key: str = "doc_id", ignore: str = "") -> DataFrame:
    """Raw counts, from which every component follows.

    Words and phrases that a line of ``ignore`` matches are not counted.
    """
    rules = ignored(ignore)

    def kept(found: Column) -> Column:
        for rule in rules:
            found = F.filter(found, lambda h: ~F.trim(F.replace(h, F.lit("  "), F.lit(" "))).rlike(rule))  # noqa: B023
        return found

    single, several = lexicon_phrases()
    hits = kept(F.regexp_extract_all("padded", F.lit(any_of(single + several)), F.lit(0)))
    heavy = sorted({phrase(p) for p in several})
    lines, sentences = F.col("lines"), F.col("sentences")
    coded = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(HEADING), "H").when(x.rlike(BULLET), "B").when(x.rlike(r"[^ \t\r]"), "P").otherwise("")), "")
    openers = F.transform(sentences, lambda s: F.get(s, F.lit(0)))
    ordinal = F.array_join(F.transform(openers, lambda o: F.when(o.isin("first", "firstly"), "1").when(o.isin("second", "secondly"), "2").when(o.isin("third", "thirdly"), "3").otherwise(".")), "")
    heads = F.transform("paragraphs", lambda p: F.get(p, F.lit(0)))
    repeated = F.lit(0)
    for c in CONNECTORS:
        repeated = repeated + (F.size(F.filter(F.col("heads"), lambda h: h == c)) >= 3).cast("int")  # noqa: B023
    lengths = F.transform(sentences, F.size)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, v: n + v)
    bare = prose.blanked(F.col("prose"), BOLD)
    base = viewed.withColumn("hits", hits).withColumn("heads", heads).withColumn("lengths", lengths).withColumn("skeletons", F.transform(sentences, lambda x, k: _told_apart(_skeleton(x), k)))
    base = base.withColumn("runs", prose.run_lengths(F.col("skeletons"))).withColumn("openers", F.sort_array(openers)).withColumn("endings", F.sort_array(F.transform(sentences, _ending)))
    top = prose.padded(prose.words(F.array_join(F.transform(F.slice(F.split("clean", "\n"), F.lit(1), F.ceil(F.size("lines") / 10).cast("int")), lambda x: x), "\n")))
    meta = kept(F.regexp_extract_all("padded", F.lit(any_of(META_PHRASES)), F.lit(0)))
    early = kept(F.regexp_extract_all(top, F.lit(any_of(META_PHRASES)), F.lit(0)))
    base = base.withColumn("meta_found", meta).withColumn("early", early)
    once = F.exists("early", lambda h: F.size(F.filter(F.col("meta_found"), lambda m: m == h)) == 1)
    allowed = (F.col("w") >= LONG) & once
    out = base.select(
        key,
        "w",
        "s",
        "l",
        F.size(F.filter("hits", lambda h: ~h.isin(heavy))).alias("banned_words"),
        F.size(F.filter("hits", lambda h: h.isin(heavy))).alias("banned_phrases"),
        _count(F.col("padded"), REDEFINITION).alias("redefinition"),
        F.size(F.filter("runs", lambda n: n >= 3)).alias("template_streak"),
        (_count(coded, "HP+B+P") >= 3).cast("int").alias("section_mold"),
        _count(ordinal, r"1\.{0,2}2\.{0,2}3").alias("over_numbered"),
        _count(F.col("clean"), FIELD_DUMP).alias("field_dump"),
        _count(F.col("padded"), any_of(CLOSING)).alias("closing_summary"),
        repeated.alias("connector_monotony"),
        _count(F.col("padded"), any_of(PROGRESS)).alias("progress"),
        _count(F.col("padded"), any_of(CLASSIFYING)).alias("pre_classification"),
        _count(F.col("padded"), any_of(IMAGINE)).alias("imagine"),
        _count(F.col("after_code"), any_of(AFTER_CODE)).alias("post_code"),
        total("lengths").alias("length_sum"),
        total(F.transform("lengths", lambda n: n.cast("long") * n)).alias("length_squares"),
        prose.runs(F.col("openers"), 3).alias("openers_repeated"),
        prose.runs(F.col("endings"), 2).alias("endings_repeated"),
        F.coalesce(F.array_max("runs"), F.lit(0)).alias("longest_streak"),
        (F.size("meta_found") - allowed.cast("int")).alias("meta_hits"),
        allowed.alias("allowed_roadmap"),
        _lines(lines, BULLET).alias("bullet_lines"),
        _lines(lines, HEADING).alias("heading_lines"),
        _lines(lines, TABLE).alias("table_lines"),
        (_count(F.col("prose"), BOLD) + _count(bare, "(?m)" + ITALIC)).alias("bold_italic"),
        _count(F.col("prose"), prose.CODE_SPAN).alias("code_spans"),
        _lines(lines, QUOTE).alias("quote_lines"),
        _lines(lines, RULE).alias("rule_lines"),
        _count(F.col("prose"), "—").alias("em_dashes"),
    )
    return prose.settled(out)


def components(counted: DataFrame) -> DataFrame:
    """The counts with densities, the five components (unrounded) and what the rhythm is made of."""
    c, per = F.col, lambda x: F.lit(1000.0) * x / F.col("w")
    out = counted.withColumn("banned_hits", (c("banned_words") + 2 * c("banned_phrases")).cast("double"))
    weighted = F.lit(0.0)
    for habit, weight in HABITS.items():
        weighted = weighted + F.lit(weight) * c(habit)
    out = out.withColumn("structural_hits", weighted)
    emphasis = c("bold_italic") + c("code_spans") + c("quote_lines") + c("rule_lines") + c("em_dashes")
    out = out.withColumns({"banned_density": per(c("banned_hits")), "structural_density": per(c("structural_hits")), "meta_density": per(c("meta_hits")), "emphasis_density": per(emphasis)})
    s = F.greatest(c("s"), F.lit(1))
    out = out.withColumn("mean_length", c("length_sum") / s).withColumn("deviation", F.sqrt((s * c("length_squares") - c("length_sum") * c("length_sum")).cast("double")) / s)
    out = out.withColumn("cv", c("deviation") / F.greatest(c("mean_length"), F.lit(1.0)))
    penalty = clip01((F.lit(0.55) - c("cv")) / 0.35)
    out = out.withColumns(
        {
            "cv_penalty": F.when(c("mean_length") < 8, 0.5 * penalty).otherwise(penalty),
            "opener_penalty": clip01((c("openers_repeated") / s - 0.15) / 0.25),
            "ending_penalty": clip01((c("endings_repeated") / s - 0.15) / 0.25),
            "streak_penalty": clip01((c("longest_streak") - 2) / F.lit(4.0)),
            "bullet_ratio": c("bullet_lines") / c("l"),
            "heading_ratio": c("heading_lines") / c("l"),
            "table_ratio": c("table_lines") / c("l"),
        }
    )
    rhythm = 0.5 * c("cv_penalty") + 0.2 * c("opener_penalty") + 0.2 * c("ending_penalty") + 0.1 * c("streak_penalty")
    markdown = 0.4 * clip01((c("bullet_ratio") - 0.12) / 0.28) + 0.2 * clip01((c("heading_ratio") - 0.08) / 0.17) + 0.2 * clip01(c("table_ratio") / 0.2) + 0.2 * clip01((c("emphasis_density") - 3) / 17)
    return out.withColumns(
        {
            "bwd": clip01(c("banned_density") / 16),
            "spv": clip01(c("structural_density") / 10),
            "rhy": F.when(c("s") < LEAST_SENTENCES, 0.0).otherwise(rhythm),
            "meta": clip01(c("meta_density") / 6),
            "md": markdown,
            "rhythm_sample_confidence": F.when(c("s") < LEAST_SENTENCES, "low").otherwise("normal"),
        }
    )


def final(bwd: Column, spv: Column, rhy: Column, meta: Column, md: Column) -> Column:
    """The weighted sum times 100, rounded once, half up."""
    parts = zip((bwd, spv, rhy, meta, md), WEIGHTS.values(), strict=True)
    total = None
    for part, weight in parts:
        total = part * weight if total is None else total + part * weight
    return F.round(100 * total).cast("int")


def band(score: Column) -> Column:
    out = F.when(score <= BANDS[0][0], BANDS[0][1])
    for top, name in BANDS[1:-1]:
        out = out.when(score <= top, name)
    return out.otherwise(BANDS[-1][1])


def label(kind: str, density: Column) -> Column:
    """The signal's name for a density per thousand words."""
    if kind == "spv":
        steps = [(1, "clean/trace"), (3, "light"), (5, "moderate"), (10, "high")]
        out = F.when(density < steps[0][0], steps[0][1])
        for top, name in steps[1:]:
            out = out.when(density < top, name)
        return out.otherwise("severe")
    tops = {"bwd": (2, 5, 8, 16), "meta": (1, 2, 3.33, 6)}[kind]
    out = F.when(density <= 0, "clean")
    for top, name in zip(tops, ("trace", "light", "moderate", "high"), strict=True):
        out = out.when(density < top, name)
    return out.otherwise("severe")


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", ignore: str = "") -> DataFrame:
    """Counts, components, ``score``, ``band``, and which components need cleaning whatever the score."""
    out = components(counts(views(docs, key, text), key, ignore))
    names = list(WEIGHTS)
    guarded = F.array_compact(F.array(*[F.when(F.col(n) >= GUARD, n) for n in names]))
    out = out.withColumn("score", final(*[F.col(n) for n in names])).withColumn("band", band(F.col("score")))
    return out.withColumns({"guarded": guarded, "bwd_signal": label("bwd", F.col("banned_density")), "spv_signal": label("spv", F.col("structural_density")), "meta_signal": label("meta", F.col("meta_density"))})


def _between(parts: Column) -> Column:
    """What lies in marks, from a text cut at the opening ones: its text, where it starts and ends, its line."""
    sizes = F.transform(parts, lambda p, k: F.struct((F.length(p) - (k > 0).cast("int")).alias("n"), (F.length(p) - F.length(F.replace(p, F.lit("\n")))).alias("feeds")))

    def one(p: Column, k: Column, sizes: Column) -> Column:
        none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("feeds"))
        before = F.aggregate(F.slice(sizes, F.lit(1), k + 1), none, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), (a["feeds"] + x["feeds"]).alias("feeds")))
        inside = F.substring_index(p, prose.CLOSE, 1)
        return F.struct(inside.alias("text"), before["n"].alias("start"), (before["n"] + F.length(inside)).alias("stop"), before["feeds"].alias("line"))

    return prose.let(sizes, lambda s: F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, k: one(p, k, s)))


PLACE = "array<struct<start:int,stop:int,component:string,category:string,severity:string,text:string,line:int,suggested_fix:string>>"


def places(clean: Column, ignore: str = "") -> Column:
    """An array of the words and phrases that count, with their places (``PLACE``), for all components."""
    single, several = lexicon_phrases()
    both = sorted({p.lower() for p in several})
    fixes = {e.lower(): r for _, e, r in lexicon() if r}
    known = F.create_map(*[F.lit(x) for pair in sorted(fixes.items()) for x in pair])
    rules, out = ignored(ignore), []
    for component, phrases in (("bwd", single + several), ("meta", META_PHRASES), ("spv", CLOSING + PROGRESS + IMAGINE)):

        def told(m: Column) -> Column:
            plain = F.regexp_replace(m["text"], r"\s+", " ")
            heavy = plain.isin(both) if component == "bwd" else F.lit(False)  # noqa: B023
            category = {"meta": F.lit("meta_commentary"), "spv": F.lit("structural_pattern")}.get(component, F.when(heavy, "banned_phrase").otherwise("banned_word"))  # noqa: B023
            severity = F.when(heavy, "high").otherwise("medium")
            return F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(component).alias("component"), category.alias("category"), severity.alias("severity"), m["text"].alias("text"), m["line"].alias("line"), F.try_element_at(known, plain).alias("suggested_fix"))

        marked = F.regexp_replace(clean, F.lit(spelled(phrases)), F.lit(f"{prose.OPEN}$0{prose.CLOSE}"))
        found = prose.let(F.split(marked, prose.OPEN), _between)
        for rule in rules:
            found = F.filter(found, lambda m: ~F.regexp_replace(m["text"], r"\s+", " ").rlike(rule))  # noqa: B023
        out.append(F.transform(found, told))
    return F.concat(*out).cast(PLACE)


def located(docs: DataFrame, key: str = "doc_id", text: str = "text", ignore: str = "") -> DataFrame:
    """Findings of words and phrases with their place: ``start``, ``stop`` (characters), ``line``.

    ``component`` is bwd, meta or spv; one place may be found for several.
    """
    base = docs.select(key, prose.clean(prose.prose(F.col(text))).alias("clean"))
    rows = base.select(key, F.explode(places(F.col("clean"), ignore)).alias("p"))
    return rows.select(key, *[F.col(f"p.{f}").alias(f) for f in ("component", "category", "severity", "text", "start", "stop", "line", "suggested_fix")])


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Places that count both as meta commentary and as a structural habit: ``key``, both places, the line."""
    base = prose.settled(docs.select(key, prose.clean(prose.prose(F.col(text))).alias("clean")).select(key, places(F.col("clean")).alias("p")))
    meta, habit = F.filter("p", lambda x: x["component"] == "meta"), F.filter("p", lambda x: x["component"] == "spv")

    def met(m: Column) -> Column:
        over = F.filter(habit, lambda h: (m["start"] < h["stop"]) & (h["start"] < m["stop"]))
        return F.transform(over, lambda h: F.struct(m["start"].alias("meta_start"), m["stop"].alias("meta_stop"), h["start"].alias("spv_start"), h["stop"].alias("spv_stop"), m["line"].alias("line")))

    return base.select(key, F.explode(F.flatten(F.transform(meta, met))).alias("x")).select(key, "x.*")


def spelled(phrases: list[str]) -> str:
    """An expression that meets the phrases in running text, whatever white space or hyphens join their words."""
    import regex

    forms = {r"[\s-]+".join(regex.findall(prose.WORD, p.lower().replace("’", "'"))) for p in phrases}
    edge = r"[\p{L}\p{M}\p{N}]"
    return f"(?<!{edge})(?<!{edge}')(?:" + "|".join(sorted(forms, key=lambda f: (-f.count("+"), -len(f), f))) + f")(?!{edge})(?!'{edge})"


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", ignore: str = "") -> DataFrame:
    """``key, report``: one nested record for each document, with enough counts to compute the score by hand."""
    # the findings go along with the key, so that neither is read or joined again
    placed = F.sort_array(places(prose.clean(prose.prose(F.col(text))), ignore))
    carried = docs.select(F.struct(F.col(key).alias("key"), placed.alias("found")).alias("_row"), F.col(text).alias("text"))
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    finding = lambda f: F.struct(F.array(f["start"], f["stop"]).alias("span"), f["line"].alias("line"), f["category"].alias("category"), f["severity"].alias("severity"), f["text"].alias("text"), f["suggested_fix"].alias("suggested_fix"), F.try_element_at(names, f["component"]).alias("component"))
    r4 = lambda x: F.round(F.col(x), 4).alias
    parts = {
        "bwd": [F.col("banned_hits").alias("weighted_hits"), r4("banned_density")("density_per_1000_words")],
        "spv": [F.col("structural_hits").alias("weighted_hits"), r4("structural_density")("density_per_1000_words")],
        "rhy": [r4("cv")("coefficient_of_variation"), F.col("rhythm_sample_confidence")],
        "meta": [F.col("meta_hits").alias("hits"), r4("meta_density")("density_per_1000_words"), F.col("allowed_roadmap")],
        "md": [r4("bullet_ratio")("bullet_ratio"), r4("heading_ratio")("heading_ratio"), r4("table_ratio")("table_ratio"), r4("emphasis_density")("emphasis_density_per_1000_words")],
    }
    made = F.struct(*[F.struct(F.lit(WEIGHTS[n]).alias("weight"), r4(n)("score"), *parts[n]).alias(NAMES[n]) for n in WEIGHTS])
    made_of = scored(carried, "_row", "text", ignore)
    record = F.struct(
        F.lit("0.1.0").alias("version"),
        F.col("score").alias("slop_score"),
        F.col("band"),
        F.col("w").alias("word_count"),
        F.col("s").alias("sentence_count"),
        made.alias("components"),
        F.transform("_row.found", finding).alias("findings"),
    )
    return made_of.select(F.col("_row.key").alias(key), record.alias("report"))
