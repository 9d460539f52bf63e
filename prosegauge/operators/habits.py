"""Habits of Korean prose, signs of a human writer, and the checklist's further questions.

Diagnostics beside the score: none of them changes it. All are counts or flags
within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import prose
from prosegauge.functions.regexes import to_java
from prosegauge.operators import score

# A habit's number, name and the component it speaks for, and the Korean forms that the expressions
# look for. A habit without an expression is one of the universal rules or a figure of the rhythm.
KOREAN = [
    ("A-1", "about_regarding", "spv", "에 (?:대해서?|대하여)"),
    ("A-2", "through", "spv", "[을를] (?:통해서?|통하여)"),
    ("A-3", "in_terms", "spv", "에 있어서?"),
    ("A-4", "point_sense", "spv", "(?:라는|다는) 점에서"),
    ("A-5", "related", "spv", "[와과] 관련(?:하여|된)"),
    ("A-6", "based_on", "spv", "에 기반하여|[을를] 바탕으로"),
    ("A-7", "have", "spv", "가지고 있다"),
    ("A-8", "double_passive", "spv", "되어[지진]다|지게 된다"),
    ("A-9", "by_passive", "spv", "에 의해"),
    ("A-10", "can_overuse", "spv", "[할될] 수 있다"),
    ("A-11", "purpose", "spv", "[을를] 위해"),
    ("A-12", "automated_passive", "spv", "(?:만들|이루)어[지진]다"),
    ("A-13", "noun_stack", "spv", "(?:[가-힣]+의 ){3,}[가-힣]+"),
    ("A-14", "and_sentence", "spv", "(?m)(?:^|[.!?] )그리고 "),
    ("A-15", "abstract_subject", "spv", "(?:보여|시사)준다|제공한다"),
    ("B-1", "parenthesized_english", "spv", "[가-힣] ?\\([A-Za-z][A-Za-z .-]*\\)"),
    ("B-2", "raw_english_term", "spv", "(?i)(?:framework|pipeline)(?:은|는|이|가|을|를|의)"),
    ("B-3", "long_english_quote", "spv", '"[A-Za-z][^"\\n]{40,}"'),
    ("B-4", "known_as", "spv", "라고 알려진|로 일컬어지는"),
    ("C-1", "mechanical_enumeration", "spv", "첫째|둘째|셋째"),
    ("C-2", "bullet_block", "spv", None),
    ("C-3", "generic_headings", "spv", "(?m)^#{1,6} *(?:도입|본론|결론)"),
    ("C-4", "topic_sentence", "spv", "(?m)^[^\\n.]{5,40}(?:중요하다|핵심이다)[.]"),
    ("C-5", "emoji", "spv", None),
    ("C-6", "heading_summary", "spv", "이 섹션에서는"),
    ("C-7", "three_step", "spv", "먼저[^\\n]*반면[^\\n]*결국"),
    ("C-8", "binary_parallel", "spv", "인가, [^\\n?]{1,40}인가"),
    ("C-9", "numeric_index", "spv", "(?m)^[0-9]+\\) "),
    ("C-10", "colon_heading", "spv", None),
    ("D-1", "conclusion_phrase", "spv", "결론적으로|요약하자면"),
    ("D-2", "importance_cliche", "spv", "중요한 역할을 (?:한다|합니다)"),
    ("D-3", "list_intro", "spv", "다음과 같(?:다|은)"),
    ("D-4", "hype", "spv", "혁신적인|획기적인"),
    ("D-5", "personified_abstract", "spv", "(?:기술|시대)[은는이가] [^\\n.]{0,20}(?:말한다|요구한다)"),
    ("D-6", "closing_formula", "spv", "할 (?:때다|때이다|시점이다)"),
    ("D-7", "transformation_formula", "spv", "[가-힣]+에서 [가-힣]+으?로의? (?:전환|변화)"),
    ("E-1", "length_variation", "rhy", None),
    ("E-2", "repeated_endings", "rhy", None),
    ("E-3", "uniform_paragraphs", "rhy", None),
    ("F-1", "degree_adverb", "spv", "매우|굉장히|상당히"),
    ("F-2", "double_modifier", "spv", "빠르고 신속|크고 거대"),
    ("F-3", "role_function", "spv", "역할과 기능|의미와 가치"),
    ("F-4", "suffix_abuse", "spv", "적 (?:측면|관점)"),
    ("F-5", "jeok_chain", "spv", "(?:[가-힣]+적 ){2,}[가-힣]+"),
    ("G-1", "hedging", "spv", "것으로 보인다|듯하다"),
    ("G-2", "double_hedge", "spv", "수도 있을 것"),
    ("H-1", "connector", "spv", "(?m)(?:^|[.!?] )(?:또한|따라서)"),
    ("H-2", "contrast_connector", "spv", "하지만|그러나"),
    ("H-3", "meta_entry", "spv", "이는 |이 점에서|이 관점에서|이 말은"),
    ("H-4", "ie", "spv", "(?m)(?:^|[.!?] )즉,? "),
    ("I-1", "geotida", "spv", "것이다"),
    ("I-2", "dependent_noun", "spv", "[는은한할] (?:점|바|수|데)[은는이가을를에]"),
    ("I-3", "means_ending", "spv", "다는 (?:뜻|의미)(?:이)?다"),
    ("I-4", "need_to", "spv", "할 필요가 있다|해야 (?:한다|합니다)"),
    ("I-5", "needed", "spv", "[이가] 필요하다"),
    ("I-6", "ability_noun", "spv", "[가-힣]+ 능력"),
    ("J-1", "bold", "md", None),
    ("J-2", "quote_emphasis", "md", "‘[^’\\n]{1,20}’"),
    ("J-3", "em_dash", "md", None),
    ("J-4", "parenthetical_aside", "spv", "\\([^()\\n]{10,}\\)"),
]

# Our own: words by which a writer shows through.
HUMAN = {
    "honest": ["to be fair", "honestly", "frankly", "i was wrong", "i am not sure", "솔직히 말하면"],
    "specific": ["for example", "for instance", "such as", "예를 들어"],
    "perspective": ["in my experience", "in my opinion", "i think", "i believe", "개인적으로", "제 경험으로는"],
    "flow": ["anyway", "by the way", "mind you", "well then", "그나저나"],
}


def korean(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, habit, name, component, hits`` for each habit with an expression that the text meets. Null texts meet none."""
    body = F.coalesce(F.col(text), F.lit(""))
    every = [F.struct(F.lit(h).alias("habit"), F.lit(n).alias("name"), F.lit(c).alias("component"), F.regexp_count(body, F.lit(to_java(rx))).alias("hits")) for h, n, c, rx in KOREAN if rx]
    rows = docs.select(key, F.explode(F.filter(F.array(*every), lambda x: x["hits"] > 0)).alias("x"))
    return rows.select(key, "x.*")


def human(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts of the signs of each kind and of numbers, and how many different lengths its sentences have."""
    viewed = prose.settled(score.views(docs, key, text).select(key, "padded", "words", "sentences"))
    signs = [F.regexp_count("padded", F.lit(prose.any_of(phrases))).alias(kind) for kind, phrases in HUMAN.items()]
    numbers = F.size(F.filter("words", lambda w: w.rlike("^[0-9]+$"))).alias("numbers")
    lengths = F.size(F.array_distinct(F.transform("sentences", F.size))).alias("sentence_lengths")
    return viewed.select(key, *signs, numbers, lengths)


def change_rate(before: Column, after: Column) -> Column:
    """The share of different words of both texts that only one of them has; 0 for two without words."""
    words = lambda x: F.array_distinct(prose.words(F.lower(F.coalesce(x, F.lit("")))))
    union = F.size(F.array_union(words(before), words(after)))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(words(before), words(after))) / union)


def checklist(pairs: DataFrame, key: str = "doc_id", before: str = "original", after: str = "rewritten") -> DataFrame:
    """``key, change_rate, much_changed`` (over half), ``varied_lengths`` (a sentence of 6 words or fewer and one of 35 or more)."""
    sizes = F.transform(prose.sentences(prose.clean(prose.prose(F.col(after)))), F.size)
    made = pairs.select(key, change_rate(F.col(before), F.col(after)).alias("rate"), sizes.alias("sizes"))
    varied = F.exists("sizes", lambda n: n <= 6) & F.exists("sizes", lambda n: n >= 35)
    return prose.settled(made).select(key, F.round("rate", 4).alias("change_rate"), (F.col("rate") > 0.5).alias("much_changed"), varied.alias("varied_lengths"))


def uniform_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, paragraphs, uniform``: whether at least three paragraphs all have three or four sentences."""
    clean = prose.clean(prose.prose(F.col(text)))
    counts = F.transform(F.split(clean, prose.PARAGRAPH_END), lambda p: F.size(F.filter(F.split(p, r"[.!?]+"), lambda x: x.rlike(prose.WORD))))
    rows = prose.settled(docs.select(key, F.filter(counts, lambda n: n > 0).alias("n")))
    return rows.select(key, F.size("n").alias("paragraphs"), ((F.size("n") >= 3) & F.forall("n", lambda n: n.between(3, 4))).alias("uniform"))
