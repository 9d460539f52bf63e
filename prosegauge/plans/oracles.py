"""DuckDB SQL that says in another way what the queries compute."""

from __future__ import annotations

import regex

from prosegauge.functions import prose
from prosegauge.operators import prompts, score
from prosegauge.sources import rules
from prosegauge.sources.documents import DECORATED

# Unicode white space, which this engine's \s is not, and the rules spelled with it.
S = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_S = S.replace("[", "[^", 1)
RULES = [
    ("bullet_block", "medium", 1.0, True, rf"(?m)(?:^{S}*[-*+]{S}+.+\n?){{3,}}"),
    ("emoji_decoration", "high", 2.0, False, "[✅🚀💡⚠📊✨🔥👉👍🎯]"),
    ("colon_heading", "high", 2.0, True, rf"(?m)^{S}{{0,3}}#{{1,6}}{S}*(?:\*\*)?[^:\n]{{1,80}}(?:\*\*)?{S}*:{S}+{NOT_S}.*$"),
    ("bold_emphasis", "medium", 0.5, False, r"(?:\*\*|__)[^*_\n]{1,80}(?:\*\*|__)"),
    ("em_dash", "high", 2.0, False, "—"),
    ("plus_conjunction", "medium", 1.5, False, rf"[\p{{L}}][\p{{L}}\p{{M}}\p{{N}}_-]*{S}*\+{S}*[\p{{L}}][\p{{L}}\p{{M}}\p{{N}}_-]*"),
]
O, C = "chr(64976)", "chr(64977)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


DECORATED_VIEW = f"docs AS (SELECT doc_id, lang, {DECORATED} AS text FROM documents)"
RAW_VIEW = "docs AS (SELECT doc_id, lang, text FROM documents)"


def one_rule(k: int) -> str:
    """Findings of one rule over ``docs``."""
    name, severity, weight, multi, rx = RULES[k]
    fixed = f"CAST({k} AS INT) AS rule_ord, {q(name)} AS pattern_name, {q(severity)} AS severity, CAST({weight} AS DOUBLE) AS weight"
    if multi:
        cut = f"SELECT doc_id, string_split(regexp_replace(text, {q('(' + rx + ')')}, {O} || '\\1' || {C}, 'g'), {O}) AS p FROM docs"
        rows = f"SELECT doc_id, p, unnest(range(2, len(p) + 1)) AS i FROM ({cut})"
        first = f"regexp_replace(string_split(string_split(p[i], {C})[1], chr(10))[1], {q(f'^{S}+|{S}+$')}, '', 'g')"
        feeds = "array_to_string(p[1:i-1], '')"
        return f"SELECT doc_id, {fixed}, CAST(i - 2 AS INT) AS match_ord, {first} AS matched_text, CAST(1 + length({feeds}) - length(replace({feeds}, chr(10), '')) AS INT) AS line_number FROM ({rows})"
    lines = "SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM docs)"
    hits = f"SELECT doc_id, n, unnest(m) AS t, unnest(range(len(m))) AS j FROM (SELECT doc_id, n, regexp_extract_all(line, {q(rx)}) AS m FROM ({lines}))"
    return f"SELECT doc_id, {fixed}, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, j) - 1 AS INT) AS match_ord, t AS matched_text, CAST(n AS INT) AS line_number FROM ({hits})"


def found(view: str = DECORATED_VIEW, only: int | None = None) -> str:
    """A WITH that ends in ``found``."""
    picked = range(len(RULES)) if only is None else [only]
    return with_(view, "found AS (" + "\nUNION ALL ".join(map(one_rule, picked)) + ")")


COLUMNS = "doc_id, rule_ord, match_ord, pattern_name, severity, weight, matched_text, line_number"


def n(list_expression: str) -> str:
    return f"len({list_expression})"


def hits(text: str, rx: str) -> str:
    return f"len(regexp_extract_all({text}, {q(rx)}))"


def blanked(text: str, rx: str) -> str:
    o, c = "chr(64982)", "chr(64983)"
    marked = f"string_split(regexp_replace({text}, {q('(' + rx + ')')}, {o} || '\\1' || {c}, 'g'), {o})"
    return f"array_to_string(list_transform({marked}, lambda p, i: CASE WHEN i = 1 THEN p ELSE regexp_replace(string_split(p, {c})[1], '[^\\n]', ' ', 'g') || string_split(p, {c})[2] END), '')"


def lines_like(rx: str) -> str:
    return f"len(list_filter(lines, lambda x: regexp_matches(x, {q(rx)})))"


def padded(words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda w: ' ' || w || ' '), '')"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, {q(prose.WORD)})"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


VIEWS = [
    f"prosed AS (SELECT doc_id, text, {blanked(blanked('replace(text, chr(13) || chr(10), chr(10))', prose.FRONT), prose.FENCED)} AS prose FROM docs)",
    f"cleaned AS (SELECT *, lower(replace({blanked('prose', prose.CODE_SPAN)}, '’', '''')) AS clean FROM prosed)",
    f"""viewed AS (SELECT *, {words("clean")} AS words, string_split(prose, chr(10)) AS lines,
  list_filter(list_transform(string_split_regex(clean, {q(prose.SENTENCE_END)}), lambda s: {words("s")}), lambda s: len(s) > 0) AS sentences,
  list_filter(list_transform(string_split_regex(clean, {q(prose.PARAGRAPH_END)}), lambda s: {words("s")}), lambda s: len(s) > 0) AS paragraphs,
  list_transform(string_split(regexp_replace(text, {q(prose.FENCED)}, chr(64982), 'g'), chr(64982))[2:], lambda p: list_concat({words("lower(replace(p, '’', ''''))")}[1:3], ['|'])) AS after
  FROM cleaned)""",
    f"sized AS (SELECT *, {padded('words')} AS padded, greatest(len(words), 1) AS w, len(sentences) AS s, greatest({lines_like('[^ \\t\\r]')}, 1) AS l FROM viewed)",
]


def _sentences() -> str:
    """One row for each sentence with its opener, ending and skeleton."""
    classes = " ".join(f"WHEN x IN {in_list(score.CLASSES[c])} THEN '{c}'" for c in "pdrc")
    skeleton = f"array_to_string(list_transform(sentence[1:8], lambda x: CASE {classes} WHEN regexp_matches(x, '^[0-9]') THEN 'n' WHEN x LIKE '%ly' THEN 'v' ELSE 'o' END), '')"
    content = f"list_filter(sentence, lambda x: x NOT IN {in_list(score.FUNCTION_WORDS)})"
    ending = f"CASE WHEN len({content}) >= 2 THEN array_to_string(({content})[-2:], ' ') ELSE sentence[-1] END"
    return f"""told AS (SELECT doc_id, k, sentence, sentence[1] AS opener, {ending} AS ending,
  CASE WHEN regexp_matches({skeleton}, '^o*$') THEN {skeleton} || CAST(k AS VARCHAR) ELSE {skeleton} END AS skeleton
  FROM (SELECT doc_id, unnest(sentences) AS sentence, unnest(range(len(sentences))) AS k FROM sized))"""


def score_parts() -> list[str]:
    """CTEs up to ``counts``: the raw counts, by rows and windows where the query uses arrays."""
    single, several = score.lexicon_phrases()
    heavy = in_list(sorted({prose.phrase(p) for p in several}))
    every = prose.either(single + several)
    meta = prose.either(score.META_PHRASES)
    coded = f"array_to_string(list_transform(lines, lambda x: CASE WHEN regexp_matches(x, {q(score.HEADING)}) THEN 'H' WHEN regexp_matches(x, {q(score.BULLET)}) THEN 'B' WHEN regexp_matches(x, '[^ \\t\\r]') THEN 'P' ELSE '' END), '')"
    ordinal = "array_to_string(list_transform(sentences, lambda x: CASE WHEN x[1] IN ('first', 'firstly') THEN '1' WHEN x[1] IN ('second', 'secondly') THEN '2' WHEN x[1] IN ('third', 'thirdly') THEN '3' ELSE '.' END), '')"
    top = padded(words("array_to_string(string_split(clean, chr(10))[1:CAST(ceil(len(lines) / 10.0) AS INT)], chr(10))"))
    bare = blanked("prose", score.BOLD)
    return [
        *VIEWS,
        _sentences(),
        "marked AS (SELECT *, count(*) OVER (PARTITION BY doc_id, opener) AS same_opener, count(*) OVER (PARTITION BY doc_id, ending) AS same_ending, k - row_number() OVER (PARTITION BY doc_id, skeleton ORDER BY k) AS island FROM told)",
        "islands AS (SELECT doc_id, skeleton, island, count(*) AS n FROM marked GROUP BY ALL)",
        "streaks AS (SELECT doc_id, count(*) FILTER (WHERE n >= 3) AS streaks, max(n) AS longest FROM islands GROUP BY doc_id)",
        "rhythm AS (SELECT doc_id, sum(len(sentence)) AS length_sum, sum(len(sentence) * len(sentence)) AS length_squares, count(*) FILTER (WHERE same_opener >= 3) AS openers_repeated, count(*) FILTER (WHERE same_ending >= 2) AS endings_repeated FROM marked GROUP BY doc_id)",
        f"groups AS (SELECT doc_id, count(*) AS groups FROM (SELECT doc_id, p[1] AS head FROM (SELECT doc_id, unnest(paragraphs) AS p FROM sized)) WHERE head IN {in_list(score.CONNECTORS)} GROUP BY doc_id, head HAVING count(*) >= 3)",
        "connectors AS (SELECT doc_id, count(*) AS connector_monotony FROM groups GROUP BY doc_id)",
        f"metas AS (SELECT doc_id, w, regexp_extract_all(padded, {q(meta)}) AS m, regexp_extract_all({top}, {q(meta)}) AS early FROM sized)",
        f"allowed AS (SELECT doc_id, len(m) AS m, w >= {score.LONG} AND len(list_filter(early, lambda e: len(list_filter(m, lambda x: x = e)) = 1)) > 0 AS ok FROM metas)",
        f"""counts AS (SELECT doc_id, CAST(w AS INT) AS w, CAST(s AS INT) AS s, CAST(l AS INT) AS l,
  CAST(len(list_filter(regexp_extract_all(padded, {q(every)}), lambda h: h NOT IN {heavy})) AS INT) AS banned_words,
  CAST(len(list_filter(regexp_extract_all(padded, {q(every)}), lambda h: h IN {heavy})) AS INT) AS banned_phrases,
  CAST({hits("padded", score.REDEFINITION)} AS INT) AS redefinition,
  CAST(coalesce(streaks, 0) AS INT) AS template_streak,
  CAST({hits(coded, "HP+B+P")} >= 3 AS INT) AS section_mold,
  CAST({hits(ordinal, "1[.]{0,2}2[.]{0,2}3")} AS INT) AS over_numbered,
  CAST({hits("clean", score.FIELD_DUMP)} AS INT) AS field_dump,
  CAST({hits("padded", prose.either(score.CLOSING))} AS INT) AS closing_summary,
  CAST(coalesce(connector_monotony, 0) AS INT) AS connector_monotony,
  CAST({hits("padded", prose.either(score.PROGRESS))} AS INT) AS progress,
  CAST({hits("padded", prose.either(score.CLASSIFYING))} AS INT) AS pre_classification,
  CAST({hits("padded", prose.either(score.IMAGINE))} AS INT) AS imagine,
  CAST({hits(padded("flatten(after)"), prose.either(score.AFTER_CODE))} AS INT) AS post_code,
  CAST(coalesce(length_sum, 0) AS BIGINT) AS length_sum, CAST(coalesce(length_squares, 0) AS BIGINT) AS length_squares,
  CAST(coalesce(openers_repeated, 0) AS INT) AS openers_repeated, CAST(coalesce(endings_repeated, 0) AS INT) AS endings_repeated,
  CAST(coalesce(longest, 0) AS INT) AS longest_streak,
  CAST(m - CAST(ok AS INT) AS INT) AS meta_hits, ok AS allowed_roadmap,
  CAST({lines_like(score.BULLET)} AS INT) AS bullet_lines, CAST({lines_like(score.HEADING)} AS INT) AS heading_lines, CAST({lines_like(score.TABLE)} AS INT) AS table_lines,
  CAST({hits("prose", score.BOLD)} + {hits(bare, "(?m)" + score.ITALIC)} AS INT) AS bold_italic,
  CAST({hits("prose", prose.CODE_SPAN)} AS INT) AS code_spans, CAST({lines_like(score.QUOTE)} AS INT) AS quote_lines, CAST({lines_like(score.RULE)} AS INT) AS rule_lines,
  CAST({hits("prose", "—")} AS INT) AS em_dashes
  FROM sized LEFT JOIN streaks USING (doc_id) LEFT JOIN rhythm USING (doc_id) LEFT JOIN connectors USING (doc_id) JOIN allowed USING (doc_id))""",
    ]


def d(number: float) -> str:
    return f"CAST({number} AS DOUBLE)"


def clip(x: str) -> str:
    return f"greatest(least({x}, {d(1)}), {d(0)})"


def component_parts() -> list[str]:
    """CTEs up to ``parts``: densities and the five components."""
    weighted = " + ".join(f"{d(w)} * {h}" for h, w in score.HABITS.items())
    return [
        *score_parts(),
        f"""dense AS (SELECT *, {d(1000)} * CAST(banned_words + 2 * banned_phrases AS DOUBLE) / w AS banned_density, {weighted} AS structural_hits,
  {d(1000)} * meta_hits / w AS meta_density, {d(1000)} * (bold_italic + code_spans + quote_lines + rule_lines + em_dashes) / w AS emphasis_density, greatest(s, 1) AS n FROM counts)""",
        f"denser AS (SELECT *, {d(1000)} * structural_hits / w AS structural_density, CAST(length_sum AS DOUBLE) / n AS mean_length, sqrt(CAST(n * length_squares - length_sum * length_sum AS DOUBLE)) / n AS deviation FROM dense)",
        f"""paced AS (SELECT *, deviation / greatest(mean_length, {d(1)}) AS cv, CAST(bullet_lines AS DOUBLE) / l AS bullet_ratio, CAST(heading_lines AS DOUBLE) / l AS heading_ratio, CAST(table_lines AS DOUBLE) / l AS table_ratio FROM denser)""",
        f"""parts AS (SELECT *, {clip(f"banned_density / {d(16)}")} AS bwd, {clip(f"structural_density / {d(10)}")} AS spv, {clip(f"meta_density / {d(6)}")} AS meta,
  CASE WHEN s < 5 THEN {d(0)} ELSE {d(0.5)} * (CASE WHEN mean_length < 8 THEN {d(0.5)} ELSE {d(1)} END * {clip(f"({d(0.55)} - cv) / {d(0.35)}")})
   + {d(0.2)} * {clip(f"(CAST(openers_repeated AS DOUBLE) / n - {d(0.15)}) / {d(0.25)}")} + {d(0.2)} * {clip(f"(CAST(endings_repeated AS DOUBLE) / n - {d(0.15)}) / {d(0.25)}")}
   + {d(0.1)} * {clip(f"(longest_streak - 2) / {d(4)}")} END AS rhy,
  {d(0.4)} * {clip(f"(bullet_ratio - {d(0.12)}) / {d(0.28)}")} + {d(0.2)} * {clip(f"(heading_ratio - {d(0.08)}) / {d(0.17)}")} + {d(0.2)} * {clip(f"table_ratio / {d(0.2)}")} + {d(0.2)} * {clip(f"(emphasis_density - {d(3)}) / {d(17)}")} AS md,
  CASE WHEN s < 5 THEN 'low' ELSE 'normal' END AS rhythm_sample_confidence FROM paced)""",
        f"final AS (SELECT *, CAST(round({d(100)} * (bwd * {d(0.25)} + spv * {d(0.25)} + rhy * {d(0.2)} + meta * {d(0.15)} + md * {d(0.15)})) AS INT) AS score FROM parts)",
        "banded AS (SELECT *, CASE WHEN score <= 9 THEN 'clean' WHEN score <= 24 THEN 'trace' WHEN score <= 44 THEN 'noticeable' WHEN score <= 64 THEN 'heavy' WHEN score <= 84 THEN 'severe' ELSE 'critical' END AS band FROM final)",
    ]


def scored(select: str, view: str = DECORATED_VIEW) -> str:
    return with_(view, *component_parts()) + select


EDGE = r"[\p{L}\p{M}\p{N}]"


def placed_parts() -> list[str]:
    """CTEs up to ``placed``: a row for each word or phrase that counts, where it stands in ``cleaned``."""
    single, several = score.lexicon_phrases()
    out = []
    for component, phrases in (("bwd", single + several), ("meta", score.META_PHRASES), ("spv", score.CLOSING + score.PROGRESS + score.IMAGINE)):
        spelled = sorted({"[\\s-]+".join(regex.findall(prose.WORD, p.lower().replace("’", "'"))) for p in phrases}, key=lambda f: (-f.count("+"), -len(f), f))
        cut = f"SELECT doc_id, string_split(regexp_replace(clean, {q('(' + '|'.join(spelled) + ')')}, {O} || '\\1' || {C}, 'g'), {O}) AS p FROM cleaned"
        rows = f"SELECT doc_id, p, unnest(range(2, len(p) + 1)) AS i FROM ({cut})"
        parts = f"string_split(p[i], {C})[1] AS text, replace(array_to_string(p[1:i-1], ''), {C}, '') AS head, array_to_string(string_split(array_to_string(p[i:], ''), {C})[2:], '') AS tail"
        out.append(f"SELECT doc_id, '{component}' AS component, {parts} FROM ({rows})")
    heavy = in_list(sorted({p.lower() for p in several}))
    fixes = values("entry, fix", sorted({(e.lower(), r) for _, e, r in rules.lexicon() if r}))
    return [
        "hits AS (" + "\nUNION ALL ".join(out) + ")",
        f"whole AS (SELECT *, regexp_replace(text, '\\s+', ' ', 'g') AS plain FROM hits WHERE NOT regexp_matches(head, {q(EDGE + chr(39) + '?$')}) AND NOT regexp_matches(tail, {q('^' + chr(39) + '?' + EDGE)}))",
        f"fixes AS ({fixes})",
        f"""placed AS (SELECT doc_id, component, CASE component WHEN 'meta' THEN 'meta_commentary' WHEN 'spv' THEN 'structural_pattern' ELSE CASE WHEN plain IN {heavy} THEN 'banned_phrase' ELSE 'banned_word' END END AS category,
  CASE WHEN component = 'bwd' AND plain IN {heavy} THEN 'high' ELSE 'medium' END AS severity, text, CAST(length(head) AS INT) AS start, CAST(length(head) + length(text) AS INT) AS stop,
  CAST(1 + length(head) - length(replace(head, chr(10), '')) AS INT) AS line, fix AS suggested_fix FROM whole LEFT JOIN fixes ON plain = entry)""",
    ]


# The components' names in a report.
LONG_NAMES = {"bwd": "banned_word_density", "spv": "structural_pattern_violations", "rhy": "rhythm_monotony", "meta": "meta_commentary_density", "md": "markdown_overuse"}


def report_rows() -> str:
    """What a report holds, without its JSON."""
    long = "CASE component " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LONG_NAMES.items()) + " END"
    told = f"told_of AS (SELECT doc_id, string_agg(start || '-' || stop || ' ' || line || ' ' || category || ' ' || severity || ' ' || {long} || ' ' || text || ' ' || coalesce(suggested_fix, '-'), ';' ORDER BY start, stop, component) AS findings FROM placed GROUP BY doc_id)"
    rounded = ", ".join(f"round({x}, 4) AS {x}" for x in ("bwd", "spv", "rhy", "meta", "md", "banned_density", "cv", "meta_density", "bullet_ratio", "emphasis_density"))
    select = f"SELECT doc_id, '0.1.0' AS version, score AS slop_score, band, w AS word_count, s AS sentence_count, {rounded}, allowed_roadmap, coalesce(findings, '') AS findings FROM banded LEFT JOIN told_of USING (doc_id)"
    return with_(DECORATED_VIEW, *component_parts(), *placed_parts(), told) + select


LINKED = "CASE WHEN doc_id % 3 = 0 THEN 'In conclusion,  let''s explore it.' || chr(10) || text || chr(10) || 'To summarize: let''s dive in.' ELSE text END"
LINKED_VIEW = f"docs AS (SELECT doc_id, lang, {LINKED} AS text FROM documents)"


def listing_rows(categories: list[tuple]) -> str:
    """The lines of the rule listing up to their descriptions, from the fixed values and the word table."""
    shown = lambda x: str(int(x)) if x == int(x) else repr(x)
    words = word_rows()
    lines = [f"Loaded {len(RULES)} banned patterns", f"Loaded {len(words)} banned words", f"Loaded {len(categories)} agent patterns", "", "Banned Patterns:"]
    lines += [f"  - {name} (scope: universal, severity: {severity}, weight: {shown(weight)}" for name, severity, weight, _, _ in RULES]
    lines += ["", "Banned Words:"]
    lines += [f"  - {word} (replacement: {'None' if fix is None else 'Some(' + chr(34) + fix + chr(34) + ')'}, weight: {shown(weight)})" for _, word, fix, weight in words]
    lines += ["", "Agent Patterns:"]
    lines += [f"  - {name} (severity: {severity}, weight: {shown(weight)}, examples: {n}" for name, severity, weight, n in categories]
    return values("line_number, line", [(k, x) for k, x in enumerate(lines)])


def prompt_rows() -> str:
    """The prompts of the first round, the findings' JSON put together by hand."""
    json = """'{"pattern_name":' || to_json(pattern_name) || ',"severity":' || to_json(severity) || ',"weight":' || CAST(weight AS VARCHAR) || ',"matched_text":' || to_json(matched_text) || ',"line_number":' || line_number || '}'"""
    top = "rank || '. [' || severity || '] ' || pattern_name || ' (weight ' || CAST(weight AS VARCHAR) || ') at line ' || line_number || ': ' || matched_text"
    part = lambda title, body: f"chr(10) || chr(10) || '## {title}' || chr(10) || {body}"
    sections = [part("Heaviest findings", f"coalesce(listed, {q(prompts.NOTHING)})"), part("Findings as JSON", "'[' || coalesce(found_json, '') || ']'"), part("Categories", q(rules.raw_categories())), part("Text", "text")]
    body = " || ".join([f"'Round: 1' || chr(10) || chr(10) || {q(prompts.TASK)}", *sections, f"chr(10) || chr(10) || {q(prompts.TASK)} || chr(10)"])
    return found() + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, rule_ord, match_ord) AS rank FROM found),
 heaviest AS (SELECT doc_id, string_agg({top}, chr(10) ORDER BY rank) AS listed FROM ranked WHERE rank <= 8 GROUP BY doc_id),
 all_found AS (SELECT doc_id, string_agg({json}, ',' ORDER BY rule_ord, match_ord) AS found_json FROM found GROUP BY doc_id)
 SELECT doc_id, {body} AS prompt FROM docs LEFT JOIN heaviest USING (doc_id) LEFT JOIN all_found USING (doc_id)"""


def values(columns: str, rows: list[tuple]) -> str:
    def cell(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, float):
            return d(x)
        return f"CAST({x} AS INT)" if isinstance(x, int) else q(str(x))

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


def word_rows() -> list[tuple]:
    """The words as a table of a file is read by eye: rows of the tables whose first column is Word."""
    rows, on = [], False
    for line in (rules.SHIPPED / rules.WORDS).read_text(encoding="utf-8").splitlines():
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        if line.startswith("| Word") or not line.startswith("|"):
            on = line.startswith("| Word")
        elif on and not line.startswith("| -"):
            rows.append((len(rows), cells[0], cells[1] or None, float(cells[2])))
    return rows


# The habits of Korean prose, a group a line.
KOREAN_NAMES = """
A about_regarding through in_terms point_sense related based_on have double_passive by_passive can_overuse purpose automated_passive noun_stack and_sentence abstract_subject
B parenthesized_english raw_english_term long_english_quote known_as
C mechanical_enumeration bullet_block generic_headings topic_sentence emoji heading_summary three_step binary_parallel numeric_index colon_heading
D conclusion_phrase importance_cliche list_intro hype personified_abstract closing_formula transformation_formula
E length_variation repeated_endings uniform_paragraphs
F degree_adverb double_modifier role_function suffix_abuse jeok_chain
G hedging double_hedge
H connector contrast_connector meta_entry ie
I geotida dependent_noun means_ending need_to needed ability_noun
J bold quote_emphasis em_dash parenthetical_aside
"""


def korean_rows() -> str:
    listed = [(f"{line.split()[0]}-{k}", name) for line in KOREAN_NAMES.strip().splitlines() for k, name in enumerate(line.split()[1:], 1)]
    return values("habit, name", listed)


#: Sentences of our own that hold the habits, one for each document by its key.
KOREAN_SENTENCES = [
    "우리는 날씨에 대해 말했고 편지를 통해 알렸다. 그리고 집에 갔다.",
    "이는 창문이 열리게 된다는 뜻이다. 하지만 비가 온다. 그러나 춥다.",
    "첫째, 빵이다. 둘째, 물이다. 셋째, 소금이다. 결론적으로 배가 고프다.",
    "매우 혁신적인 숟가락(spoon)을 위해 기다릴 필요가 있다고 했지만 할 수 있다.",
    "먼저 앉는다, 반면 너는 선다, 결국 모두 눕는다. 산인가, 바다인가 묻는다.",
    "아이의 친구의 개의 꼬리는 길다. 사회적 문화적 관점에서 보면 그렇다.",
    "1) 하나\n2) 둘\n## 결론\n즉, 끝이다. ‘아주 짧은 말’ (그리고 조금 더 긴 설명이다)",
]
_CHOSEN = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(KOREAN_SENTENCES)) + " END"


def korean_text(newline: str) -> str:
    return "text || " + newline + " || " + _CHOSEN.replace("\n", f"' || {newline} || '")


def korean_hits(habits: list[tuple]) -> str:
    parts = [f"SELECT doc_id, {q(h)} AS habit, {q(name)} AS name, {q(c)} AS component, CAST({hits('text', rx)} AS INT) AS hits FROM docs" for h, name, c, rx in habits if rx]
    return with_(f"docs AS (SELECT doc_id, {korean_text('chr(10)')} AS text FROM documents)", "every AS (" + "\nUNION ALL ".join(parts) + ")") + "SELECT * FROM every WHERE hits > 0"


SIGNED = "CASE doc_id % 4 WHEN 0 THEN 'Honestly, I was wrong. ' || text WHEN 1 THEN text || ' In my experience, for example, 12 of 40 did.' WHEN 2 THEN 'By the way, ' || text ELSE text END"


def human_rows(kinds: dict[str, list[str]]) -> str:
    signs = ", ".join(f"CAST({hits('padded', prose.either(ps))} AS INT) AS {kind}" for kind, ps in kinds.items())
    return with_(f"docs AS (SELECT doc_id, lang, {SIGNED} AS text FROM documents)", *VIEWS) + f"""SELECT doc_id, {signs}, CAST(len(list_filter(words, lambda w: regexp_matches(w, '^[0-9]+$'))) AS INT) AS numbers,
 CAST(len(list_distinct(list_transform(sentences, lambda s: len(s)))) AS INT) AS sentence_lengths FROM sized"""


def change_rows() -> str:
    own = lambda x: f"list_distinct({words(f'lower({x})')})"
    return with_(DECORATED_VIEW, *VIEWS).rstrip() + f""", pairs AS (SELECT doc_id, {own('o.text')} AS a, {own('s.text')} AS b, list_transform(sentences, lambda x: len(x)) AS sizes FROM sized s JOIN documents o USING (doc_id)),
 rates AS (SELECT doc_id, sizes, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS total FROM pairs)
 SELECT doc_id, CASE WHEN total = 0 THEN {d(0)} ELSE round(1 - shared / CAST(total AS DOUBLE), 4) END AS change_rate, CASE WHEN total = 0 THEN FALSE ELSE 1 - shared / CAST(total AS DOUBLE) > 0.5 END AS much_changed,
 len(list_filter(sizes, lambda n: n <= 6)) > 0 AND len(list_filter(sizes, lambda n: n >= 35)) > 0 AS varied_lengths FROM rates"""


def uniform_rows() -> str:
    counts = f"list_filter(list_transform(string_split_regex(clean, {q(prose.PARAGRAPH_END)}), lambda p: len(list_filter(string_split_regex(p, '[.!?]+'), lambda x: regexp_matches(x, {q(prose.WORD)})))), lambda n: n > 0)"
    return with_(DECORATED_VIEW, *VIEWS[:2]) + f"""SELECT doc_id, CAST(len(n) AS INT) AS paragraphs, len(n) >= 3 AND len(list_filter(n, lambda x: x NOT BETWEEN 3 AND 4)) = 0 AS uniform FROM (SELECT doc_id, {counts} AS n FROM cleaned)"""
