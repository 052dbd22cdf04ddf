"""SQL of the queries for another engine (RE2 regular expressions, list functions with lambdas)."""

from __future__ import annotations

from factloom import lexicon as L
from factloom.functions.text import BLANK
from factloom.operators.classify import CLASSIFIERS

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(words: set[str]) -> str:
    return "(" + ", ".join(q(w) for w in sorted(words)) + ")"


def norm(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '’‘“”', '''''\"\"'), {q(BLANK + '+')}, ' ', 'g'), ' ' || chr(9) || chr(10) || '\"''.,')"


def folded(x: str) -> str:
    return f"trim(regexp_replace(translate(lower(coalesce({x}, '')), '’‘“”', '''''\"\"'), {q(BLANK + '+')}, ' ', 'g'))"


def both(a: str = "summary", b: str = "quote") -> str:
    return f"concat_ws(' ', {a}, {b})"


def words(x: str, shortest: int = 1) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {q('[a-z0-9]+' if shortest == 1 else '[a-z0-9]{' + str(shortest) + ',}')})"


def stem(w: str) -> str:
    return f"CASE WHEN {w} LIKE '%ing' AND length({w}) >= 6 THEN left({w}, -3) WHEN {w} LIKE '%ed' AND length({w}) >= 5 THEN left({w}, -2) WHEN {w} LIKE '%s' AND length({w}) >= 4 THEN left({w}, -1) ELSE {w} END"


def topic_stem(w: str) -> str:
    whens = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) >= {len(s) + 3} THEN left({w}, -{len(s)}){' || ' + q('y') if s == 'ies' else ''}" for s in L.TOPIC_SUFFIXES)
    return f"CASE {whens} ELSE {w} END"


def plural(w: str, n: int) -> str:
    return f"CASE WHEN {w} LIKE '%s' AND length({w}) > {n} THEN left({w}, -1) ELSE {w} END"


def tokens(name: str, x: str) -> str:
    """The distinct tokens as a list."""
    if name == "content":
        e = f"list_transform(list_filter({words(x)}, lambda w: length(w) >= 3 AND w NOT IN {among(L.STORY_STOP)}), lambda w: {stem('w')})"
    elif name == "significant":
        e = f"list_filter(list_transform({words(x)}, lambda w: {stem('w')}), lambda w: length(w) >= 4 AND w NOT IN {among(L.STORY_STOP | L.GENERIC)})"
    elif name == "link":
        e = f"list_transform(list_filter({words(x)}, lambda w: length(w) >= 4 AND w NOT IN {among(L.LINK_STOP)}), lambda w: {stem('w')})"
    elif name == "feature":
        e = f"list_transform(list_filter({words(x)}, lambda w: w NOT IN {among(L.ROUTING_STOP)}), lambda w: {plural('w', 3)})"
    elif name == "topic":
        e = f"list_transform(list_filter({words(x, 4)}, lambda w: w NOT IN {among(L.TOPIC_STOP)}), lambda w: {topic_stem('w')})"
    else:
        e = f"list_transform(list_filter({words(x, 3)}, lambda w: w NOT IN {among(L.MERGE_STOP)}), lambda w: {plural('w', 4)})"
    return f"list_distinct({e})"


def joined(x: str) -> str:
    return f"coalesce(array_to_string(list_sort({x}), ' '), '')"


S = "(SELECT DISTINCT ON (statement_id) * FROM statements)"
T = "(SELECT DISTINCT ON (source_id, line_no) * FROM turns)"
FACTS = "(SELECT DISTINCT ON (project, feature, ef_id) * FROM facts)"
CALLS = "(SELECT DISTINCT ON (source_id) source_id, project, call_date FROM calls)"
SP = f"(SELECT s.*, c.project, c.call_date FROM {S} s JOIN {CALLS} c USING (source_id))"

ORACLE["normalise_text"] = f"SELECT statement_id, {norm('quote')} AS norm FROM {S}"


def _exploded(parts: str, source: str, keys: str, name: str) -> str:
    return f"SELECT {keys}, CAST(i - 1 AS INT) AS part, p[i] AS {name} FROM (SELECT {keys}, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT {keys}, {parts} AS p FROM {source}))"


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, {q('([.!?])' + BLANK + '+')}, '\\1' || chr(2), 'g'), chr(2))"


def strict(x: str) -> str:
    return f"string_split(regexp_replace({x}, {q('([.!?])' + BLANK + '+([A-Z(])')}, '\\1' || chr(2) || '\\2', 'g'), chr(2))"


def clauses(x: str) -> str:
    cut = f"list_transform({strict(x)}, lambda s: string_split(regexp_replace(s, {q('(?i)' + L.CLAUSE_BREAK)}, chr(2), 'g'), chr(2)))"
    return f"list_filter(list_transform(flatten({cut}), lambda c: trim(c, ' ,;' || chr(9) || chr(10))), lambda c: c <> '')"


ORACLE["split_sentences"] = _exploded(sentences("text"), f"{T} WHERE text IS NOT NULL", "source_id, line_no", "sentence")
ORACLE["split_strict_sentences"] = _exploded(strict("text"), f"{T} WHERE text IS NOT NULL", "source_id, line_no", "sentence")
ORACLE["split_clauses"] = _exploded(clauses("quote"), f"{S} WHERE quote IS NOT NULL", "statement_id", "clause")
ORACLE["strip_speaker"] = f"SELECT source_id, line_no, regexp_replace(text, {q(r'^(?:\[[^\]]+\]\s*)?[^:]{1,40}:\s*')}, '') AS body FROM {T}"
for _n in ("content", "significant", "link", "feature", "topic", "merge"):
    ORACLE[f"tokens_{_n}"] = f"SELECT statement_id, {joined(tokens(_n, both()))} AS tokens FROM {S}"


def hits(x: str, patterns: list[str]) -> str:
    return f"regexp_matches({folded(x)}, {q(L.any_of(patterns))})"


def n_words(x: str) -> str:
    return f"(CASE WHEN {folded(x)} = '' THEN 0 ELSE len(string_split({folded(x)}, ' ')) END)"


def classifier(name: str, x: str) -> str:
    f = folded(x)
    settled = f"regexp_matches(regexp_replace({f}, {q(L.DECIDED_NOT)}, ' ', 'g'), {q(L.any_of(L.RESOLVES))})"
    return {
        "banter": hits(x, L.BANTER), "echo": f"(regexp_matches({f}, {q(L.ECHO_LEAD)}) AND {n_words(x)} <= {L.ECHO_WORDS})", "logistics": hits(x, L.LOGISTICS),
        "aspiration": f"({hits(x, L.ASPIRATION)} AND NOT regexp_matches({f}, {q(L.MEASURABLE)}))", "undecided": f"({hits(x, L.UNDECIDED)} AND NOT {settled})", "resolves": settled, "hedge": hits(x, L.HEDGE),
        "requirement": f"(len(regexp_extract_all({f}, {q('[a-z0-9' + chr(39) + ']+')})) >= 5 AND regexp_matches({f}, {q(L.VERBISH)}))", "no_change": hits(x, L.NO_CHANGE), "narration": f"regexp_matches({f}, {q(L.NARRATION)})", "vague_gap": hits(x, L.VAGUE_GAP),
    }[name]


for _n in CLASSIFIERS:
    ORACLE[f"classify_{_n}"] = f"SELECT source_id, line_no, CAST({classifier(_n, 'text')} AS INT) AS hit FROM {T}"


def slug(x: str) -> str:
    s = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"(CASE WHEN {s} = '' THEN 'unnamed-feature' ELSE {s} END)"


def bad_area(x: str) -> str:
    t = words(x)
    every = L.STORY_STOP | L.GENERIC | L.AREA_BAD_LEAD | L.NAME_STOP
    return f"(len({t}) = 0 OR coalesce({t}[1] IN {among(L.AREA_BAD_LEAD | L.NAME_STOP)}, false) OR coalesce(len({t}) = 2 AND {t}[2] IN {among(L.NAME_STOP)}, false) OR len(list_filter({t}, lambda w: NOT (w IN {among(every)} OR length(w) < 3))) = 0)"


def decamel(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))"


ORACLE["area_names"] = (
    f"SELECT DISTINCT feature, {decamel('feature')} AS spaced, {slug('feature')} AS slug, CAST({bad_area('feature')} AS INT) AS bad, CAST(lower(trim(feature)) IN {among(L.DUMP_NAMES)} OR {bad_area('feature')} OR coalesce({words('feature')}[-1] IN {among(L.DUMP_LAST)}, false) AS INT) AS dump FROM statements WHERE feature IS NOT NULL"
)


def area_from_summary(s: str, fallback: str) -> str:
    skip = L.LEADING_VERBS | L.STORY_STOP | L.AREA_BAD_LEAD | L.NAME_STOP | L.GENERIC
    name = f"array_to_string(list_transform(list_filter({words(s)}, lambda w: length(w) >= 4 AND w NOT IN {among(skip)})[1:2], lambda w: upper(w[1]) || w[2:]), ' ')"
    return f"(CASE WHEN coalesce({name}, '') <> '' THEN {name} WHEN NOT {bad_area(f'coalesce({fallback}, {q(str())})')} THEN {fallback} ELSE 'Misc' END)"


ORACLE["areas_from_summaries"] = f"SELECT statement_id, {area_from_summary('summary', 'feature')} AS area FROM {S}"


def destub(x: str) -> str:
    lead = q(rf"(?i)^(?:please\s+)?(?:{L.STUB_VERBS})\s+")
    rest = f"trim(regexp_replace({x}, {lead}, ''))"
    return f"(CASE WHEN regexp_matches({x}, {lead}) AND {rest} <> '' THEN upper({rest}[1]) || {rest}[2:] ELSE {x} END)"


def from_quote(quote: str) -> str:
    """A scalar subquery, so that its steps can be named."""
    clause = r"'([,;:])\s', '\1' || chr(2), 'g'"
    short = "CASE WHEN len(regexp_split_to_array(bare, '\\s+')) <= 24 THEN bare WHEN len(regexp_split_to_array(first, '\\s+')) >= 6 AND first <> bare THEN first ELSE array_to_string(regexp_split_to_array(bare, '\\s+')[1:24], ' ') END"
    return (
        f"(SELECT CASE WHEN bare = '' THEN raw ELSE {destub('text')} END FROM (SELECT *, upper(cut[1]) || cut[2:] AS text FROM (SELECT *, rtrim({short}, ' .!?;:,') || '.' AS cut FROM (SELECT *, string_split(regexp_replace(bare, {clause}), chr(2))[1] AS first "
        f"FROM (SELECT *, trim(regexp_replace(raw, {q(L.QUOTE_FILLER)}, '')) AS bare FROM (SELECT trim(coalesce({quote}, ''), ' \"' || chr(9) || chr(10)) AS raw))))))"
    )


ORACLE["summaries_from_quotes"] = f"SELECT s.statement_id, {from_quote('s.quote')} AS summary FROM {S} s"
_SW, _QW = tokens("content", "trim(coalesce(s.summary, ''))"), tokens("content", "s.quote")
_NOVEL = f"list_filter({_SW}, lambda w: NOT list_contains({_QW}, w) AND length(w) >= 4 AND w NOT IN {among(L.STORY_GLUE | L.NUMBER_WORDS)})"
ORACLE["repaired_summaries"] = (
    f"SELECT s.statement_id, CASE WHEN trim(coalesce(s.summary, '')) = '' OR len({_SW}) = 0 OR len(list_intersect({_SW}, {_QW})) / greatest(len({_SW}), 1) < 0.35 OR len({_NOVEL}) >= 2 OR regexp_matches(lower(trim(s.summary)), {q(L.NARRATION)}) THEN {from_quote('s.quote')} ELSE trim(s.summary) END AS summary FROM {S} s"
)
_VALUES = "CASE n " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.WORD_VALUES.items()) + " ELSE TRY_CAST(replace(n, ',', '') AS DOUBLE) END"
_MEASURE = q("(" + L.NUMBER_TOKEN + r")\s*(business days?|requests? per minute|" + L.MEASURE_UNITS + r")(?:[^a-z]|$)")


def measures(x: str, source: str, keys: str) -> str:
    return (
        f"SELECT DISTINCT {keys}, regexp_replace(replace(u, 'business ', ''), 's$', '') AS unit, CAST({_VALUES} AS DOUBLE) AS value FROM (SELECT {keys}, unnest(regexp_extract_all(lower({x}), {_MEASURE}, 1)) AS n, unnest(regexp_extract_all(lower({x}), {_MEASURE}, 2)) AS u FROM {source}) "
        f"WHERE {_VALUES} IS NOT NULL"
    )


ORACLE["measures"] = measures("quote", S, "statement_id")


def numerals(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(lower(coalesce({x}, '')), {q(L.NUMBER_TOKEN)}), lambda t: replace(t, ',', '')))"


_DIGITS = "list_distinct(list_transform(regexp_extract_all(coalesce(quote, ''), '[0-9][0-9,]*'), lambda t: replace(t, ',', '')))"
_STORY = rf"list_distinct(list_concat(list_transform(regexp_extract_all(lower(coalesce(quote, '')), '\b[0-9]+(?:[.,][0-9]+)?\b'), lambda t: replace(t, ',', '')), list_filter({words('quote')}, lambda w: w IN {among(L.NUMBER_WORDS)})))"
_MULTI = rf"len(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(quote, '')), '([0-9]),([0-9]{{3}})\b', '\1\2', 'g'), '[;,]'), lambda p: regexp_matches(p, {q(L.NUMBER_TOKEN)}))) >= 2"
ORACLE["numbers"] = f"SELECT statement_id, {joined(_DIGITS)} AS digits, {joined(numerals('quote'))} AS numerals, {joined(_STORY)} AS story_numbers, CAST({_MULTI} AS INT) AS multipart FROM {S}"
_CLOCK = q(r"^\W*(?:(\d{1,3}):)?(\d{1,3}):(\d{2})(?:[.,](\d{1,3}))?(?:\D.*)?$")
_part = lambda i: f"regexp_extract(ts, {_CLOCK}, {i})"
_zero = lambda e: f"(CASE WHEN {e} = '' THEN 0 ELSE CAST({e} AS BIGINT) END)"
ORACLE["clock_times"] = (
    f"SELECT source_id, line_no, CASE WHEN regexp_matches(ts, {_CLOCK}) THEN (({_zero(_part(1))} * 60 + {_zero(_part(2))}) * 60 + {_zero(_part(3))}) * 1000 + CASE WHEN {_part(4)} = '' THEN 0 ELSE CAST(rpad({_part(4)}, 3, '0') AS BIGINT) END END AS millis FROM {T}"
)
_BODY = f"trim(regexp_replace(text, {q(BLANK + '+')}, ' ', 'g'))"
ORACLE["candidate_spans"] = (
    f"WITH l AS (SELECT source_id, line_no, {_BODY} AS body FROM {T} WHERE text IS NOT NULL), k AS (SELECT source_id, line_no, list_concat([body], list_filter(list_transform({sentences('body')}, lambda s: trim(s)), lambda s: length(s) >= 8 AND length(s) < length(body))) AS ps FROM l WHERE length(body) >= 8), "
    "e AS (SELECT source_id, line_no, CAST(i - 1 AS INT) AS part, ps[i] AS span FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM k)) "
    "SELECT source_id, span, CAST(length(span) AS INT) AS n, line_no, part FROM (SELECT *, row_number() OVER (PARTITION BY source_id, span ORDER BY line_no, part) AS r FROM e) WHERE r = 1"
)
# The whole call in one string; a quote is where it first stands in it, in the line that holds this character.
_LINES = f"SELECT source_id, line_no, norm, sum(length(norm) + 1) OVER (PARTITION BY source_id ORDER BY line_no) - length(norm) AS start FROM (SELECT source_id, line_no, {folded('text')} AS norm FROM {T} WHERE text IS NOT NULL) WHERE norm <> ''"
_CALLS = f"SELECT source_id, string_agg(norm, ' ' ORDER BY line_no) AS whole FROM ({_LINES}) GROUP BY 1"


def _places(rows: str, key: str) -> str:
    """(key, quote_line) of the rows whose quote stands in their call."""
    sought = f"SELECT DISTINCT {key}, source_id, {norm('quote')} AS nq FROM {rows} WHERE quote IS NOT NULL"
    return f"SELECT p.{key}, max(l.line_no) AS quote_line FROM (SELECT s.{key}, s.source_id, strpos(c.whole, s.nq) AS at FROM ({sought}) s JOIN ({_CALLS}) c USING (source_id) WHERE regexp_matches(s.nq, '[a-z0-9]') AND contains(c.whole, s.nq)) p JOIN ({_LINES}) l ON l.source_id = p.source_id AND l.start <= p.at GROUP BY 1"


_GROUND = _places(S, "statement_id")
ORACLE["ground_verbatim"] = f"SELECT s.statement_id, CAST(g.quote_line IS NOT NULL AS INT) AS is_verbatim, g.quote_line FROM {S} s LEFT JOIN ({_GROUND}) g USING (statement_id)"
ORACLE["quote_times"] = f"SELECT s.statement_id, coalesce(t.ts, 'not available') AS ts FROM {S} s LEFT JOIN ({_GROUND}) g USING (statement_id) LEFT JOIN {T} t ON t.source_id = s.source_id AND t.line_no = g.quote_line"
ORACLE["dedup_quotes"] = f"SELECT source_id, norm, seq, statement_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, norm ORDER BY seq) AS r FROM (SELECT source_id, {norm('quote')} AS norm, seq, statement_id FROM {S} WHERE quote IS NOT NULL)) WHERE r = 1"
ORACLE["chatter_free"] = f"SELECT statement_id FROM {S} WHERE quote IS NULL OR NOT ({classifier('banter', 'quote')} OR {classifier('echo', 'quote')} OR {classifier('logistics', 'quote')})"
ORACLE["reclassified"] = f"SELECT statement_id, CASE WHEN {classifier('aspiration', 'quote')} OR {classifier('undecided', both())} THEN 'question' ELSE kind END AS kind FROM {S}"
ORACLE["hedged_lines"] = (
    f"WITH h AS (SELECT source_id, line_no, text AS quote, coalesce(speaker, 'Unidentified speaker') AS speaker, coalesce(ts, 'not available') AS ts, {norm('text')} AS norm FROM {T} WHERE {classifier('hedge', 'text')} AND len(string_split({folded('text')}, ' ')) >= 4 AND NOT {classifier('logistics', 'text')} AND NOT {classifier('banter', 'text')} AND NOT {classifier('echo', 'text')}), "
    f"f AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM statements s WHERE s.source_id = h.source_id AND {norm('s.quote')} = h.norm)) "
    "SELECT source_id, line_no, quote, speaker, ts FROM (SELECT *, row_number() OVER (PARTITION BY source_id, norm ORDER BY line_no) AS r FROM f) WHERE r = 1"
)
_CW = f"list_filter({tokens('content', both())}, lambda w: w NOT IN {among(L.QUESTION_WORDS)})"
ORACLE["unanswered"] = (
    f"WITH s AS (SELECT statement_id, source_id, kind, seq * 100 AS pos, {_CW} AS w FROM {S} WHERE quote IS NOT NULL) SELECT statement_id FROM s q WHERE NOT (q.kind = 'question' AND len(q.w) >= 2 AND EXISTS (SELECT 1 FROM s f WHERE f.source_id = q.source_id AND f.kind <> 'question' AND f.pos > q.pos "
    "AND (len(list_intersect(q.w, f.w)) >= 2 OR (len(list_intersect(q.w, f.w)) >= 1 AND f.pos - q.pos < 500))))"
)
ORACLE["routed_names"] = (
    f"WITH a AS (SELECT DISTINCT feature, {tokens('feature', 'feature')} AS wa FROM (SELECT DISTINCT feature FROM statements WHERE feature IS NOT NULL)), b AS (SELECT area_name, area_id, {tokens('feature', 'area_name')} AS wb FROM feature_areas), "
    "m AS (SELECT feature, area_name, area_id, len(wa) AS na, len(wb) AS nb, len(list_intersect(wa, wb)) AS n FROM a, b), "
    "s AS (SELECT feature, area_name, area_id, CASE WHEN n = 1 AND n < least(na, nb) THEN n / (na + nb - n) ELSE greatest(n / (na + nb - n), n / least(na, nb)) END AS score FROM m WHERE n > 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score DESC, area_id) AS k FROM s WHERE score >= 0.5) SELECT a.feature, coalesce(r.area_name, a.feature) AS routed, round(r.score, 6) AS score FROM a LEFT JOIN r ON a.feature = r.feature AND r.k = 1"
)
_DF = f"WITH w AS (SELECT project, feature, ef_id, unnest({tokens('topic', both())}) AS word FROM {FACTS}), n AS (SELECT project, count(*) AS group_rows FROM {FACTS} GROUP BY 1) SELECT w.project, w.word, count(*) AS n_rows, any_value(n.group_rows) AS group_rows FROM w JOIN n USING (project) GROUP BY 1, 2"
ORACLE["word_frequency"] = _DF
ORACLE["ambient_words"] = f"SELECT project, word, n_rows FROM ({_DF}) WHERE n_rows > group_rows * 0.25"
ORACLE["rehomed_questions"] = (
    f"WITH q AS (SELECT statement_id, project, {tokens('merge', both())} AS w FROM {SP} WHERE kind = 'question'), d AS (SELECT project, feature, list_distinct(flatten(list({tokens('merge', 'concat_ws(' + q(' ') + ', feature, summary, quote)')}))) AS dw, count(*) AS facts FROM {FACTS} GROUP BY 1, 2), "
    "m AS (SELECT statement_id, feature, len(list_intersect(w, dw)) AS overlap, row_number() OVER (PARTITION BY statement_id ORDER BY len(list_intersect(w, dw)) DESC, facts DESC, feature DESC) AS r FROM q JOIN d USING (project) WHERE len(list_intersect(w, dw)) >= 2), "
    "h AS (SELECT project, feature, row_number() OVER (PARTITION BY project ORDER BY facts DESC, feature DESC) AS r FROM d WHERE feature IS NOT NULL) "
    "SELECT q.statement_id, coalesce(m.feature, h.feature) AS host, coalesce(m.overlap, 0) AS overlap FROM q LEFT JOIN m ON m.statement_id = q.statement_id AND m.r = 1 LEFT JOIN h ON h.project = q.project AND h.r = 1 WHERE coalesce(m.feature, h.feature) IS NOT NULL"
)
ORACLE["misrouted_statements"] = f"SELECT statement_id FROM {S} WHERE feature IS NOT NULL AND len(list_filter({tokens('significant', 'feature')}, lambda w: contains(lower({both()}), w))) = 0"
ORACLE["active_facts"] = f"SELECT project, feature, ef_id, summary FROM {FACTS} WHERE superseded_by IS NULL"
ORACLE["version_chain"] = (
    f"SELECT f.project, f.feature, f.ef_id, f.superseded_by AS next_id, CAST(f.superseded_by IS NULL AS INT) AS is_active, CAST(f.superseded_by IS NULL OR (n.ef_id IS NOT NULL AND f.superseded_by > f.ef_id) AS INT) AS is_sound FROM {FACTS} f LEFT JOIN {FACTS} n ON n.project = f.project AND n.feature = f.feature AND n.ef_id = f.superseded_by"
)
ORACLE["restated_statements"] = f"SELECT statement_id FROM {SP} s WHERE feature IS NOT NULL AND quote IS NOT NULL AND EXISTS (SELECT 1 FROM facts f WHERE f.project = s.project AND f.feature = s.feature AND {norm('f.quote')} = {norm('s.quote')})"
_ACT = f"(SELECT *, {tokens('merge', both())} AS w FROM {FACTS} WHERE superseded_by IS NULL)"
ORACLE["unshared_statements"] = (
    f"SELECT statement_id FROM (SELECT statement_id, project, feature, {tokens('merge', both())} AS w FROM {SP} WHERE feature IS NOT NULL AND NOT {classifier('no_change', both())}) s WHERE NOT EXISTS (SELECT 1 FROM {_ACT} f WHERE f.project = s.project AND f.feature = s.feature AND len(list_intersect(f.w, s.w)) > 0)"
)
ORACLE["best_targets"] = (
    f"WITH a AS {_ACT}, n AS (SELECT project, feature, count(*) AS n FROM a GROUP BY 1, 2), x AS (SELECT project, feature, word FROM (SELECT project, feature, unnest(w) AS word FROM a) JOIN n USING (project, feature) GROUP BY 1, 2, 3 HAVING any_value(n.n) > 2 AND count(*) * 2 > any_value(n.n)), "
    "fw AS (SELECT project, feature, ef_id, unnest(w) AS word FROM a), fx AS (SELECT * FROM fw WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.project = fw.project AND x.feature = fw.feature AND x.word = fw.word)), "
    f"sw AS (SELECT statement_id, project, feature, unnest({tokens('merge', both())}) AS word FROM {SP} WHERE feature IS NOT NULL), m AS (SELECT statement_id, ef_id, count(*) AS overlap FROM sw JOIN fx USING (project, feature, word) GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY overlap DESC, ef_id DESC) AS r, count(*) OVER (PARTITION BY statement_id) AS k FROM m) SELECT statement_id, ef_id, overlap FROM r WHERE r = 1 AND (overlap >= 2 OR k = 1)"
)
ORACLE["resolved_questions"] = (
    f"WITH q AS (SELECT statement_id, project, source_id, {tokens('topic', 'coalesce(summary, quote)')} AS w, {numerals('coalesce(summary, quote)')} AS n FROM {SP} WHERE kind = 'question'), f AS (SELECT project, feature, ef_id, source_id, {tokens('topic', both())} AS fw, {numerals(both())} AS fn FROM {FACTS} WHERE superseded_by IS NULL), "
    "m AS (SELECT q.statement_id, f.feature, f.ef_id, len(list_intersect(q.w, f.fw)) AS shared, CASE WHEN len(list_intersect(q.w, f.fw)) >= 3 OR (len(q.n) > 0 AND len(list_intersect(q.n, f.fn)) = len(q.n)) THEN 'resolved' ELSE 'near' END AS verdict FROM q JOIN f ON q.project = f.project AND q.source_id IS DISTINCT FROM f.source_id WHERE len(q.w) >= 2 AND len(list_intersect(q.w, f.fw)) >= 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY verdict <> 'resolved', feature NULLS FIRST, ef_id) AS r FROM m) SELECT statement_id, verdict, feature, ef_id, shared FROM r WHERE r = 1"
)
_BOUND = q(rf"\b({L.BOUNDS})\b")
ORACLE["contradictions"] = (
    f"WITH a AS (SELECT project, summary, quote, min(row(feature, ef_id)) AS id, count(*) AS copies FROM {FACTS} WHERE superseded_by IS NULL AND quote IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT *, {tokens('topic', both())} AS w FROM a), n AS (SELECT project, sum(copies) AS n FROM a GROUP BY 1), "
    "rare AS (SELECT project, word FROM (SELECT project, copies, unnest(w) AS word FROM t) JOIN n USING (project) GROUP BY 1, 2 HAVING sum(copies) <= any_value(n.n) * 0.25), "
    f"side AS (SELECT project, id, {norm('quote')} AS norm, regexp_extract({folded('quote')}, {_BOUND}, 1) AS bound, w FROM t WHERE NOT regexp_matches({folded('quote')}, {q(L.SCALE)})), "
    "rw AS (SELECT s.project, s.id, list(r.word) AS rare FROM (SELECT project, id, unnest(w) AS word FROM side) s JOIN rare r ON r.project = s.project AND r.word = s.word GROUP BY 1, 2), "
    f"ms AS (SELECT project, id, unit, value FROM ({measures(both(), '(SELECT project, id, summary, quote FROM a)', 'project, id')})), "
    "c AS (SELECT x.project, x.id AS ia, y.id AS ib, min(row(x.unit, x.value, y.value)) AS m FROM ms x JOIN ms y ON x.project = y.project AND x.unit = y.unit AND x.value <> y.value AND x.id < y.id GROUP BY 1, 2, 3) "
    f"SELECT c.project, c.ia[1] AS feature_a, c.ia[2] AS ef_a, c.ib[1] AS feature_b, c.ib[2] AS ef_b, c.m[1] AS unit, c.m[2] AS value_a, c.m[3] AS value_b, CAST(len(list_intersect(ra.rare, rb.rare)) AS INT) AS shared FROM c JOIN side a ON a.project = c.project AND a.id = c.ia JOIN side b ON b.project = c.project AND b.id = c.ib "
    f"JOIN rw ra ON ra.project = c.project AND ra.id = c.ia JOIN rw rb ON rb.project = c.project AND rb.id = c.ib WHERE len(list_intersect(ra.rare, rb.rare)) >= 2 AND NOT contains(a.norm, b.norm) AND NOT contains(b.norm, a.norm) AND NOT (a.bound IN {among(L.LOW_BOUNDS)} AND b.bound IN {among(L.HIGH_BOUNDS)}) AND NOT (a.bound IN {among(L.HIGH_BOUNDS)} AND b.bound IN {among(L.LOW_BOUNDS)})"
)
ORACLE["top_documents"] = (
    f"WITH q AS (SELECT item_id, unnest({tokens('content', 'text')}) AS w FROM eval_items), d AS (SELECT doc_id, unnest({tokens('content', 'text')}) AS w FROM (SELECT DISTINCT ON (doc_id) * FROM documents)), m AS (SELECT item_id, doc_id, count(*) AS overlap FROM q JOIN d USING (w) GROUP BY 1, 2) "
    "SELECT item_id, doc_id, overlap, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM m) WHERE rank <= 3"
)
_GROUPS = f"(SELECT project, feature, target, member_no FROM (SELECT project, feature, min(feature) OVER (PARTITION BY project, s) AS target, row_number() OVER (PARTITION BY project, s ORDER BY feature) AS member_no, count(*) OVER (PARTITION BY project, s) AS n FROM (SELECT DISTINCT project, feature, {slug('feature')} AS s FROM facts WHERE feature IS NOT NULL)) WHERE n > 1)"
ORACLE["merged_areas"] = (
    f"WITH g AS {_GROUPS}, i AS (SELECT f.*, g.target, CAST(row_number() OVER (PARTITION BY f.project, g.target ORDER BY g.member_no, f.ef_id) AS INT) AS new_id FROM {FACTS} f JOIN g USING (project, feature)) "
    "SELECT i.project, i.target AS feature, i.new_id AS ef_id, n.new_id AS superseded_by, i.summary FROM i LEFT JOIN i n ON n.project = i.project AND n.feature = i.feature AND n.ef_id = i.superseded_by "
    f"UNION ALL SELECT project, feature, ef_id, superseded_by, summary FROM {FACTS} f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.project = f.project AND g.feature = f.feature)"
)
_FIRST_WORD = f"(SELECT project, feature, target FROM (SELECT *, min(feature) OVER w AS target, count(*) OVER w AS n FROM (SELECT DISTINCT project, feature, string_split({slug('feature')}, '-')[1] AS slug FROM {FACTS} WHERE feature IS NOT NULL) WINDOW w AS (PARTITION BY project, slug)) WHERE n > 1)"
ORACLE["mergeable_areas"] = (
    f"WITH h AS (SELECT project, feature, arg_min(summary, ef_id) AS s, count(*) AS n FROM {FACTS} GROUP BY 1, 2), w AS (SELECT g.*, h.n, {tokens('merge', both('g.feature', 'h.s'))} AS w FROM {_FIRST_WORD} g JOIN h USING (project, feature)), "
    "k AS (SELECT w.project, w.feature, w.target, w.n FROM w JOIN w t ON t.project = w.project AND t.target = w.target AND t.feature = t.target WHERE w.feature = w.target OR len(list_intersect(w.w, t.w)) > 0) "
    "SELECT project, feature, target FROM k WHERE (SELECT count(*) FROM k o WHERE o.project = k.project AND o.target = k.target) >= 2 AND (SELECT count(*) FROM k o WHERE o.project = k.project AND o.target = k.target AND o.n > 1) <= 1"
)
_KNOWN = f"SELECT s.*, c.whole, {clauses('s.quote')} AS cs FROM {S} s LEFT JOIN ({_CALLS}) c USING (source_id) WHERE s.quote IS NOT NULL"
_GOOD = f"list_filter(cs, lambda c: regexp_matches({norm('c')}, '[a-z0-9]') AND coalesce(contains(whole, {norm('c')}), false) AND {classifier('requirement', 'c')})"
ORACLE["unbundled"] = (
    f"WITH p AS (SELECT statement_id, kind, quote, summary, {_GOOD} AS good FROM ({_KNOWN})) "
    "SELECT statement_id, quote, summary FROM p WHERE NOT coalesce(kind = 'fact' AND len(good) >= 2, false) UNION ALL "
    "SELECT statement_id, part AS quote, upper(rtrim(part, '.!?')[1]) || rtrim(part, '.!?')[2:] || '.' AS summary FROM (SELECT statement_id, unnest(good) AS part FROM p WHERE kind = 'fact' AND len(good) >= 2)"
)
ORACLE["clean_areas"] = (
    f"WITH a AS (SELECT DISTINCT feature, trim(split_part(split_part(trim(trim(trim(feature, ' ' || chr(9) || chr(10)), '\"*'), ' ' || chr(9) || chr(10)), ' (', 1), ' -- ', 1)) AS s FROM statements WHERE feature IS NOT NULL), "
    "b AS (SELECT feature, CASE WHEN NOT regexp_matches(s, '(?i)\\bNEW\\s*:') THEN s WHEN trim(regexp_extract(s, '(?is)^(.*?)\\bNEW\\s*:\\s*(.*)$', 1)) <> '' THEN trim(regexp_extract(s, '(?is)^(.*?)\\bNEW\\s*:\\s*(.*)$', 1)) ELSE trim(regexp_extract(s, '(?is)^(.*?)\\bNEW\\s*:\\s*(.*)$', 2)) END AS s FROM a), "
    f"c AS (SELECT feature, list_filter(string_split({decamel('s')}, ' '), lambda w: w <> '') AS p FROM b), d AS (SELECT feature, p, coalesce(list_position(list_transform(p, lambda w: lower(w) NOT IN {among(L.AREA_BAD_LEAD)}), true), 0) AS k FROM c), "
    f"e AS (SELECT feature, CASE WHEN k = 0 THEN '' ELSE array_to_string(p[k:k + 3], ' ') END AS t FROM d) SELECT feature, CASE WHEN {bad_area('t')} THEN '' ELSE t END AS area FROM e"
)
_CLAUSE = f"regexp_replace(rtrim({destub(chr(115))}, ' .;'), '\\s*[;\\n]\\s*', ', ', 'g')"
ORACLE["stories"] = (
    f"WITH a AS (SELECT project, feature, trim(coalesce(summary, '')) AS s, row_number() OVER (PARTITION BY project, feature ORDER BY ef_id) AS r, count(*) OVER (PARTITION BY project, feature) AS n FROM {FACTS} WHERE superseded_by IS NULL), "
    f"c AS (SELECT project, feature, r, n, c, row_number() OVER (PARTITION BY project, feature ORDER BY r) AS k FROM (SELECT *, {_CLAUSE} AS c FROM a WHERE r <= 8) WHERE c <> ''), "
    "j AS (SELECT project, feature, any_value(n) AS n, count(*) AS m, string_agg(CASE WHEN k = 1 OR (length(string_split(c, ' ')[1]) > 1 AND upper(string_split(c, ' ')[1]) = string_split(c, ' ')[1]) THEN c ELSE lower(c[1]) || c[2:] END, '; ' ORDER BY k) AS t FROM c GROUP BY 1, 2) "
    "SELECT project, feature, t || CASE WHEN n > m THEN '; plus ' || (n - m) || ' more (see Established Facts)' ELSE '' END || '.' AS story FROM j"
)
_SUBSET = "len(list_intersect(a.ws, b.ws)) = least(len(a.ws), len(b.ws))"
ORACLE["canonical_names"] = (
    f"WITH RECURSIVE {'f AS (' + ORACLE['clean_areas'] + ')'}, n AS (SELECT DISTINCT c.project, f.area AS name, {tokens('feature', 'f.area')} AS ws FROM statements s JOIN {CALLS} c USING (source_id) JOIN f ON f.feature = s.feature WHERE f.area <> ''), "
    "u AS (SELECT project, w, count(*) AS n FROM (SELECT project, unnest(ws) AS w FROM n) GROUP BY 1, 2), r AS (SELECT project, list(w) AS rare FROM u WHERE n = 2 GROUP BY 1), "
    f"e AS (SELECT a.project, a.name AS a, b.name AS b FROM n a JOIN n b ON a.project = b.project AND a.name <> b.name AND len(list_intersect(a.ws, b.ws)) > 0 LEFT JOIN r ON r.project = a.project WHERE {_SUBSET} OR (len(list_intersect(a.ws, b.ws)) >= 2 AND len(list_intersect(a.ws, b.ws)) * 2 >= least(len(a.ws), len(b.ws))) OR coalesce(len(list_intersect(list_intersect(a.ws, b.ws), r.rare)) > 0, false)), "
    "reach AS (SELECT project, name, name AS other FROM n UNION SELECT x.project, x.name, e.b FROM reach x JOIN e ON e.project = x.project AND e.a = x.other) "
    "SELECT project, name AS feature, arg_min(other, (length(other), other)) AS canonical FROM reach GROUP BY 1, 2"
)
ORACLE["grounding_score"] = (
    f"WITH f AS (SELECT *, row_number() OVER () AS k FROM {FACTS}), h AS (SELECT k FROM ({_places('f', 'k')})) "
    f"SELECT count(*) AS n_facts, count(superseded_by) AS n_superseded, count(quote) AS n_quotes, (SELECT count(*) FROM h) AS n_grounded, count(*) FILTER (len(regexp_extract_all(coalesce(summary, ''), {q('[A-Za-z0-9' + chr(39) + ']+')})) < 4) AS n_fragments, CAST(count(quote) = (SELECT count(*) FROM h) AS INT) AS passed FROM f"
)
ORACLE["fact_lines"] = (
    "SELECT project, feature, ef_id, '- **EF-' || ef_id || '**' || CASE WHEN superseded_by IS NOT NULL THEN ' [superseded by EF-' || superseded_by || ']' ELSE '' END || ': ' || coalesce(summary, '') || ' — *\"' || coalesce(quote, '') || '\"* — ' || coalesce(speaker, 'Unidentified speaker') || ', ' || coalesce(ts, 'not available') || ' (source: ' || coalesce(source_id, '') || ', ' || coalesce(CAST(call_date AS VARCHAR), '') || ')' AS line "
    f"FROM {FACTS}"
)
ORACLE["numbered_facts"] = (
    f"WITH t AS (SELECT project, feature, max(ef_id) AS top FROM {FACTS} GROUP BY 1, 2), s AS (SELECT statement_id, project, feature, min(statement_id) OVER (PARTITION BY project, feature, source_id) AS lo, source_id FROM {SP} WHERE kind = 'fact' AND feature IS NOT NULL) "
    "SELECT s.statement_id, s.project, s.feature, CAST(coalesce(t.top, 0) + row_number() OVER (PARTITION BY s.project, s.feature ORDER BY lo, source_id, statement_id) AS INT) AS ef_id FROM s LEFT JOIN t USING (project, feature)"
)
_ONE = lambda c: f"trim(regexp_replace({c}, {q('(?:' + BLANK + '|[<>])+')}, ' ', 'g'))"
_FILE_LINES = f"SELECT source_id || '#' || CAST(line_no // 400 AS VARCHAR) AS source_id, line_no AS n, {_ONE('text')} AS text, coalesce({_ONE('speaker')}, '') AS who, row_number() OVER (PARTITION BY source_id, line_no // 400 ORDER BY line_no) AS k FROM {T} WHERE {_ONE('text')} <> ''"
ORACLE["vtt_turns"] = (
    f"SELECT source_id, CAST(k * 1000 + 1 AS INT) AS line_no, lpad(CAST(n // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') || '.000' AS ts, CASE WHEN who = '' THEN 'Unidentified speaker' ELSE who END AS speaker, text FROM ({_FILE_LINES})"
)
_LABEL, _TIMED = q(r"^(?:\[([^\]]+)\]\s*)?(?:\*\*)?([^:*]{1,40}?)(?:\*\*)?:(?:\*\*)?\s*(.+)$"), q(r"^\[([^\]]+)\]\s*(.+)$")
ORACLE["txt_turns"] = (
    f"WITH l AS (SELECT source_id, k, CASE WHEN who <> '' THEN '**' || who || ':** ' ELSE '' END || text AS line FROM ({_FILE_LINES})), m AS (SELECT *, regexp_matches(line, {_LABEL}) AS ok, regexp_matches(line, {_TIMED}) AS timed FROM l) "
    f"SELECT source_id, CAST(k AS INT) AS line_no, nullif(CASE WHEN ok THEN regexp_extract(line, {_LABEL}, 1) ELSE regexp_extract(line, {_TIMED}, 1) END, '') AS ts, nullif(CASE WHEN ok THEN trim(regexp_extract(line, {_LABEL}, 2)) END, '') AS speaker, "
    f"trim(CASE WHEN ok THEN regexp_extract(line, {_LABEL}, 3) WHEN timed THEN regexp_extract(line, {_TIMED}, 2) ELSE line END) AS text FROM m"
)
