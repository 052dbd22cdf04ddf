"""SQL of those llm queries that another engine can express, in a plainer way than the operators work."""

from __future__ import annotations

from factloom.llm.lookalike import build_table


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form(x: str, table: dict[str, str]) -> str:
    """The consistent form: single characters translated, ligatures replaced, marks composed."""
    single = {k: v for k, v in table.items() if len(k) == 1 and ord(k) < 0x10000}
    kept = {k: v for k, v in single.items() if len(v) == 1}
    gone = [k for k, v in single.items() if not v]
    for k, v in single.items():
        if len(v) > 1:
            x = f"replace({x}, {_q(k)}, {_q(v)})" if 0xFB00 <= ord(k) <= 0xFB06 or 0x2160 <= ord(k) <= 0x217F else x
    return f"trim(nfc_normalize(translate({x}, {_q(''.join(kept) + ''.join(gone))}, {_q(''.join(kept.values()))})), ' ' || chr(10))"


def sql() -> dict[str, str]:
    table = build_table()
    form = lambda x: _form(x, table)
    words = lambda x: f"regexp_extract_all(lower(coalesce({form(x)}, '')), {_q(r'[\p{L}\p{N}]+')})"
    out = {}
    out["p1_found"] = (
        f"WITH s AS (SELECT statement_id, list_distinct(list_concat({words('quote')}, {words('summary')})) AS w FROM (SELECT DISTINCT ON (statement_id) * FROM statements)), t AS (SELECT * FROM s WHERE len(w) > 0) "
        "SELECT a.statement_id AS id_a, b.statement_id AS id_b FROM t a JOIN t b ON a.statement_id < b.statement_id AND len(a.w) >= 0.68 * len(b.w) - 1e-9 AND len(b.w) >= 0.68 * len(a.w) - 1e-9 "
        "WHERE len(list_intersect(a.w, b.w)) >= 0.68 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9"
    )
    pairs = (
        f"s AS (SELECT statement_id, list_sort(list_distinct(list_concat({words('quote')}, {words('summary')}))) AS w FROM (SELECT DISTINCT ON (statement_id) * FROM statements)), m AS (SELECT statement_id, w, min(statement_id) OVER (PARTITION BY w) AS rep FROM s WHERE len(w) > 0), t AS (SELECT * FROM m WHERE statement_id = rep), "
        "l AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.rep <> b.rep AND len(a.w) >= 0.68 * len(b.w) - 1e-9 AND len(b.w) >= 0.68 * len(a.w) - 1e-9 WHERE len(list_intersect(a.w, b.w)) >= 0.68 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9)"
    )
    out["p1_groups"] = (
        f"WITH RECURSIVE {pairs}, reach AS (SELECT rep AS x, rep AS y FROM t UNION SELECT r.x, l.b FROM reach r JOIN l ON l.a = r.y), g AS (SELECT x, min(y) AS group_id FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1) "
        "SELECT m.statement_id, m.rep, g.group_id, coalesce(n.n, 0) AS n_links FROM m JOIN g ON g.x = m.rep LEFT JOIN n ON n.a = m.rep"
    )
    picture = r"[\x{2300}-\x{2BFF}\x{1F000}-\x{1FAFF}]"
    kept = f"regexp_replace(text, {_q(f'({picture}){chr(0x200D)}({picture})')}, {_q(chr(92) + '1' + chr(0xE000) + chr(92) + '2')}, 'g')"  # the joiner inside an emoji stays
    out["p4_forms"] = f"SELECT DISTINCT ON (source_id, line_no) source_id, line_no, replace({form(kept)}, chr(57344), chr(8205)) AS form FROM turns"
    out["p4_found"] = f"SELECT DISTINCT s.statement_id, s.source_id, t.line_no FROM statements s JOIN turns t ON s.source_id = t.source_id AND {form('s.quote')} = {form('t.text')} WHERE s.quote <> t.text"
    out["p5_found"] = "SELECT DISTINCT source_id, line_no FROM turns WHERE length(text) > 2500"
    out["p9_found"] = (
        f"WITH i AS (SELECT item_id, {words('text')} AS w FROM eval_items), d AS (SELECT doc_id, {words('text')} AS w FROM (SELECT DISTINCT ON (doc_id) * FROM documents)), "
        "iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)), "
        "dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)) SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (p)"
    )
    frame = "(?i)^(?:[^a-z0-9]|[0-9]+[.)]\\s+|the[^a-z0-9]+|(?:new|feature)\\s*:)+"
    split = lambda x: f"list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'of', 'the'))"
    tail = "('existing', 'module', 'modules')"
    matches = (
        f"WITH v AS (SELECT DISTINCT feature AS value FROM statements WHERE feature IS NOT NULL), tw AS (SELECT value, {split(f'regexp_replace(regexp_replace(value, {_q(frame)}, {_q(str())}), {_q("([a-z])([A-Z])")}, {_q(chr(92) + "1 " + chr(92) + "2")}, {_q("g")})')} AS w FROM v), "
        f"tc AS (SELECT value, CASE WHEN len(w) > 2 AND w[-1] IN {tail} AND w[-2] IN {tail} THEN w[1:-3] WHEN len(w) > 1 AND w[-1] IN {tail} THEN w[1:-2] ELSE w END AS w FROM tw), "
        "ty AS (SELECT DISTINCT value, typed FROM (SELECT value, array_to_string(w, '') AS typed FROM tc UNION ALL SELECT value, regexp_replace(array_to_string(w, ''), '(module|modules|existing)$', '') FROM tc UNION ALL SELECT value, regexp_replace(array_to_string(w, ''), 's$', '') FROM tc) WHERE length(typed) >= 2), "
        f"sp AS (SELECT area_id, {split('n')} AS w FROM (SELECT area_id, area_name AS n FROM feature_areas UNION ALL SELECT area_id, alias_name FROM feature_areas) WHERE n IS NOT NULL), "
        "pt AS (SELECT area_id, w, list_transform(w, lambda x: list_distinct(list_concat([x, x[1] || regexp_replace(x[2:], '[aeiou]', '', 'g')], list_concat(list_transform(list_filter(range(3, 10), lambda n: n < length(x)), lambda n: x[1:n]), list_transform(list_filter(range(3, 7), lambda n: n < length(x)), lambda n: x[1:n] || 's'))))) AS short FROM sp WHERE len(w) > 0), "
        "fa AS (SELECT area_id, 0 AS is_short, unnest(list_transform(range(0, len(w)), lambda r: array_to_string(list_concat(w[r + 1:len(w)], w[1:r]), ''))) AS form FROM pt UNION ALL SELECT area_id, 0, array_to_string(list_reverse(w), '') FROM pt WHERE len(w) > 2 UNION ALL SELECT area_id, 0, w[2] || 'of' || w[1] FROM pt WHERE len(w) = 2 "
        "UNION ALL SELECT area_id, 1, unnest(list_concat(list_transform(c, lambda p: p[1] || p[2]), list_transform(c, lambda p: p[2] || p[1]))) FROM (SELECT area_id, flatten(list_transform(short[1], lambda a: list_transform(short[2], lambda b: [a, b]))) AS c FROM pt WHERE len(w) = 2) "
        "UNION ALL SELECT area_id, 1, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(short[i], lambda a: array_to_string(list_concat(list_concat(w[1:i - 1], [a]), w[i + 1:len(w)]), ''))))) FROM pt WHERE len(w) > 2), "
        "fm AS (SELECT area_id, form, min(is_short) AS is_short, CASE WHEN min(is_short) = 1 THEN CASE WHEN length(form) >= 10 THEN 2 WHEN length(form) >= 7 THEN 1 ELSE 0 END WHEN length(form) >= 16 THEN 4 WHEN length(form) >= 10 THEN 3 WHEN length(form) >= 6 THEN 2 WHEN length(form) >= 4 THEN 1 ELSE 0 END AS k FROM fa GROUP BY 1, 2), "
        "ms AS (SELECT value, area_id, is_short, levenshtein(typed, form) AS distance, k FROM ty JOIN fm ON abs(length(typed) - length(form)) <= k AND levenshtein(typed, form) <= k), best AS (SELECT value, area_id, distance, row_number() OVER (PARTITION BY value ORDER BY distance, is_short, area_id) AS r FROM ms) "
    )
    out["p7_values"] = matches + "SELECT v.value, b.area_id AS entry_id, CAST(b.distance AS INT) AS distance FROM v LEFT JOIN best b ON b.value = v.value AND b.r = 1"
    out["p7_found"] = matches + "SELECT DISTINCT s.statement_id, coalesce(b.area_id, 0) AS area_id FROM statements s LEFT JOIN best b ON b.value = s.feature AND b.r = 1 WHERE s.feature IS NOT NULL AND s.feature NOT IN (SELECT area_name FROM feature_areas)"
    return out


ORACLE = sql()
