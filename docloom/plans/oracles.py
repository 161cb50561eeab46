"""SQL of the registered queries for the checking engine, written from their definitions.

Its regexes know neither look-around nor Java's classes, so boundaries are
spelt out; queries whose patterns need look-around, or that aren't SQL at all
(similarity of strings), have none and are tested on fixtures instead.
"""

from __future__ import annotations

import re

from docloom.functions import vocabulary as v
from docloom.plans.inputs import RESUME_SQL, TOKENS_SQL, for_oracle

SP = r"\s\x0b\x1c-\x1f\x85\p{Z}"
W = r"\p{L}\p{N}_"
END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
RESUMES = f"resumes AS ({for_oracle(RESUME_SQL)})"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(items) -> str:
    return "(" + ", ".join(map(quoted, items)) + ")"


def array(items) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '[{SP}]+', ' ', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SP}]+'), lambda w: w <> '')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{END}'), lambda l: {strip('l')}), lambda l: l <> '')"


def join(x: str) -> str:
    return f"array_to_string({x}, '¦')"


def ocr(x: str) -> str:
    for a, b in v.OCR_REPAIRS:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


def clean(x: str) -> str:
    x = ocr(rf"regexp_replace(replace(coalesce({x}, ''), chr(160), ' '), '\r\n?', chr(10), 'g')")
    x = f"regexp_replace(replace({x}, chr(65312), '@'), '[{SP}]*@[{SP}]*', '@', 'g')"
    x = rf"regexp_replace({x}, '[^{W}{SP}@.+#\-/(),:'']', ' ', 'g')"
    return strip(rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10) || chr(10), 'g')")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def flag(x: str) -> str:
    s = strip(x)
    return rf"CASE WHEN length({s}) < 40 THEN 'low_text' WHEN len(regexp_extract_all({s}, '[\x00-\x03]')) / greatest(length({s}), 1) > 0.05 THEN 'noisy_symbols' ELSE 'ok' END"


def garbled(t: str) -> str:
    a = f"regexp_replace({t}, '[^a-zA-Z]', '', 'g')"
    return f"(length({a}) >= 4 AND (NOT regexp_matches({a}, '[aeiouAEIOU]') OR regexp_matches({a}, '[^aeiouAEIOU]{{5,}}')))"


def quality(source: str) -> str:
    headers = " , ".join(f"CASE WHEN contains(low, '{h}') THEN '{h}' END" for h in v.QUALITY_HEADERS)
    return f"""
q0 AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM {source}),
q1 AS (SELECT doc_id, {words('text')} AS toks, {lines('text')} AS ls, length(text) AS text_length, regexp_matches(text, '{EMAIL}') AS has_email,
  list_filter([{headers}], lambda h: h IS NOT NULL) AS hs FROM q0),
q2 AS (SELECT *, len(list_filter(toks, lambda t: {garbled('t')})) / greatest(len(toks), 1) AS garbled_ratio, len(list_filter(ls, lambda l: length(l) > 120)) / greatest(len(ls), 1) AS scramble_ratio FROM q1),
q3 AS (SELECT *, list_filter([CASE WHEN garbled_ratio > 0.2 THEN 'garble' END, CASE WHEN len(hs) < 2 THEN 'headers' END, CASE WHEN NOT has_email THEN 'email' END, CASE WHEN text_length < 300 THEN 'short' END, CASE WHEN scramble_ratio > 0.25 THEN 'scramble' END], lambda i: i IS NOT NULL) AS iss FROM q2),
q AS (SELECT *, CASE WHEN len(iss) = 0 THEN 'READY' WHEN len(iss) = 1 AND iss[1] NOT IN ('garble', 'scramble') THEN 'REVIEW'
  WHEN len(iss) >= 3 OR list_contains(iss, 'scramble') OR list_contains(iss, 'short') THEN 'SKIP' ELSE 'REVIEW' END AS verdict FROM q3)"""


def format_phone(d: str) -> str:
    ten = "'(' || substr({0}, 1, 3) || ') ' || substr({0}, 4, 3) || '-' || substr({0}, 7, 4)"
    return f"""CASE WHEN length({d}) < 10 THEN NULL WHEN regexp_full_match({d}, '01[0125][0-9]{{8}}') THEN substr({d}, 1, 3) || ' ' || substr({d}, 4, 4) || ' ' || substr({d}, 8, 4)
  WHEN length({d}) = 10 THEN {ten.format(d)} WHEN regexp_full_match({d}, '1[3-9][0-9]{{9}}') THEN {ten.format(f'substr({d}, 2)')}
  WHEN length({d}) BETWEEN 11 AND 15 THEN '+' || {d} END"""


def is_upper(x: str) -> str:
    return rf"(regexp_matches({x}, '\p{{Lu}}') AND NOT regexp_matches({x}, '[\p{{Ll}}\p{{Lt}}]'))"


def company(x: str) -> str:
    tail = rf"regexp_extract({x}, ',[{SP}]*([A-Za-z]{{1,3}})[{SP}]*$', 1)"
    return f"(len({words(x)}) >= 4 AND (length({x}) - length(replace({x}, ',', '')) >= 2 OR (length({tail}) = 2 AND (upper({tail}) IN {listed(v.STATE_CODES)} OR regexp_matches({tail}, '^[A-Z][a-z]$')))))"


def name_score(x: str) -> str:
    n, low = f"len({words(x)})", f"lower({x})"
    title = rf"(regexp_matches({x}, '[\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches({x}, '[\p{{Lu}}\p{{Lt}}\p{{Ll}}][\p{{Lu}}\p{{Lt}}]|(^|[^\p{{Lu}}\p{{Lt}}\p{{Ll}}])\p{{Ll}}'))"
    plain = f"trim(regexp_replace({low}, '[^a-z{SP}]', '', 'g'), ' ')"
    return rf"""(CASE WHEN {n} BETWEEN 2 AND 4 THEN 2 WHEN {n} > 4 THEN -2 ELSE 0 END
  + CASE WHEN regexp_matches({x}, '[\p{{Nd}}\p{{No}}]') THEN -3 ELSE 0 END + CASE WHEN contains({x}, '@') OR contains({low}, 'http') THEN -3 ELSE 0 END
  + CASE WHEN {is_upper(x)} AND {n} BETWEEN 2 AND 4 THEN 3 WHEN {title} THEN 2 ELSE 0 END + CASE WHEN length({x}) < 40 THEN 1 ELSE 0 END
  + CASE WHEN {company(x)} THEN -10 ELSE 0 END + CASE WHEN {plain} IN {listed(v.NAME_STOPWORDS + v.HEADERS)} THEN -5 ELSE 0 END
  + CASE WHEN list_has_any(list_transform({words(x)}, lambda w: lower(w)), {array(v.SKILL_PHRASE_WORDS)}) THEN -4 ELSE 0 END
  + CASE WHEN len(list_filter({words(x)}, lambda w: NOT (regexp_full_match(w, '[A-Za-z][a-z''\-]*') OR {is_upper('w')}))) > 0 THEN -2 ELSE 0 END)"""


DG = r"\p{Nd}"
NOISE = rf"^(?:[^{W}]+|[a-z]{{1,2}}[{SP}]+[{W}].*|{DG}+[{SP}]*[a-zA-Z]{{0,2}}|(?:[^{W}]|{DG}){{1,4}})$"
DATES = rf"(?i)^(?:[^{W}]|{DG}){{0,4}}[{SP}]*{DG}{{4}}[{SP}]*[-–][{SP}]*(?:{DG}{{4}}|ongoing|present|now|current)"
OPEN = rf"(?i)^{DG}{{4}}[{SP}]*[-–—]?[{SP}]*(?:present|current|now|ongoing)[{SP}]*$"
CONTACT = rf"(?i)(?:@.*@|linkedin\.com|github\.com|twitter\.com|^[{SP}]*[^{W}]{{0,3}}[{SP}]*[{W}]+,[{SP}]*[{W}]+[{SP}]*$)"


def noise(x: str) -> str:
    return f"(length({x}) <= 2 OR regexp_matches({x}, '{NOISE}') OR NOT regexp_matches({x}, '[A-Za-z]') OR (regexp_matches({x}, '{DATES}') AND NOT regexp_matches({x}, '{OPEN}')) OR (contains({x}, '@') AND regexp_matches({x}, '{CONTACT}')))"


#: Lines of the composed documents, numbered from 0.
LINES = f"{RESUMES}, lined AS (SELECT doc_id, unnest({lines('text')}) AS line, generate_subscripts({lines('text')}, 1) - 1 AS pos FROM resumes)"
KEYWORDS = [(s, k) for s, ks in v.SECTIONS for k in ks]
HEADED = f"""{LINES}, kw(ord, section, keyword) AS (VALUES {', '.join(f"({i}, '{s}', '{k}')" for i, (s, k) in enumerate(KEYWORDS))}),
hit AS (SELECT doc_id, pos, min(ord) AS ord FROM lined JOIN kw ON starts_with(lower(line), keyword) GROUP BY doc_id, pos),
headed AS (SELECT l.doc_id, l.pos, l.line, kw.section, kw.keyword,
  CASE WHEN contains(line, ':') AND lower({strip("split_part(line, ':', 1)")}) = keyword THEN nullif({strip("substr(line, strpos(line, ':') + 1)")}, '') END AS tail
  FROM lined l LEFT JOIN hit USING (doc_id, pos) LEFT JOIN kw USING (ord))"""


def first_of(items: str, key: str) -> str:
    """Items of a list whose key (over ``x``) hasn't come before; in order. For use as a list expression over column ``doc_id``."""
    return f"list_transform(list_filter(list_transform({items}, lambda x, i: {{'v': x, 'i': i, 'k': {key}}}), lambda y: list_position(list_transform({items}, lambda x: {key}), y.k) = y.i), lambda y: y.v)"


def deduped(items: str, key: str) -> str:
    return f"WITH p AS (SELECT doc_id, list_filter(list_transform({items}, lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM documents) SELECT doc_id, {join(first_of('ps', key))} AS items FROM p"


#: Single-word skills: those of letters and digits alone are tokens; others are looked for by a pattern each.
PLAIN = sorted({s for s in v.SKILLS if s.isalnum()})
MARKED = [f"CASE WHEN regexp_matches(t, '(^|[^{W}]){re.escape(s)}([^{W}]|$)') THEN {quoted(s)} END" for s in sorted({s for s in v.SKILLS if " " not in s and not s.isalnum()})]
TAGGED = f"tagged AS ({for_oracle(TOKENS_SQL)})"
#: Spans of tagged tokens: islands that a B- tag opens; tags of other labels are passed over, O closes.
GROUPED = f"""{TAGGED}, isl AS (SELECT *, sum(CASE WHEN entity LIKE 'B-%' OR entity = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM tagged),
head AS (SELECT doc_id, island, entity[3:] AS label FROM isl WHERE entity LIKE 'B-%'),
grp AS (SELECT doc_id, island, label, list(score ORDER BY ts, event_id) AS ss, list(replace(word, '##', '') ORDER BY ts, event_id) AS ws FROM isl JOIN head USING (doc_id, island) WHERE entity[3:] = label GROUP BY ALL),
ents AS (SELECT doc_id, island, label, list_reduce(ss, lambda a, x: (a + x) / 2) AS score, list_reduce(ws, lambda a, x: a || CASE WHEN starts_with(x, '''') THEN '' ELSE ' ' END || x) AS text FROM grp)"""

#: The same of tokens and spans above the peak's floor.
FLOOR = "greatest(0.17, 0.5 * peak)"
FILTERED = GROUPED.replace("isl AS", f"peaks AS (SELECT doc_id, max(score) AS peak FROM tagged GROUP BY doc_id), strong AS (SELECT t.* FROM tagged t JOIN peaks USING (doc_id) WHERE peak >= 0.2 AND score >= {FLOOR}), isl AS", 1).replace("FROM tagged), \n", "").replace("AS island FROM tagged)", "AS island FROM strong)").replace("ents AS", "grouped AS", 1)
FILTERED += f", ents AS (SELECT g.* FROM grouped g JOIN peaks USING (doc_id) WHERE peak >= 0.2 AND score >= {FLOOR})"
USER, SPACED = "[A-Za-z0-9_][A-Za-z0-9._%+-]{1,39}", f"[{SP}]+"
BARE = rf"(?i)(?:^|[^{W}])({USER}){SPACED}([A-Za-z0-9][A-Za-z0-9.-]*\.(?:com|net|org|edu|io|co|gov|uk))(?:[^{W}]|$)"
SPELT = rf"(?i)(?:^|[^{W}])({USER}){SPACED}at{SPACED}([A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{{2,}})(?:[^{W}]|$)"


def address(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(t, '{pattern}') THEN regexp_extract(t, '{pattern}', 1) || '@' || regexp_extract(t, '{pattern}', 2) END"


def texts_of(label: str) -> str:
    return f"(SELECT doc_id, ts FROM j WHERE label = '{label}')"


JUNK = f"list_filter(list_transform(items, lambda x: {strip('x')}), lambda s: length(s) >= 2 AND lower(s) NOT IN {listed(v.JUNK_ENTITIES)} AND length(regexp_replace(s, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 2)"
EXTRA = ("Education:", "2014", "2010-2014", "zation", "han", "a b", "US", "-", "oh", " Experience ", "Team lead")
ITEMS = f"it AS (SELECT doc_id, list_concat(string_split(text, ' '), {array(EXTRA)}) AS items FROM documents), c AS (SELECT doc_id, {JUNK} AS cs FROM it)"
LOW = strip("regexp_replace(lower(t), ':+$', '')")
SLUG = "replace({0}, ' ', '_')"


def slug(x: str) -> str:
    y = rf"regexp_replace(' ' || replace(lower({strip(x)}), '_', ' ') || ' ', '([^{W}])resumes?([^{W}])', '\1\2', 'g')"
    return f"replace({strip(collapse(y))}, ' ', '_')"


LABELLED = "lab AS (SELECT doc_id, source AS raw_label, CASE source WHEN 'src1' THEN 'engineering' WHEN 'src2' THEN 'engineering' WHEN 'src3' THEN 'people_ops' ELSE lower(source) END AS canonical_label FROM documents)"
COUNTED = f"{LABELLED}, cnt AS (SELECT canonical_label, count(*) AS n FROM lab GROUP BY 1), sized AS (SELECT *, CASE WHEN n <= 2 THEN 0 ELSE greatest(round_even(n * 0.1::DOUBLE, 0)::BIGINT, CASE WHEN n >= 10 THEN 1 ELSE 0 END) END AS n_val FROM cnt), splits AS (SELECT canonical_label, n, n_val, n_val AS n_test, n - 2 * n_val AS n_train FROM sized)"
HASHED = "md5('42:' || doc_id)"
PARSED = f"parsed AS (SELECT doc_id % 4 <> 0 AS ok, n_chars AS chars, CASE WHEN doc_id % 4 = 0 THEN 'failed: ' || source || ' ' || {flag('text')} END AS error FROM documents)"
TURNS = """t AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN -100 ELSE length(text) % 5 END AS l, length(text) % 5 - CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END AS p FROM conversations WHERE conv_id IS NOT NULL)"""
AUDITED = f"""{TURNS}, a AS (SELECT conv_id, CASE WHEN conv_id % 9 = 0 THEN 'length mismatch' WHEN conv_id % 10 = 0 THEN 'not lists' WHEN bool_or(l <> -100 AND (l < 0 OR l >= 4)) THEN 'label out of range' END AS error FROM t GROUP BY conv_id)"""
LABEL_OF = "CASE WHEN length(w) % 5 < 2 THEN 'SKILL' WHEN length(w) % 5 = 2 THEN 'NAME' END"
BIO = f"""w AS (SELECT doc_id, unnest({words('text')}) AS w, generate_subscripts({words('text')}, 1) AS pos FROM documents), wl AS (SELECT doc_id, pos, {LABEL_OF} AS label FROM w),
bio AS (SELECT doc_id, pos, CASE WHEN label IS NULL THEN 'O' WHEN label = lag(label) OVER (PARTITION BY doc_id ORDER BY pos) THEN 'I-' || label ELSE 'B-' || label END AS tag FROM wl)"""
OFFSETS = """tk AS (SELECT doc_id, n_chars, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
off AS (SELECT doc_id, n_chars, pos, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(word) - 1 AS s, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS e FROM tk)"""
SPANS = """sp AS (SELECT doc_id, unnest([{'a': (n_chars // 10), 'b': (n_chars // 10) + 20, 'l': 'NAME'}, {'a': n_chars // 2, 'b': n_chars // 2 + 15, 'l': 'SKILL'}, {'a': floor(n_chars / 2 + 4)::BIGINT, 'b': floor(n_chars / 2 + 4)::BIGINT + 30, 'l': 'DATE'}], recursive := true) FROM documents)"""


def f1(tp: str, p: str, g: str) -> str:
    pr, rc = f"CASE WHEN {p} > 0 THEN {tp} / {p} ELSE 0 END", f"CASE WHEN {g} > 0 THEN {tp} / {g} ELSE 0 END"
    return f"{pr} AS precision, {rc} AS recall, CASE WHEN ({pr}) + ({rc}) > 0 THEN 2 * ({pr}) * ({rc}) / (({pr}) + ({rc})) ELSE 0 END AS f1"


#: Spans of a tag sequence: islands that open at B-, or where the label changes.
TAGGED_TURNS = f"""{TURNS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p, l) - 1 AS pos FROM t), y AS (SELECT conv_id, pos, 'p' AS kind, p AS x FROM o UNION ALL SELECT conv_id, pos, 'g', l FROM o),
g0 AS (SELECT conv_id, pos, kind, ['O', 'B-NAME', 'I-NAME', 'B-SKILL', 'I-SKILL'][greatest(x, 0) + 1] AS tag FROM y), g1 AS (SELECT *, CASE WHEN tag <> 'O' THEN tag[3:] END AS label FROM g0),
g2 AS (SELECT *, label IS NOT NULL AND (tag LIKE 'B-%' OR lag(label) OVER w IS DISTINCT FROM label OR pos = 0) AS opens FROM g1 WINDOW w AS (PARTITION BY conv_id, kind ORDER BY pos)),
g3 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id, kind ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM g2 WHERE true), s AS (SELECT conv_id, kind, label, min(pos) AS a, max(pos) AS b FROM g3 WHERE label IS NOT NULL GROUP BY conv_id, kind, label, island),
c AS (SELECT label, count(*) FILTER (WHERE kinds = 2) AS tp, count(*) FILTER (WHERE has_p) AS p, count(*) FILTER (WHERE has_g) AS g FROM (SELECT conv_id, label, a, b, count(*) AS kinds, bool_or(kind = 'p') AS has_p, bool_or(kind = 'g') AS has_g FROM s GROUP BY ALL) GROUP BY label)"""


ORACLES = {
    "first_email": f"WITH {RESUMES}, e AS (SELECT doc_id, regexp_replace(replace(text, chr(65312), '@'), '[{SP}]*@[{SP}]*', '@', 'g') AS t FROM resumes) SELECT doc_id, coalesce(nullif(regexp_extract(t, '{EMAIL}'), ''), {address(BARE)}, {address(SPELT)}) AS email FROM e",
    "read_text": "SELECT doc_id || '.txt' AS file_name, replace(regexp_replace(text || chr(13) || chr(10) || 'last' || chr(13) || 'line', '\\r\\n?', chr(10), 'g'), chr(65533), '') AS text FROM documents",
    "ready_list": "SELECT doc_id || '.txt' AS file_name FROM documents WHERE doc_id % 4 <> 0",
    "annotations": """SELECT doc_id AS id, text, source AS filename, doc_id % 3 = 0 AS was_cancelled, n_chars::INT AS "end", lang AS label FROM documents""",
    "parser_counts": f"WITH {PARSED} SELECT CASE chars % 3 WHEN 0 THEN 'embedded' WHEN 1 THEN 'second' ELSE 'unknown' END AS parser, count(*) AS n FROM parsed WHERE ok GROUP BY 1",
    "error_samples": f"WITH {PARSED.replace('SELECT doc_id % 4', 'SELECT doc_id, doc_id % 4', 1)} SELECT doc_id, error FROM parsed WHERE error IS NOT NULL ORDER BY doc_id LIMIT 8",
    "entity_f1": f"""WITH {TAGGED_TURNS}, each AS (SELECT label, {f1('tp', 'p', 'g')}, g AS support FROM c), m AS (SELECT sum(tp) AS tp, sum(p) AS p, sum(g) AS g FROM c)
SELECT label, precision, recall, f1, support::BIGINT AS support FROM each UNION ALL SELECT 'micro avg', {f1('tp', 'p', 'g')}, g::BIGINT FROM m UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM each
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM each""",
    "ner_profile": f"""WITH {FILTERED}, e AS (SELECT doc_id, label, {strip('text')} AS t, island FROM ents), d AS (SELECT doc_id, label, t, min(island) AS island FROM e WHERE t <> '' GROUP BY ALL), j AS (SELECT doc_id, label, string_agg(t, '¦' ORDER BY island) AS ts FROM d GROUP BY ALL), n AS (SELECT doc_id, arg_min(t, island) AS name FROM e WHERE label = 'NAME' GROUP BY doc_id),
k AS (SELECT doc_id, list_reduce(list(score ORDER BY island), lambda a, x: a + x) / count(*) AS m FROM ents WHERE label IN ('NAME', 'SKILL', 'EDUCATION', 'EXPERIENCE') GROUP BY doc_id)
SELECT doc_id, nullif(name, '') AS name, coalesce(s.ts, '') AS skills, coalesce(u.ts, '') AS education, coalesce(x.ts, '') AS experience, coalesce(m, 0.45) AS confidence FROM (SELECT DISTINCT doc_id FROM tagged) LEFT JOIN n USING (doc_id) LEFT JOIN {texts_of('SKILL')} s USING (doc_id) LEFT JOIN {texts_of('EDUCATION')} u USING (doc_id) LEFT JOIN {texts_of('EXPERIENCE')} x USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "bio_dataset": f"""WITH {OFFSETS}, {SPANS}, ends AS (SELECT doc_id, n_chars // 10 + 20 AS name_end, CASE WHEN n_chars // 2 >= n_chars // 10 + 20 THEN n_chars // 2 + 15 ELSE n_chars // 10 + 20 END AS later_end FROM documents),
kept AS (SELECT sp.* FROM sp JOIN ends USING (doc_id) WHERE l = 'NAME' OR (l = 'SKILL' AND a >= name_end) OR (l = 'DATE' AND a >= later_end)),
hit AS (SELECT doc_id, pos, arg_min(l, (greatest(a, s), l)) AS label FROM off JOIN kept USING (doc_id) WHERE e > s AND a < e AND b > s GROUP BY doc_id, pos),
al AS (SELECT doc_id, pos, label FROM off LEFT JOIN hit USING (doc_id, pos) WHERE e > s), tg AS (SELECT doc_id, pos, CASE WHEN label IS NULL THEN 'O' WHEN lag(label) OVER (PARTITION BY doc_id ORDER BY pos) = label THEN 'I-' || label ELSE 'B-' || label END AS tag FROM al)
SELECT doc_id, string_agg(tag, ' ' ORDER BY pos) AS tags FROM tg GROUP BY doc_id""",
    "clean_text": f"WITH {RESUMES} SELECT doc_id, {clean('text')} AS clean FROM resumes",
    "ocr_artifact_flag": f"WITH a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, 's', 'Claire') ELSE text END AS t FROM documents), b AS (SELECT doc_id, len(regexp_extract_all(t, '(?i)claire')) AS n, len({words('t')}) AS w FROM a) SELECT doc_id, n >= 8 AND coalesce(n / nullif(w, 0), 0) > 0.04 AS artifact FROM b",
    "ocr_normalize": f"SELECT doc_id, {ocr(quoted('') + ' || text || ' + quoted(' SOL RESOLVE sol x t-sql I ve Hi ve master s Camputer campany'))} AS normalized FROM documents",
    "lines": f"SELECT doc_id, len({lines('text')}) AS n_lines, {join(lines('text'))} AS lines FROM documents",
    "parser_quality": f"WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[aeiou]', chr(1), 'g') ELSE text END AS t FROM documents), b AS (SELECT doc_id, {flag('t')} AS quality_flag FROM a) SELECT doc_id, quality_flag, CASE quality_flag WHEN 'ok' THEN 1.0::DOUBLE WHEN 'low_text' THEN 0.62 ELSE 0.45 END AS parser_confidence FROM b",
    "collapse_pages": f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda p: {strip('p')}), lambda p: p <> ''), chr(10)) AS collapsed FROM documents",
    "parser_cascade": f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' short ' WHEN doc_id % 3 = 1 THEN text ELSE '' END AS e, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS s, CASE WHEN doc_id % 5 <> 0 THEN reverse(text) END AS o FROM documents),
b AS (SELECT *, length({strip('e')}) < 40 AND length({strip('s')}) > length({strip('e')}) AS longer FROM a), c AS (SELECT doc_id, o, CASE WHEN longer THEN s ELSE e END AS t, CASE WHEN longer THEN 'second' ELSE 'embedded' END AS p FROM b)
SELECT doc_id, CASE WHEN length({strip('t')}) >= 40 THEN t WHEN coalesce(o, '') <> '' THEN o END AS text, CASE WHEN length({strip('t')}) >= 40 THEN p WHEN coalesce(o, '') <> '' THEN 'ocr' END AS parser FROM c""",
    "best_candidate_per_page": f"WITH a AS (SELECT conv_id AS doc_id, turn // 3 AS page, turn AS cfg, {strip('text')} AS text FROM conversations) SELECT doc_id, page, cfg, text FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY length(text) DESC, cfg) = 1 AND length(text) > 20",
    "inventory": "SELECT '/data/' || source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.PDF' ELSE '.pdf' END AS file_path, source AS raw_label, doc_id || CASE WHEN doc_id % 3 = 0 THEN '.PDF' ELSE '.pdf' END AS file_name, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END AS size_bytes, doc_id % 7 = 0 OR n_chars = 0 AS is_empty FROM documents WHERE doc_id % 3 <> 2",
    "validate_input": "SELECT doc_id, CASE WHEN lang NOT IN ('en', 'de') THEN 400 WHEN n_chars / 500 > 30 THEN 408 WHEN doc_id % 11 = 0 OR n_chars = 0 THEN 400 WHEN n_chars * 1000 > 10485760 THEN 413 WHEN doc_id % 4 = 0 THEN 422 END AS error_code FROM documents",
    "ready_join": "SELECT doc_id || '.txt' AS file_name, text FROM documents WHERE lang IN ('en', 'de') AND n_chars > 500",
    "ready_missing": "SELECT doc_id || '.txt' AS file_name FROM documents WHERE lang IN ('en', 'de') AND n_chars <= 500",
    "format_phone": f"WITH a AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '01' WHEN 1 THEN '1' ELSE '' END || (c_custkey * 7919 * 104729) AS digits FROM customer) SELECT c_custkey, digits, {format_phone('digits')} AS phone FROM a",
    "name_score": f"WITH {LINES} SELECT doc_id, pos, {name_score('line')} AS score FROM lined",
    "best_name": f"""WITH {LINES}, s AS (SELECT doc_id, pos, line, {name_score('line')} AS score, {company('line')} AS co FROM lined WHERE pos < 15), b AS (SELECT doc_id, line FROM s WHERE score > 0 AND NOT co QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1)
SELECT doc_id, array_to_string(list_transform({words('line')}, lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS name FROM resumes LEFT JOIN b USING (doc_id)""",
    "name_candidates": f"WITH {LINES} SELECT doc_id, pos, line, {name_score('line')} AS score FROM lined WHERE pos < 10",
    "name_bad": f"""WITH a AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Anna Resume' WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment || ' Lee' END AS t FROM customer)
SELECT c_custkey, t IS NULL OR length({strip('t')}) < 3 OR {' OR '.join(f"contains(lower(t), '{w}')" for w in v.BAD_NAME_WORDS)} OR len(list_filter({words('t')}, lambda w: regexp_full_match(w, '\\p{{L}}+'))) < 2 AS bad FROM a""",
    "label_slug": f"""SELECT p_partkey, {slug("' ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN '_Resumes' ELSE ' resume ' END")} AS slug FROM part""",
    "canonical_label": f"WITH {LABELLED} SELECT * FROM lab",
    "parse_uri": r"SELECT page_id, regexp_extract(url, '^([a-z0-9]+)://([^/]+)/?(.*)$', 1) AS scheme, regexp_extract(url, '^([a-z0-9]+)://([^/]+)/?(.*)$', 2) AS bucket, regexp_replace(regexp_extract(url, '^([a-z0-9]+)://([^/]+)/?(.*)$', 3), '^/+|/+$', '', 'g') AS prefix FROM pages",
    "noise_lines": f"WITH {LINES} SELECT doc_id, pos, {noise('line')} AS noise FROM lined",
    "drop_states": f"WITH {RESUMES} SELECT doc_id, len(list_filter({lines('text')}, lambda l: lower(l) NOT IN {listed(v.STATES)})) AS kept FROM resumes",
    "section_headers": f"WITH {HEADED} SELECT doc_id, pos, section, keyword, tail FROM headed WHERE section IS NOT NULL",
    "sections": f"""WITH {HEADED}, carried AS (SELECT doc_id, pos, last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sec, CASE WHEN section IS NULL THEN line ELSE tail END AS kept FROM headed)
SELECT doc_id, sec AS section, count(*) AS n_lines, string_agg(kept, '¦' ORDER BY pos) AS lines FROM carried WHERE sec IS NOT NULL AND kept IS NOT NULL GROUP BY doc_id, sec""",
    "section_dedupe": f"WITH {LINES}, kept AS (SELECT doc_id, pos, line FROM lined WHERE NOT {noise('line')} QUALIFY row_number() OVER (PARTITION BY doc_id, {collapse('lower(line)')} ORDER BY pos) = 1), j AS (SELECT doc_id, string_agg(line, '¦' ORDER BY pos) AS lines FROM kept GROUP BY doc_id) SELECT doc_id, coalesce(lines, '') AS lines FROM resumes LEFT JOIN j USING (doc_id)",
    "dedupe_ci": deduped("regexp_split_to_array(text, '[.\\n]')", "lower(x)"),
    "dedupe_ws": deduped("regexp_split_to_array(text, '[.\\n]')", f"lower({collapse('x')})"),
    "skills_exact": f"""WITH {RESUMES}, low AS (SELECT doc_id, {collapse('lower(text)')} AS t FROM resumes), toks AS (SELECT doc_id, t, list_distinct(regexp_split_to_array(t, '[^{W}]+')) AS ws FROM low),
f AS (SELECT doc_id, list_sort(list_concat(list_filter({array(PLAIN)}, lambda s: list_contains(ws, s)), list_filter([{", ".join(MARKED)}], lambda s: s IS NOT NULL))) AS skills FROM toks) SELECT doc_id, {join('skills')} AS skills FROM f""",
    "ngrams": f"WITH w AS (SELECT doc_id, {words('text')} AS ws FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) AS gs FROM w) SELECT doc_id, len(gs) AS n, md5({join('gs')}) AS grams_md5 FROM g",
    "backend": "SELECT CASE WHEN doc_id % 5 = 0 OR doc_id % 2 <> 0 THEN 'mock_heuristic' WHEN doc_id % 3 = 0 THEN 'mock_heuristic_fallback' ELSE 'ner_hybrid' END AS backend, count(*) AS n FROM documents GROUP BY 1",
    "quality_score": f"WITH {RESUMES}, {quality('resumes')} SELECT doc_id, garbled_ratio, {join('hs')} AS headers_found, has_email, text_length, scramble_ratio, {join('iss')} AS issues, verdict FROM q",
    "verdict_counts": f"WITH {quality('documents')} SELECT verdict, count(*) AS n FROM q GROUP BY verdict",
    "label_counts": f"WITH {LABELLED} SELECT canonical_label, count(*) AS n FROM lab GROUP BY 1",
    "label_variants": f"WITH {LABELLED} SELECT canonical_label, string_agg(DISTINCT raw_label, '¦' ORDER BY raw_label) AS variants FROM lab GROUP BY 1",
    "split_counts": f"WITH {COUNTED} SELECT * FROM splits",
    "stratified_split": f"WITH {COUNTED}, r AS (SELECT *, row_number() OVER (PARTITION BY canonical_label ORDER BY {HASHED}, doc_id) AS k FROM lab) SELECT doc_id, raw_label, canonical_label, CASE WHEN k <= n_train THEN 'train' WHEN k <= n_train + n_val THEN 'val' ELSE 'test' END AS split FROM r JOIN splits USING (canonical_label)",
    "holdout_split": f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {HASHED}, doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r",
    "seeded_sample": f"SELECT doc_id, source FROM documents ORDER BY {HASHED}, doc_id LIMIT 150",
    "batches": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 + 1 AS batch FROM documents",
    "parser_benchmark": f"WITH {PARSED} SELECT count(*) AS sampled, round(avg(ok::INT::DOUBLE), 4) AS non_empty_text_rate, round(coalesce(avg(chars) FILTER (WHERE ok), 0), 1) AS avg_chars_on_success FROM parsed",
    "top_errors": f"WITH {PARSED} SELECT error, count(*) AS n FROM parsed WHERE error IS NOT NULL GROUP BY error ORDER BY n DESC, error LIMIT 5",
    "group_entities": f"WITH {GROUPED} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1)::INT AS pos, text, label, score FROM ents",
    "peak_filter": f"WITH {TAGGED}, p AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS peak FROM tagged) SELECT doc_id, count(*) FILTER (WHERE peak >= 0.2 AND score >= greatest(0.17, 0.5 * peak))::INT AS kept, count(*)::INT AS n FROM p GROUP BY doc_id",
    "confidence": f"WITH {GROUPED}, c AS (SELECT doc_id, list_reduce(list(score ORDER BY island), lambda a, x: a + x) / count(*) AS m FROM ents WHERE label IN ('NAME', 'SKILL', 'EDUCATION', 'EXPERIENCE') GROUP BY doc_id) SELECT doc_id, coalesce(m, 0.45) AS confidence FROM (SELECT DISTINCT doc_id FROM tagged) LEFT JOIN c USING (doc_id)",
    "entities_by_label": f"""WITH {GROUPED}, e AS (SELECT doc_id, label, {strip('text')} AS t, island FROM ents), d AS (SELECT doc_id, label, t, min(island) AS island FROM e WHERE t <> '' GROUP BY ALL), j AS (SELECT doc_id, label, string_agg(t, '¦' ORDER BY island) AS ts FROM d GROUP BY ALL), n AS (SELECT doc_id, arg_min(t, island) AS name FROM e WHERE label = 'NAME' GROUP BY doc_id)
SELECT doc_id, nullif(name, '') AS name, coalesce(s.ts, '') AS skills, coalesce(x.ts, '') AS experience FROM (SELECT DISTINCT doc_id FROM tagged) LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, ts FROM j WHERE label = 'SKILL') s USING (doc_id) LEFT JOIN (SELECT doc_id, ts FROM j WHERE label = 'EXPERIENCE') x USING (doc_id)""",
    "entity_filter": f"WITH {ITEMS} SELECT doc_id, {join('cs')} AS items FROM c",
    "education_filter": f"WITH {ITEMS} SELECT doc_id, {join(f'list_filter(cs, lambda t: {LOW} NOT IN {listed(v.EDUCATION_HEADERS)})')} AS items FROM c",
    "experience_filter": rf"""WITH {ITEMS} SELECT doc_id, array_to_string(list_filter(cs, lambda t: NOT ({LOW} IN {listed(v.EXPERIENCE_HEADERS + v.EXPERIENCE_JUNK + v.EXPERIENCE_TAILS)}
  OR regexp_matches(t, '^{DG}{{1,4}}$|^{DG}{{2,4}}[{SP}]*[-–—][{SP}]*{DG}{{2,4}}$') OR regexp_matches(t, '^\p{{Ll}}{{1,3}}$') OR regexp_full_match(t, '\p{{L}}[{SP}]+[^{SP}]{{1,6}}') OR t IN {listed(v.EXPERIENCE_CODES)}
  OR (length(t) <= 10 AND NOT contains(t, ' ') AND lower(t) = t AND regexp_matches(t, '(zation|ization|isation)$')))), '¦') AS items FROM c""",
    "resolve_overlaps": """WITH RECURSIVE s AS (SELECT l_orderkey, (l_linenumber * 5 + l_partkey % 7)::INT AS a, (l_linenumber * 5 + l_partkey % 7 + l_suppkey % 11 + 1)::INT AS b, l_returnflag AS label FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, b DESC, label) AS k FROM s), r AS (SELECT l_orderkey, k, a, b, label, true AS kept, b AS last FROM o WHERE k = 1
UNION ALL SELECT o.l_orderkey, o.k, o.a, o.b, o.label, o.a >= r.last, CASE WHEN o.a >= r.last THEN o.b ELSE r.last END FROM r JOIN o ON o.l_orderkey = r.l_orderkey AND o.k = r.k + 1)
SELECT l_orderkey, a AS start, b AS "end", label FROM r WHERE kept""",
    "span_trim": r"""SELECT doc_id, (n_chars // 3 + length(regexp_replace(substr(text, (n_chars // 3 + 1)::BIGINT, 23), '[^\p{L}\p{N}]+$', '')))::INT AS "end" FROM documents""",
    "span_extract": rf"""WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0 AND {strip('text')} <> ''), s AS (SELECT doc_id, unnest([{{'a': 0, 'b': 9, 'l': 'NAME'}}, {{'a': 4, 'b': 30, 'l': 'SKILL'}}, {{'a': 12, 'b': 15, 'l': 'DATE'}}, {{'a': 60, 'b': 68, 'l': 'O'}}], recursive := true), text FROM d),
t AS (SELECT doc_id, a, a + length(regexp_replace(substr(text, a + 1, b - a), '[^\p{{L}}\p{{N}}]+$', '')) AS b, l FROM s), k AS (SELECT * FROM t WHERE b > a),
n AS (SELECT *, max(CASE WHEN l = 'NAME' THEN b END) OVER (PARTITION BY doc_id) AS name_end FROM k), m AS (SELECT *, max(CASE WHEN l = 'SKILL' AND a >= coalesce(name_end, 0) THEN b END) OVER (PARTITION BY doc_id) AS skill_end FROM n)
SELECT doc_id AS id, a AS start, b::INT AS "end", l AS label FROM m WHERE l = 'NAME' OR (l = 'SKILL' AND a >= coalesce(name_end, 0)) OR (l IN ('DATE', 'O') AND a >= greatest(coalesce(name_end, 0), coalesce(skill_end, 0)))""",
    "bio_tags": f"WITH {BIO}, j AS (SELECT doc_id, string_agg(tag, ' ' ORDER BY pos) AS tags FROM bio GROUP BY doc_id) SELECT doc_id, coalesce(tags, '') AS tags FROM documents LEFT JOIN j USING (doc_id)",
    "tag_histogram": f"WITH {BIO} SELECT tag, count(*) AS n, tag LIKE 'B-%' AND count(*) < 10 AS rare FROM bio GROUP BY tag",
    "bio_align": f"WITH {OFFSETS}, {SPANS} SELECT doc_id, pos, arg_min(l, (greatest(a, s), l)) AS label FROM off JOIN sp USING (doc_id) WHERE e > s AND a < e AND b > s GROUP BY doc_id, pos",
    "token_accuracy": f"WITH {TURNS} SELECT coalesce(sum(CASE WHEN p = l THEN 1 ELSE 0 END) / nullif(count(*), 0), 0) AS token_accuracy FROM t WHERE l <> -100",
    "ner_audit": f"WITH {AUDITED} SELECT error, count(*) AS n FROM a GROUP BY error",
    "ner_label_top": f"WITH {AUDITED}, b AS (SELECT conv_id, turn, l, min(CASE WHEN l <> -100 AND (l < 0 OR l >= 4) THEN turn END) OVER (PARTITION BY conv_id) AS bad FROM t) SELECT l::INT AS label, count(*) AS n FROM b JOIN a USING (conv_id) WHERE coalesce(error, '') IN ('', 'label out of range') AND (bad IS NULL OR turn < bad) GROUP BY 1 ORDER BY n DESC, label LIMIT 12",
}
