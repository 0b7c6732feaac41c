"""The queries' answers in DuckDB's SQL, written apart from the operators."""

from .line_dedup import LONG, MIN_WORDS, STEP
from .quality_rules import RULES, Params
from .secret_scan import EXAMPLE_OWNERS
from .secret_scan import KINDS as SECRETS

_P = Params()


def _quartile(k: int, of: str) -> str:
    return f"min(CASE WHEN c * 4 >= n * {k} THEN v END) AS {of}q{k}"


def _merged(name: str, keys: str, of: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""
{name}_c AS (SELECT {by}measure, v, sum(n) AS n FROM sketch GROUP BY ALL),
{name}_r AS (SELECT {by}measure, v, sum(n) OVER (PARTITION BY {by}measure ORDER BY v) AS c, sum(n) OVER (PARTITION BY {by}measure) AS n FROM {name}_c),
{name} AS (SELECT {by}measure, max(n) AS {of}n, {_quartile(1, of)}, {_quartile(3, of)} FROM {name}_r GROUP BY ALL)"""


def _pick(k: int) -> str:
    return f"CASE WHEN own.o_n >= {_P.min_group} THEN o_q{k} WHEN l_n >= {_P.min_group} THEN l_q{k} ELSE e_q{k} END AS q{k}"


_LIMITS = ", ".join(
    f"max(CASE WHEN measure = '{r.name}' THEN {'q3 +' if r.upper else 'q1 -'} greatest(q3 - q1, {r.least_spread}) * {_P.fence} END) AS limit_{i}" for i, r in enumerate(RULES)
)
_INSIDE = " AND ".join(f"{r.name} {'<=' if r.upper else '>='} limit_{i}" for i, r in enumerate(RULES))

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
win2 AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM win),
win3 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win2),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM win3, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, lang, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)
),
x AS (
  SELECT *, coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) AS symbols_pm, coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS dup_lines_pm,
    coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeats_pm, coalesce(word_chars * 100 // nullif(n_words, 0), 0) AS word_length
  FROM m
),
long AS (UNPIVOT (SELECT rid, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, symbols_pm, dup_lines_pm, repeats_pm, word_length FROM x) ON symbols_pm, dup_lines_pm, repeats_pm, word_length INTO NAME measure VALUE raw),
sketch AS (SELECT lang, source, measure, (raw >> greatest(length(bin(raw)) - 6, 0)::BIGINT) << greatest(length(bin(raw)) - 6, 0)::BIGINT AS v, count(*) AS n FROM long GROUP BY ALL),
{_merged("own", "lang, source", "o_")},
{_merged("lg", "lang", "l_")},
{_merged("every", "", "e_")},
q AS (SELECT own.lang, own.source, own.measure, {_pick(1)}, {_pick(3)} FROM own JOIN lg USING (lang, measure) JOIN every USING (measure)),
lim AS (SELECT lang, source, {_LIMITS} FROM q GROUP BY ALL),
y AS (SELECT x.*, (n_words < {_P.min_words} OR 100 * n_repeat_words > {_P.max_repeat_percent} * n_words) AS base_failed, ({_INSIDE}) AS inside
  FROM x JOIN lim ON coalesce(x.lang, chr(0)) = lim.lang AND coalesce(x.source, chr(0)) = lim.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND inside) AS kept FROM y
"""

DECONTAMINATION = r"""
WITH az AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, az),
bw AS (SELECT item_id, least(len(ws), 13) AS size, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM bw),
sizes AS (SELECT DISTINCT size FROM win),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, az),
dw AS (SELECT rid, size, i, array_to_string(ws[i:i + size - 1], ' ') AS w FROM (SELECT rid, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes)),
hit AS (SELECT DISTINCT rid, size, i, item_id FROM dw JOIN win USING (size, w)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""


def _spans(i: int) -> str:
    k = SECRETS[i]
    quoted = k.pattern.replace("'", "''")
    secret = f"regexp_extract_all(text, '{quoted}', {k.secret})"
    return f"""SELECT rid, {i} AS k, i, len(gaps) AS n, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s, length(found[i]) AS len, secrets[i] AS v
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT rid, string_split_regex(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}') AS found, {secret} AS secrets FROM d))
  WHERE length(secrets[i]) >= {k.least}"""


def _listed(of: str, where: str = "TRUE") -> str:
    names = "[" + ", ".join(f"'{k.name}'" for k in SECRETS) + "]"
    return f"coalesce(string_agg({names}[k + 1] || ':' || s || ':' || (s + len), ',' ORDER BY s, k) FILTER (WHERE {where}), '') AS {of}"


SECRET_SCAN = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_spans(i) for i in range(len(SECRETS)))}),
o AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners FROM f JOIN d USING (rid) GROUP BY v),
g AS (SELECT f.*, owners < {EXAMPLE_OWNERS} AS live FROM f JOIN o USING (v)),
kept AS (SELECT * FROM g WHERE k < 3 OR (live AND NOT EXISTS (SELECT 1 FROM g b WHERE b.rid = g.rid AND b.k < 3 AND b.s < g.s + g.len AND g.s < b.s + b.len))),
a AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2, count(*) FILTER (WHERE live) AS n_live, {_listed("base", "k < 3")}, {_listed("spans")} FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN a USING (rid)
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(text, '') AS t FROM documents),
g AS (SELECT rid, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split_regex(t, '[^\x20\x09-\x0D]+') AS gaps FROM d),
w0 AS (SELECT rid, doc_id, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS w, unnest(gaps[1:len(ws)]) AS gap, unnest(gaps[2:]) AS after FROM g WHERE len(ws) > 0),
w1 AS (SELECT *, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lw, sum(length(gap) + length(w)) OVER o AS e, k = n OR contains(after, chr(10)) AS line_end,
  k = n OR contains(after, chr(10)) OR regexp_matches(w, '[.!?]$') AS closes, coalesce(sum((contains(gap, chr(10)))::INT) OVER o, 0) AS line FROM w0 WINDOW o AS (PARTITION BY rid ORDER BY k)),
w2 AS (SELECT *, e - length(w) AS s, coalesce(sum(closes::INT) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM w1),
w3 AS (SELECT *, closes OR (count(*) OVER (PARTITION BY rid, piece) > {LONG} AND strlen(w) % {STEP} = 0) AS cut FROM w2),
w4 AS (SELECT *, coalesce(lag(cut) OVER (PARTITION BY rid ORDER BY k), TRUE) AS starts FROM w3),
w5 AS (SELECT *, min(CASE WHEN cut THEN k END) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_cut, max(CASE WHEN starts THEN k END) OVER (PARTITION BY rid ORDER BY k) AS last_start FROM w4),
u0 AS (SELECT a.rid, a.k AS f, b.next_cut AS l FROM w5 a JOIN w5 b ON a.rid = b.rid AND b.k = a.k + {MIN_WORDS - 1} WHERE a.starts
  UNION SELECT a.rid, b.last_start, a.k FROM w5 a JOIN w5 b ON a.rid = b.rid AND b.k = a.k - {MIN_WORDS - 1} WHERE a.line_end),
u1 AS (SELECT rid, f, l, unnest(range(f, l + 1)) AS k FROM u0),
u AS (SELECT rid, f, l, any_value(doc_id) AS doc_id, min(s) AS s, max(e) AS e, md5(string_agg(lw, ' ' ORDER BY k)) AS unit FROM u1 JOIN w2 USING (rid, k) GROUP BY rid, f, l),
v AS (SELECT *, first(rid) OVER o AS f_rid, first(s) OVER o AS f_s, first(e) OVER o AS f_e FROM u WINDOW o AS (PARTITION BY unit ORDER BY doc_id, s, rid, e)),
gone AS (SELECT DISTINCT rid, f, l FROM v WHERE (rid, s, e) <> (f_rid, f_s, f_e) AND NOT (rid = f_rid AND s < f_e)),
c AS (SELECT DISTINCT rid, unnest(range(f, l + 1)) AS k FROM gone),
r0 AS (SELECT rid, k, s, e, line, k - row_number() OVER (PARTITION BY rid ORDER BY k) AS run FROM c JOIN w2 USING (rid, k)),
r AS (SELECT rid, run, min(s) AS s, max(e) AS e FROM r0 GROUP BY ALL),
n AS (SELECT rid, count(*) AS n_removed_words, count(DISTINCT line) AS n_removed FROM r0 GROUP BY rid),
sp AS (SELECT rid, string_agg(s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s) AS removed_spans, [0] || list(e ORDER BY s) AS froms, list(s ORDER BY s) AS tos FROM r GROUP BY rid),
p0 AS (SELECT rid, t, i, froms[i] AS a, coalesce(tos[i], length(t)) AS z, i > 1 AS cut_l, i <= len(tos) AS cut_r FROM (SELECT rid, t, froms, tos, unnest(range(1, len(froms) + 1)) AS i FROM sp JOIN d USING (rid))),
p1 AS (SELECT *, substr(t, (a + 1)::INT, (z - a)::INT) AS x FROM p0),
p2 AS (SELECT *, cut_l AND regexp_matches(x, '^[ \t\r]*\n') AS l_end, CASE WHEN cut_l THEN regexp_replace(x, '^[ \t\r]*\n?', '') ELSE x END AS y FROM p1),
p3 AS (SELECT *, cut_r AND regexp_matches(y, '\n[ \t\r]*\z') AS r_end, CASE WHEN cut_r THEN regexp_replace(y, '\n?[ \t\r]*\z', '') ELSE y END AS q FROM p2),
kept AS (SELECT rid, string_agg(q, chr(10) ORDER BY i) AS left_text FROM p3 WHERE q <> '' OR (cut_l::INT + cut_r::INT = l_end::INT + r_end::INT) GROUP BY rid)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + 1 END::BIGINT AS n_lines, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words,
  coalesce(removed_spans, '') AS removed_spans, coalesce(n_removed_words, 0) = 0 AS untouched, CASE WHEN text IS NULL OR n_removed_words IS NULL THEN text ELSE coalesce(left_text, '') END AS text
FROM d JOIN g USING (rid, doc_id) LEFT JOIN n USING (rid) LEFT JOIN sp USING (rid) LEFT JOIN kept USING (rid)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
r AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS component FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""

_HOST = r"translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, url FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS response,
  CASE WHEN url IS NULL THEN '' ELSE array_to_string(list_reverse(string_split({_HOST}, '.')), ',') || ')' || regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) || regexp_extract(rest, '\?[^#]*') END AS url_key FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: printf('%04d', bin(strpos('0123456789abcdef', substr(hex, i::INT, 1)) - 1)::INT)), '') AS bits FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (list_reduce(list_transform(range(1, 6), lambda k: substr(bits, (5 * i + k)::INT, 1)::INT), lambda a, x: 2 * a + x) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < response THEN response END AS refers_to, url_key,
  row_number() OVER (ORDER BY url_key COLLATE "binary", page_id) - 1 AS place, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS capture_no
FROM b
"""

_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def _rule(column: int) -> str:
    """Longest first."""
    cases = []
    for r in sorted(_RULES, key=lambda r: -len(r[1])):
        own, _, start = r[1].partition("/")
        cases.append(f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{start}') THEN '{r[column]}'")
    return f"CASE {' '.join(cases)} END"


_TOKENS = " || ".join(
    f"list_transform(list_filter({of}, lambda x: x <> ''), lambda x: '{kind}:' || x)"
    for kind, of in (
        ("host", "string_split(host, '.')"),
        ("path", "string_split(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/')"),
        ("query", r"list_transform(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1))"),
    )
)
_SETS = " UNION ALL ".join(
    f"SELECT [{', '.join(f'{x}.tok' for x in names)}] AS toks, page_id, a.bad AS bad FROM top a " + " ".join(f"JOIN top {x} USING (page_id)" for x in names[1:]) + (f" WHERE {' AND '.join(f'{x}.tok < {y}.tok' for x, y in zip(names, names[1:], strict=False))}" if len(names) > 1 else "")
    for names in ("a", "ab", "abc")
)

URL_FILTER = rf"""
WITH p0 AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT *, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0),
t AS (SELECT DISTINCT page_id, url, unnest({_TOKENS}) AS tok FROM p WHERE url IS NOT NULL),
l AS (SELECT page_id, bool_or(toxic = 1 OR quality = 0) AS bad FROM p JOIN labels ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[^0-9]|$)', 1) AS BIGINT) GROUP BY page_id),
least_n AS (SELECT greatest(20, ceil(count(*) * 2 / 1000.0)) AS m FROM l),
f AS (SELECT tok FROM t JOIN l USING (page_id), least_n WHERE bad GROUP BY tok, m HAVING count(*) >= m),
top AS (SELECT page_id, bad, tok FROM t JOIN l USING (page_id) JOIN f USING (tok)),
s AS (SELECT toks, count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad FROM ({_SETS}) GROUP BY toks),
sure AS (SELECT toks, n, n_bad FROM s, least_n WHERE n_bad >= m AND n_bad * 100 >= n * 60),
rules AS (SELECT * FROM sure x WHERE NOT EXISTS (SELECT 1 FROM sure y WHERE len(y.toks) < len(x.toks) AND list_has_all(x.toks, y.toks) AND y.n_bad * x.n >= x.n_bad * y.n)),
u AS (SELECT url, list(DISTINCT tok) AS toks FROM t GROUP BY url),
m AS (SELECT url, array_to_string(rules.toks, ' & ') AS mined_rule FROM u JOIN rules ON list_has_all(u.toks, rules.toks) QUALIFY row_number() OVER (PARTITION BY url ORDER BY n_bad / n DESC, n DESC, array_to_string(rules.toks, ' & ') DESC) = 1)
SELECT page_id, host, path, {_rule(1)} AS rule, coalesce({_rule(0)}, CASE WHEN mined_rule IS NULL THEN 'allow' ELSE 'block' END) AS verdict, mined_rule FROM p LEFT JOIN m USING (url)
"""
