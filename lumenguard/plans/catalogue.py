"""Queries by name, and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks, pack
from ..functions import normalize as N
from ..functions import validators as V
from ..functions.spans import find, once
from ..operators import guard, metrics, policy, registry, report, risk, scan, signature
from ..operators.classify import classify, merge_verdicts, regex_verdict, types_of, worst_verdict
from ..sources import spread
from . import derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_text(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(key, text) of a derived column."""
    source, key, text = derived.TEXTS[name]
    return spread(table(spark, sf_dir, source)).select(F.col(key).alias("key"), F.expr(text).alias("text"))


def derived_sql(name: str) -> str:
    source, key, text = derived.TEXTS[name]
    return f"SELECT {key} AS key, {derived.duck(text)} AS text FROM {source}"


def one_pattern(df: DataFrame, p: pack.Pattern) -> DataFrame:
    """(key, value, start, end) of one pattern's findings, masked."""
    idx = pack.PATTERNS.index(p)
    found = df.select("key", F.explode(scan.pattern_matches(F.col("text"), idx, p)).alias("m"))
    return found.select("key", masks.mask(F.col("m.value")).alias("value"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))


def pattern_sql(p: pack.Pattern, source: str) -> str:
    return f'{derived.findings(p, source)} SELECT key, {derived.mask("v")} AS value, s AS start, e AS "end" FROM k'


def _register_scans() -> None:
    pan = derived.pattern("pan")
    for name, source, key, text in (("documents", "documents", "doc_id", "text"), ("pages", "pages", "page_id", "html")):
        query(f"scan_pan_{name}", pattern_sql(pan, f"SELECT {key} AS key, {text} AS text FROM {source}"))(
            lambda s, d, source=source, key=key, text=text: one_pattern(table(s, d, source).select(F.col(key).alias("key"), F.col(text).alias("text")), pan)
        )
    for name in derived.TEXTS:
        p = derived.pattern(name)
        query(f"scan_{name}_derived", pattern_sql(p, derived_sql(name)))(lambda s, d, name=name, p=p: one_pattern(derived_text(s, d, name), p))


def _captured(name: str) -> str:
    """(key, v): captures of a derived text, valid or not."""
    return f"SELECT key, unnest(regexp_extract_all(text, '{derived.quoted(derived.pattern(name))}', 1)) AS v FROM ({derived_sql(name)})"


def _register_validators() -> None:
    for name, source in (("ssn_area", "ssn"), ("luhn", "pan"), ("mod97", "iban"), ("npi_luhn", "npi"), ("not_empty_target", "generic_key"), ("contains_digit", "mrn")):
        p = derived.pattern(source)

        def run(s: SparkSession, d: str, source: str = source, p: pack.Pattern = p) -> DataFrame:
            values = derived_text(s, d, source).select("key", F.explode(find(F.col("text"), pack.java(p), 1)).alias("m"))
            return values.select("key", F.col("m.v").alias("v"), V.VALIDATORS[p.validator](F.col("m.v")).alias("valid"))

        query(f"validator_{name}", f"SELECT key, v, {derived.validator(p.validator, 'v')} AS valid FROM ({_captured(source)})")(run)


_register_scans()
_register_validators()

#: Every kind of text, a third of the customers each; SSN and card in one text, both spaced or with marks inside.
MIXED = (
    "concat(case when c_custkey % 3 = 0 then concat('id ', " + derived._pad("c_custkey * 37 % 1000", 3) + ", '-45-', " + derived._pad("c_custkey * 7919 % 10000", 4) + ") else c_name end, "
    "case when c_custkey % 2 = 0 then concat(' card 4', " + derived._pad("c_custkey * 7919", 15) + ") else '' end, "
    "case when c_custkey % 5 = 0 then concat(' NPI: ', " + derived._pad("1000000000 + c_custkey * 7919", 10) + ") else '' end, "
    "case when c_custkey % 4 = 0 then concat(' Patient MRN: M', " + derived._pad("c_custkey", 8) + ") else '' end)"
)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("key"), F.expr(MIXED).alias("text"), "c_nationkey", "c_mktsegment")


_MIXED_IDS = ("ssn", "pan", "mrn", "npi")
_MIXED_SQL = f"SELECT c_custkey AS key, {derived.duck(MIXED)} AS text, c_nationkey, c_mktsegment FROM customer"


def _all_findings(names: tuple[str, ...] = _MIXED_IDS) -> str:
    """WITH all_f (key, type, idx, conf, v, s, e) over the mixed texts."""
    parts = []
    for n in names:
        p = derived.pattern(n)
        parts.append(f"SELECT key, '{p.cls}' AS type, {pack.PATTERNS.index(p)} AS idx, {p.confidence}::double AS conf, v, s, e FROM ({derived.findings(p, 'SELECT key, text FROM mixed')} SELECT * FROM k)")
    return f"WITH mixed AS ({_MIXED_SQL}), all_f AS ({' UNION ALL '.join(parts)})"


def mixed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).withColumn("violations", once(F.expr(scan.scan_sql("text"))))


@query("findings_ordered", f'{_all_findings()} SELECT key, (row_number() OVER (PARTITION BY key ORDER BY conf DESC, idx, s) - 1)::int AS pos, type, {derived.mask("v")} AS value, s AS start, e AS "end", conf AS confidence FROM all_f')
def findings_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.exploded(mixed_findings(spark, sf_dir), "violations", ["key"]).select("key", "pos", "type", "value", "start", "end", "confidence")


@query("doc_verdict", f"{_all_findings()} SELECT key, CASE WHEN count(type) > 0 THEN 'VIOLATION' ELSE 'CLEAN' END AS verdict, count(type) AS n FROM mixed LEFT JOIN all_f USING (key) GROUP BY key")
def doc_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_findings(spark, sf_dir).select("key", regex_verdict(F.col("violations")).alias("verdict"), F.size("violations").cast("long").alias("n"))


@query("findings_by_type", f"{_all_findings()} SELECT type, count(*) AS n, count(DISTINCT key) AS docs FROM all_f GROUP BY type")
def findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.exploded(mixed_findings(spark, sf_dir), "violations", ["key"]).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("docs"))


@query("findings_top50", f"{_all_findings()}, r AS (SELECT *, row_number() OVER (PARTITION BY key % 10 ORDER BY conf DESC, idx, key, s) AS rn FROM all_f) SELECT key % 10 AS grp, type, count(*) AS n FROM r WHERE rn <= 50 GROUP BY ALL")
def findings_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 findings of each of ten joined inputs, by type."""
    rows = mixed(spark, sf_dir).select("key", F.explode(scan.raw_matches(F.col("text"))).alias("m")).select((F.col("key") % 10).alias("grp"), "key", "m.*")
    return report.listed(rows, ["grp"], [F.desc("confidence"), "idx", "key", "start"]).groupBy("grp", "type").agg(F.count(F.lit(1)).alias("n"))


@query("types_per_doc", f"{_all_findings()} SELECT key, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM all_f GROUP BY key")
def types_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_findings(spark, sf_dir).where(F.size("violations") > 0).select("key", F.array_join(types_of(F.col("violations")), ",").alias("types"))


@query("worst_verdict", f"{_all_findings()} SELECT CASE WHEN count(*) > 0 THEN 'VIOLATION' ELSE 'CLEAN' END AS verdict, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_code FROM all_f")
def worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worst_verdict(doc_verdict(spark, sf_dir))


@query("findings_by_nation_cube", f"{_all_findings()} SELECT c_nationkey, type, count(*) AS n FROM all_f JOIN mixed USING (key) GROUP BY CUBE (c_nationkey, type)")
def findings_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.exploded(mixed_findings(spark, sf_dir), "violations", ["key", "c_nationkey"]).cube("c_nationkey", "type").agg(F.count(F.lit(1)).alias("n"))


_POLICY = ", ".join(f"('{r.id}', '{r.action}', '{p}')" for r in policy.DEFAULT.rules for p in r.patterns)


@query("policy_default", f"{_all_findings()}, rules(id, action, type) AS (VALUES {_POLICY}), hit AS (SELECT DISTINCT key, id, action FROM all_f JOIN rules USING (type)) SELECT key, CASE WHEN bool_or(action = 'DENY') THEN 'DENY' WHEN EXISTS (SELECT 1 FROM all_f a WHERE a.key = mixed.key) THEN 'VIOLATION' ELSE 'CLEAN' END AS verdict, coalesce(string_agg('POLICY_' || action || ':' || id, ',' ORDER BY id), '') AS fired FROM mixed LEFT JOIN hit USING (key) GROUP BY key")
def policy_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = mixed_findings(spark, sf_dir).select("key", policy.apply(regex_verdict(F.col("violations")), F.col("violations")).alias("p"))
    fired = F.array_sort(F.filter(F.transform("p.violations", lambda v: v.type), lambda t: t.startswith("POLICY_")))
    by_id = F.array_join(F.transform(F.array_sort(F.transform(fired, lambda t: F.struct(F.substring_index(t, ":", -1).alias("id"), t.alias("t")))), lambda x: x.t), ",")
    return applied.select("key", "p.verdict", by_id.alias("fired"))


WARN_CARDS = policy.Policy("cards", "1", (policy.Rule("warn-cards", "Cards", ("PAN", "SSN"), "WARN"), policy.Rule("mask-mrn", "Records", ("MRN",), "REDACT")))


@query("policy_custom_warn", f"{_all_findings()} SELECT key, CASE WHEN count(type) > 0 THEN 'VIOLATION' ELSE 'CLEAN' END AS verdict, (count(type) + CASE WHEN count(*) FILTER (WHERE type IN ('PAN', 'SSN')) > 0 THEN 1 ELSE 0 END)::int AS n FROM mixed LEFT JOIN all_f USING (key) GROUP BY key")
def policy_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = mixed_findings(spark, sf_dir).select("key", policy.apply(regex_verdict(F.col("violations")), F.col("violations"), WARN_CARDS).alias("p"))
    return applied.select("key", "p.verdict", F.size("p.violations").alias("n"))


@query("redact_text", f"""{_all_findings()}, o AS (SELECT key, s, e, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM all_f),
g AS (SELECT key, s, e, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e) AS i FROM o), u AS (SELECT key, i, min(s) AS s, max(e) AS e FROM g GROUP BY key, i),
p AS (SELECT key, s, e, coalesce(lag(e) OVER (PARTITION BY key ORDER BY s), 0) AS prev FROM u), j AS (SELECT p.key, string_agg(substr(text, prev + 1, s - prev) || '[REDACTED]', '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS t FROM p JOIN mixed USING (key) GROUP BY p.key)
SELECT key, coalesce(t, text) AS redacted FROM mixed LEFT JOIN j USING (key)""")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_findings(spark, sf_dir).select("key", masks.redact(F.col("text"), F.col("violations")).alias("redacted"))


@query("merge_ranges", """WITH o AS (SELECT l_orderkey, l_linenumber * 3 + (l_partkey % 7)::int AS s, l_linenumber * 3 + (l_partkey % 7)::int + (l_suppkey % 4)::int + 1 AS e FROM lineitem),
r AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o), g AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e) AS i FROM r)
SELECT l_orderkey, min(s) AS start, max(e) AS "end" FROM g GROUP BY l_orderkey, i""")
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 3 + (F.col("l_partkey") % 7).cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(start.alias("start"), (start + (F.col("l_suppkey") % 4).cast("int") + 1).alias("end")).alias("r"))
    merged = rows.groupBy("l_orderkey").agg(masks.merge_ranges(F.collect_list("r")).alias("m"))
    return merged.select("l_orderkey", F.explode("m").alias("x")).select("l_orderkey", "x.start", "x.end")


@query("overlap_dedupe")
def overlap_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made from order lines, several with one value and overlapping; greedy, so SQL has no twin, and tests compare pairs."""
    start = F.col("l_linenumber") * 3 + (F.col("l_partkey") % 7).cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 2).cast("string").alias("value"), start.alias("start"), (start + (F.col("l_suppkey") % 9).cast("int") + 1).alias("end"), (F.col("l_linenumber") % 3 / 4).alias("confidence"), F.col("l_linenumber").alias("idx"))
    return scan.drop_overlaps_rows(rows.dropDuplicates(["l_orderkey", "value", "idx"]), ["l_orderkey"])


_ENV = "concat(case when c_custkey % 4 = 0 then 'process.env.KEY_' when c_custkey % 4 = 1 then '${env:KEY_' when c_custkey % 4 = 2 then 'os.getenv(''KEY_' else 'plain.KEY-' end, cast(c_custkey as string), case when c_custkey % 4 = 1 then '}' when c_custkey % 4 = 2 then ''')' else '' end)"


@query("env_reference_suppression", f"SELECT c_custkey AS key, v, {derived.reference('v')} AS is_reference FROM (SELECT c_custkey, {derived.duck(_ENV)} AS v FROM customer)")
def env_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.expr(_ENV).alias("v")).withColumn("is_reference", scan.is_reference(F.col("v")))


@query("mask_value", f"SELECT p_partkey AS key, {derived.mask('substr(p_name, 1, (p_partkey % 20 + 1)::int)')} AS masked FROM part")
def mask_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), masks.mask(F.expr("substring(p_name, 1, cast(p_partkey % 20 + 1 as int))")).alias("masked"))


@query("match_offsets", r"""WITH m AS (SELECT doc_id, string_split_regex(text, '[0-9]{2,}') AS gaps, regexp_extract_all(text, '[0-9]{2,}') AS ms FROM documents), x AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)
SELECT doc_id, ms[i] AS m, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::int AS s FROM x""")
def match_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(find(F.col("text"), "[0-9]{2,}")).alias("x")).select("doc_id", "x.m", "x.s")


@query("locate_line_column", "SELECT doc_id, place, len(string_split(substr(text, 1, place), chr(10)))::int AS line, (length(list_last(string_split(substr(text, 1, place), chr(10)))) + 1)::int AS \"column\" FROM (SELECT doc_id, text, (length(text) * 2 // 3)::int AS place FROM documents)")
def locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("cast(length(text) * 2 div 3 as int)").alias("place"))
    return rows.select("doc_id", "place", masks.line_column(F.col("text"), F.col("place")).alias("p")).select("doc_id", "place", "p.line", "p.column")


@query("zero_width_strip", "SELECT doc_id, md5(t) AS digest, (length(z) - length(t))::int AS removed FROM (SELECT doc_id, replace(text, ' t', ' ' || chr(8203) || 't' || chr(65279)) AS z, replace(text, ' t', ' t') AS t FROM documents)")
def zero_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = spread(table(spark, sf_dir, "documents")).select("doc_id", F.replace("text", F.lit(" t"), F.lit(" ​t﻿")).alias("z"))
    x = N.zero_width(F.col("z"))
    return marked.select("doc_id", F.md5(x["text"]).alias("digest"), x["removed"].alias("removed"))


@query("compact_view", r"SELECT doc_id, md5(c) AS digest, (length(z) - length(c))::int AS removed FROM (SELECT doc_id, z, regexp_replace(regexp_replace(z, '([0-9\-_/.:])\s+([0-9\-_/.:])', '\1\2', 'g'), '([0-9\-_/.:])\s+([0-9\-_/.:])', '\1\2', 'g') AS c FROM (SELECT doc_id, text || ' 12 34 5 6 - 7 ' || doc_id AS z FROM documents))")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" 12 34 5 6 - 7 "), F.col("doc_id").cast("string")).alias("z"))
    return spaced.select("doc_id", N.compact(F.col("z")).alias("x")).select("doc_id", F.md5("x.text").alias("digest"), "x.removed")


@query("nfkc_fullwidth_digits", "SELECT c_custkey AS key, translate(translate('n ' || c_custkey, '0123456789', '０１２３４５６７８９'), '０１２３４５６７８９', '0123456789') AS folded, length(c_custkey::varchar)::int AS changed FROM customer")
def nfkc_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.translate(F.concat(F.lit("n "), F.col("c_custkey").cast("string")), "0123456789", "０１２３４５６７８９").alias("t"))
    return wide.withColumn("x", N.nfkc(F.col("t"))).select("key", F.col("x.text").alias("folded"), "x.changed")


@query("nfkc_full")
def nfkc_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.nfkc(F.col("text")).alias("x")).select("doc_id", F.md5("x.text").alias("digest"), "x.changed")




@query("base64_candidates", "SELECT c_custkey AS key, unnest(list_filter(regexp_extract_all('token ' || to_base64(encode(c_name || ' 123-45-6789')) || ' end', '[A-Za-z0-9+/]{20,}={0,2}'), lambda x: length(x) >= 24)) AS v FROM customer")
def base64_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base64_texts(spark, sf_dir).select("key", F.explode(N.candidates(F.col("text"))).alias("c")).select("key", "c.v")


def _base64_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.regexp_replace(F.base64(F.concat("c_name", F.lit(" 123-45-6789")).cast("binary")), "[\r\n]", "")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("token "), payload, F.lit(" end")).alias("text"))


@query("base64_decode_view", "SELECT c_custkey AS key, c_name || ' 123-45-6789' AS text, 6 AS start, (6 + length(to_base64(encode(c_name || ' 123-45-6789'))))::int AS \"end\", 1 AS depth FROM customer")
def base64_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base64_texts(spark, sf_dir).select("key", F.explode(N.encoded_views(F.col("text"))).alias("v")).select("key", "v.text", "v.start", "v.end", "v.depth")


@query("url_decode_view", "SELECT c_custkey AS key, 'api_key=' || c_custkey || '+Ab3dEf6h:Ij9kLm2nOp5q' AS text FROM customer")
def url_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("api%5Fkey%3D"), F.col("c_custkey").cast("string"), F.lit("+Ab3dEf6h%3aIj9kLm2nOp5q")).alias("text"))
    return texts.select("key", F.explode(N.encoded_views(F.col("text"))).alias("v")).where("v.view = 'decoded-url'").select("key", "v.text")


@query("printable_gate", r"SELECT doc_id, length(text) > 0 AND length(regexp_replace(text, '[^\x20-\x7E\t\n\r]', '', 'g')) * 10 >= length(text) * 9 AS printable FROM documents")
def printable_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.printable(F.col("text")).alias("printable"))


@query("cross_view_dedupe", f"SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'compact' ELSE 'normalized' END AS view, count(*) AS n FROM (SELECT c_custkey, {derived.duck(derived._pad('c_custkey * 37 % 1000', 3))} || '-45-' || {derived.duck(derived._pad('c_custkey * 7919 % 10000', 4))} AS v FROM customer) WHERE {derived.validator('ssnArea', 'v')} GROUP BY ALL")
def cross_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SSNs, every second one spaced out; the other numbers of the text make a compact view as well, where the plain ones must not be found again."""
    a, b = derived._pad("c_custkey * 37 % 1000", 3), derived._pad("c_custkey * 7919 % 10000", 4)
    text = F.expr(f"concat('n 1 2 ', case when c_custkey % 2 = 0 then concat('x', ' ', {a}, ' - 45 - ', {b}) else concat('x ', {a}, '-45-', {b}) end, ' y')")
    done = classify(spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("key"), text.alias("text")), "text")
    return done.select("key", F.explode("result.violations").alias("v")).where("v.type = 'SSN'").groupBy("key", F.col("v.view").alias("view")).agg(F.count(F.lit(1)).alias("n"))


@query("comply_full_result")
def comply_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = classify(spread(table(spark, sf_dir, "documents")), "text")
    r = F.col("result")
    return done.select("doc_id", r["verdict"].alias("verdict"), F.to_json(r["violations"]).alias("violations"), F.to_json(r["normalizations"]).alias("normalizations"), F.array_join(r["layers"], ",").alias("layers"))


_LEVEL = "cast(c_custkey % 6 as int)"
_MULT = "CASE c_custkey % 6 WHEN 1 THEN 1.35 WHEN 2 THEN 1.15 WHEN 3 THEN 1.0 WHEN 4 THEN 0.8 ELSE 1.0 END"


@query("trust_multiplier", f"SELECT c_custkey AS key, ({_MULT})::double AS multiplier FROM customer")
def trust_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), risk.sensitivity(F.expr(_LEVEL)).cast("double").alias("multiplier"))


@query("risk_recommendation", "WITH s AS (SELECT c_custkey AS key, c_custkey % 5 * 25 AS t, c_custkey % 100 AS a, c_custkey % 37 AS b FROM customer), x AS (SELECT key, CASE WHEN key % 3 = 0 THEN t::double ELSE t * 0.6::double + (a + b) / 2.0::double * 0.4::double END AS score FROM s) SELECT key, round(score, 6) AS score, CASE WHEN score >= 70 THEN 'ALLOW' WHEN score >= 40 THEN 'ELEVATED_SCRUTINY' ELSE 'DENY' END AS recommendation FROM x")
def risk_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array((F.col("c_custkey") % 100).cast("double"), (F.col("c_custkey") % 37).cast("double")))
    score = risk.aggregate_score(F.expr("cast(c_custkey % 5 as int)"), signals)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.round(score, 6).alias("score"), risk.recommendation(score).alias("recommendation"))


def _registry_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's text comes from a package named as its nation."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("Pkg-"), "n_name").alias("package"))
    return mixed_findings(spark, sf_dir).join(nation, "c_nationkey")


def _registry(spark: SparkSession, sf_dir: str, alerts: bool) -> registry.Registry:
    nation = table(spark, sf_dir, "nation")
    fleet = nation.where("n_nationkey % 3 <> 2").select(F.lower(F.concat(F.lit("pkg-"), "n_name")).alias("name"), (F.col("n_nationkey") / 50).alias("anomaly_score"), F.lit(5).alias("event_count"))
    rows = nation.where("n_nationkey % 4 = 0").select(F.concat(F.lit("A"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("PKG-"), "n_name").alias("name"), F.lit("npm").alias("type"))
    page = spark.range(1).select(F.lit(7).cast("long").alias("alerts_held"), F.lit(7).cast("long").alias("total"), F.lit(1000).cast("long").alias("limit"), F.lit("current").alias("producer_state"), F.lit("every package").alias("population_kind"), F.lit(None).cast("string").alias("population_name"))
    return registry.Registry(fleet, rows if alerts else rows.limit(0), page)


_REG = f"""{_all_findings()}, d AS (SELECT key, c_nationkey AS k, 'Pkg-' || n_name AS package, CASE WHEN EXISTS (SELECT 1 FROM all_f a WHERE a.key = mixed.key) THEN 'VIOLATION' ELSE 'CLEAN' END AS base, ({_MULT.replace("c_custkey", "key")})::double AS mult FROM mixed JOIN nation ON n_nationkey = c_nationkey),
x AS (SELECT *, CASE WHEN k % 3 <> 2 THEN k / 50.0::double END AS score, k % 4 = 0 AND {{alerts}} AS alert FROM d), y AS (SELECT *, CASE WHEN score IS NULL AND NOT alert THEN 'miss' ELSE 'hit' END AS status, coalesce(score * mult > 0.3 AND NOT alert, false) AS raised FROM x)"""


def _registry_query(spark: SparkSession, sf_dir: str, alerts: bool, unknown: Column) -> DataFrame:
    found = registry.lookup(_registry_docs(spark, sf_dir), "package", _registry(spark, sf_dir, alerts))
    after = registry.apply(regex_verdict(F.col("violations")), F.col("violations"), F.col("lookup"), F.col("package"), F.expr("cast(key % 6 as int)"), unknown)
    last = F.try_element_at("r.violations", F.lit(-1))["type"]
    return found.select("key", after.alias("r")).select("key", "r.verdict", "r.signals.status", F.round("r.signals.threshold_delta", 2).cast("double").alias("delta"), F.when(last.rlike("REGISTRY|FLEET|SUPPLY"), last).alias("added"))


@query("registry_l2_fleet", _REG.replace("{alerts}", "false") + " SELECT key, CASE WHEN raised AND base = 'CLEAN' THEN 'VIOLATION' ELSE base END AS verdict, status, CASE WHEN raised THEN -0.15 ELSE 0.0 END::double AS delta, CASE WHEN raised AND base = 'CLEAN' THEN 'FLEET_ANOMALY_ELEVATED' END AS added FROM y")
def registry_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry_query(spark, sf_dir, False, F.lit(None).cast("string"))


@query("registry_l2_alert_block", _REG.replace("{alerts}", "true") + " SELECT key, CASE WHEN alert THEN 'DENY' WHEN raised AND base = 'CLEAN' THEN 'VIOLATION' ELSE base END AS verdict, status, CASE WHEN raised THEN -0.15 ELSE 0.0 END::double AS delta, CASE WHEN alert THEN 'SUPPLY_CHAIN_ALERT' WHEN raised AND base = 'CLEAN' THEN 'FLEET_ANOMALY_ELEVATED' END AS added FROM y")
def registry_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry_query(spark, sf_dir, True, F.lit(None).cast("string"))


@query("registry_unknown_action", _REG.replace("{alerts}", "false") + " SELECT key, CASE WHEN status = 'miss' THEN CASE WHEN key % 2 = 0 THEN 'DENY' ELSE 'VIOLATION' END WHEN raised AND base = 'CLEAN' THEN 'VIOLATION' ELSE base END AS verdict, status, CASE WHEN raised THEN -0.15 ELSE 0.0 END::double AS delta, CASE WHEN status = 'miss' THEN 'REGISTRY_UNKNOWN' WHEN raised AND base = 'CLEAN' THEN 'FLEET_ANOMALY_ELEVATED' END AS added FROM y")
def registry_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry_query(spark, sf_dir, False, F.when(F.col("key") % 2 == 0, "deny").otherwise("violation"))


@query("guard_mapping", "SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 3 THEN NULL WHEN c_custkey % 2 = 0 AND c_custkey % 11 / 10.0 > 0.8 THEN 'VIOLATION' ELSE 'CLEAN' END AS verdict FROM customer")
def guard_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with confidences from 0 to 1 (0.8 itself is clean); every seventh has a confidence that is no number and counts as none."""
    confidence = F.when(F.col("c_custkey") % 7 == 3, F.lit('"high"')).otherwise((F.col("c_custkey") % 11 / 10).cast("string"))
    attack = F.when(F.col("c_custkey") % 2 == 0, "tool_misuse").otherwise("")
    raw = F.concat(F.lit('{"intent":"i","result":"r","confidence":'), confidence, F.lit(',"attackClass":"'), attack, F.lit('","latencyMs":3,"modelVersion":"m"}'))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("text"), guard.parsed(raw).alias("g"))
    return rows.select("key", guard.mapped(F.col("g"), F.col("text"))["verdict"].alias("verdict"))


_V3 = "CASE {} % 4 WHEN 0 THEN 'DENY' WHEN 1 THEN 'VIOLATION' WHEN 2 THEN 'CLEAN' END"


@query("verdict_merge", f"SELECT o_orderkey AS key, CASE WHEN 'DENY' IN (a, b) THEN 'DENY' WHEN 'VIOLATION' IN (a, b) THEN 'VIOLATION' ELSE 'CLEAN' END AS verdict FROM (SELECT o_orderkey, coalesce({_V3.format('o_orderkey')}, 'CLEAN') AS a, coalesce({_V3.format('o_custkey')}, 'CLEAN') AS b FROM orders)")
def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), merge_verdicts(F.expr(_V3.format("o_orderkey")), F.expr(_V3.format("o_custkey"))).alias("verdict"))


_CASES = "SELECT key, 'SSN' AS class, CASE WHEN key % 2 = 0 THEN 'positive' ELSE 'negative' END AS label, CASE WHEN key % 3 = 0 THEN 'canonical' ELSE 'other' END AS variant"
_HITS = f"{_all_findings()}, c AS ({_CASES}, EXISTS (SELECT 1 FROM all_f a WHERE a.key = mixed.key AND a.type = 'SSN') AS hit FROM mixed)"
_AGG = "count(*) FILTER (WHERE label = 'positive' AND hit) AS tp, count(*) FILTER (WHERE label <> 'positive' AND hit) AS fp, count(*) FILTER (WHERE label = 'positive' AND NOT hit) AS fn, count(*) FILTER (WHERE label <> 'positive' AND NOT hit) AS tn"
_RATES = "CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END::double AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END::double AS recall"
_F1 = "CASE WHEN precision + recall = 0 THEN 0.0 ELSE precision * 2 * recall / (precision + recall) END::double AS f1"


def _accuracy(spark: SparkSession, sf_dir: str, variant: str | None) -> DataFrame:
    rows = mixed_findings(spark, sf_dir).select(F.lit("SSN").alias("class"), F.when(F.col("key") % 2 == 0, "positive").otherwise("negative").alias("label"), F.when(F.col("key") % 3 == 0, "canonical").otherwise("other").alias("variant"), types_of(F.col("violations")).alias("types"))
    found = metrics.accuracy(rows, "class", "label", "types", variant)
    for c in ("precision", "recall", "f1"):
        found = found.withColumn(c, F.round(c, 9))
    return found


_ROUNDED = "tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"


@query("precision_recall_f1", f"{_HITS}, a AS (SELECT class, {_AGG} FROM c GROUP BY class), b AS (SELECT *, {_RATES} FROM a), e AS (SELECT *, {_F1} FROM b) SELECT class, {_ROUNDED} FROM e")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accuracy(spark, sf_dir, None)


@query("precision_recall_grouping_sets", f"{_HITS}, a AS (SELECT class, variant, {_AGG} FROM c GROUP BY GROUPING SETS ((class), (class, variant))), b AS (SELECT *, {_RATES} FROM a), e AS (SELECT *, {_F1} FROM b) SELECT class, variant, {_ROUNDED} FROM e")
def precision_recall_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accuracy(spark, sf_dir, "variant")


@query("freshness_check", "SELECT event_id, CASE WHEN age > 300000 THEN 'STALE' WHEN -age > 30000 THEN 'FUTURE_DATED' END AS error FROM (SELECT event_id, (event_id * 7919 % 700001) - 60000 AS age FROM events)")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(1_700_000_000_000).cast("long")
    return table(spark, sf_dir, "events").select("event_id", signature.freshness(now - ((F.col("event_id") * 7919 % 700001) - 60000), now).alias("error"))


_CLASSES = [*signature.MIN_TIER, *signature.ABSOLUTE_DENY, "unheard-of"]


@query("tier_matrix", "WITH c(class, need) AS (VALUES " + ", ".join(f"('{c}', {signature.TIERS[signature.MIN_TIER[c]] if c in signature.MIN_TIER else 'NULL'})" for c in _CLASSES) + "), t(tier, have) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in signature.TIERS.items()) + ") SELECT class, tier, CASE WHEN class LIKE 'credential-%' THEN 'ABSOLUTE_DENY' WHEN need IS NULL THEN 'UNKNOWN_CLASSIFICATION' WHEN have < need THEN 'TIER_REJECTED' END AS error FROM c, t")
def tier_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in _CLASSES])).alias("class")).select("class", F.explode(F.array(*[F.lit(t) for t in signature.TIERS])).alias("tier"))
    return rows.select("class", "tier", signature.tier_error(F.col("class"), F.col("tier")).alias("error"))


@query("findings_by_hour", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE regexp_matches(props, '[0-9]{2}') GROUP BY 1")
def findings_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts as a batch; the streaming form is in ``lumenguard.streaming``."""
    rows = table(spark, sf_dir, "events").where(F.col("props").rlike("[0-9]{2}"))
    return rows.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "n")


from . import cases  # noqa: E402, F401  registers its queries here
