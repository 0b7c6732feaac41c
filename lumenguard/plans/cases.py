"""Queries over texts made for the purpose: an accuracy corpus, single cases, and states of registry, guard and packs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pack
from ..operators import guard, metrics, registry, report
from ..operators.classify import classify, input_verdict
from ..sources import spread
from ..streaming import windowed_counts
from .catalogue import query, table

#: A class's texts are this many that hold a finding and as many that nearly do.
PER_LABEL = 200


def padded(value: str, width: int) -> str:
    return f"lpad(cast({value} as string), {width}, '0')"


def checked(prefix: str) -> str:
    """``prefix`` with the digit that makes its check sum right."""
    return f"get(filter(transform(sequence(0, 9), d -> concat({prefix}, cast(d as string))), x -> luhn_check(x)), 0)"


def off_by_one(value: str) -> str:
    return f"concat(substring({value}, 1, length({value}) - 1), cast((cast(right({value}, 1) as int) + 1) % 10 as string))"


_HEX = "sha2(cast(i as string), 256)"
_CARD = checked(f"concat('4', {padded('i * 7919 % 1000003', 14)})")
_NPI = checked(f"concat('80840', '1', {padded('i * 7919 % 100003', 8)})")
_BBAN = padded("i * 104729", 18)
#: For each class what a positive and a negative text holds, as SQL over the number i; key-shaped values are put together here.
VALUES = {
    "SSN": (
        f"concat({padded('1 + i * 37 % 665', 3)}, '-', {padded('1 + i % 99', 2)}, '-', {padded('1 + i * 7919 % 9999', 4)})",
        f"case i % 5 when 0 then concat('666-12-', {padded('1 + i', 4)}) when 1 then concat('9', {padded('i % 100', 2)}, '-12-', {padded('1 + i', 4)}) when 2 then concat('000-12-', {padded('1 + i', 4)}) when 3 then concat('123-00-', {padded('1 + i', 4)}) else concat({padded('1 + i', 3)}, '-12-0000') end",
    ),
    "PAN": (_CARD, f"case i % 3 when 0 then {off_by_one(_CARD)} when 1 then concat('9', {padded('i * 7919', 12)}) else concat('4', {padded('i', 9)}) end"),
    "IBAN": (f"concat('DE', {padded('check_digits', 2)}, {_BBAN})", f"concat('DE', {padded('1 + (check_digits + i % 50) % 97', 2)}, {_BBAN})"),
    "NPI": (f"concat('NPI: ', substring({_NPI}, 6))", f"concat('NPI: ', {off_by_one(f'substring({_NPI}, 6)')})"),
    "CUI": ("element_at(array('CUI//SP-PRVCY', 'CUI//NOFORN', 'FOR OFFICIAL USE ONLY', 'CONTROLLED UNCLASSIFIED INFORMATION'), cast(1 + i % 4 as int))", "element_at(array('the cui program', 'official use of the room', 'unclassified notes', 'controlled information'), cast(1 + i % 4 as int))"),
    "CREDENTIAL": (
        f"case i % 4 when 0 then concat('AKI', 'A', upper(substring({_HEX}, 1, 16))) when 1 then concat('gh', 'p_', substring({_HEX}, 1, 36)) when 2 then concat('s', 'k-', substring({_HEX}, 1, 48)) else concat('Bearer ', substring({_HEX}, 1, 32)) end",
        f"case i % 4 when 0 then concat('AKI', 'A', upper(substring({_HEX}, 1, 12))) when 1 then concat('gh', 'p_', substring({_HEX}, 1, 20)) when 2 then concat('s', 'k-', substring({_HEX}, 1, 20)) else 'api_key = ${{API_KEY_NAME}}' end",
    ),
    "PASSPORT": (f"concat('Passport: AB', {padded('1000000 + i * 7919', 7)})", f"case i % 2 when 0 then concat('order AB', {padded('1000000 + i', 7)}) else concat('passport office ', cast(i as string)) end"),
    "MRN": (f"concat('MRN: A', {padded('i', 7)})", "element_at(array('the MRN system', 'MRN records kept', 'an MRN number'), cast(1 + i % 3 as int))"),
}
_WIDE = "translate({v}, '0123456789', '０１２３４５６７８９')"
#: How every second positive text hides its value; the last two only for values that are told by themselves.
VARIANTS = {
    "nfkc": _WIDE,
    "zero-width": "regexp_replace({v}, '(?<=.)(?=.)', '​')",
    "whitespace": "regexp_replace({v}, '(?<=[0-9])(?=[0-9])', ' ')",
    "base64": "base64(cast(concat('see ', {v}, ' ok') as binary))",
    "url-encoded": "concat('%73%65%65%20', replace(url_encode({v}), '+', '%20'), '%20ok%20then')",
}
DECODED = ("SSN", "PAN", "IBAN", "CREDENTIAL")


def accuracy_texts(spark: SparkSession) -> DataFrame:
    """(class, label, text, variant)."""
    # D and E count as 13 and 14, and the country and two zeros go last
    numbers = spark.range(PER_LABEL).selectExpr("id as i", f"cast(98 - cast(concat({_BBAN}, '131400') as decimal(38, 0)) % 97 as int) as check_digits")
    made = []
    for cls, (yes, no) in VALUES.items():
        names = [*VARIANTS][: 5 if cls in DECODED else 3]
        pick = f"element_at(array({', '.join(map(repr, names))}), cast(1 + i div 2 % {len(names)} as int))"
        hidden = " ".join(f"when '{n}' then {VARIANTS[n].format(v='v')}" for n in names)
        text = f"get(transform(array({yes}), v -> concat('Note on file: ', case variant {hidden} else v end, ' end')), 0)"
        variant = f"get(transform(array(case when i % 2 = 0 then 'canonical' else {pick} end), variant -> named_struct('class', '{cls}', 'label', 'positive', 'text', {text}, 'variant', variant)), 0)"
        made += [variant, f"named_struct('class', '{cls}', 'label', 'negative', 'text', concat('Note on file: ', {no}, ' end'), 'variant', 'near')"]
    return numbers.selectExpr(f"inline(array({', '.join(made)}))")  # one plan for all; a union would have the scan once for each part


def typed(rows: DataFrame) -> DataFrame:
    done = classify(rows, "text")
    return done.withColumn("types", F.array_sort(F.array_distinct("result.violations.type")))


@query("accuracy_corpus", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', 200::BIGINT, 0::BIGINT, 0::BIGINT, 200::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE)" for c in VALUES) + ") t(class, tp, fp, fn, tn, precision, recall, f1)")
def accuracy_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published accuracy of every class, on texts of the same make-up."""
    return metrics.accuracy(typed(accuracy_texts(spark)), "class", "label", "types")


_KEY = "k" + "3Y9" * 12
#: Cases as (text, types of findings); references name where a secret is and are none.
CASES = [
    *((text, "") for text in (
        "const k = process.env.SERVICE_KEY;", "api_key = process.env['SERVICE_KEY']", 'api_key = process.env["SERVICE_KEY"]', "apiKey: import.meta.env.VITE_SERVICE_KEY",
        "api_key = os.environ['SERVICE_KEY']", "api_key = os.environ.get('SERVICE_KEY')", "api_key = os.getenv('SERVICE_KEY')", 'api_key = System.getenv("SERVICE_KEY")',
        '"api_key": "${SERVICE_KEY}"', "api_key = ${env:SERVICE_KEY_NAME}", "api_key = $SERVICE_KEY_NAME_HERE", "Authorization: Bearer ${SERVICE_TOKEN}",
        "SERVICE_API_KEY=\nOTHER_VARIABLE=plain", "A_SECRET_KEY=\nB_ACCESS_TOKEN=\nC_API_KEY=\n", "The MRN system stores records.", "123-00-4567 and 666-12-3456", "card 4111 1111 1111 1112",
    )),
    (f"const k = process.env.X; api_key = '{_KEY}'", "CREDENTIAL"), (f"SERVICE_API_KEY={_KEY}", "CREDENTIAL"), (f"api_key =\n{_KEY}", "CREDENTIAL"), (f"api_key = {_KEY}==", "CREDENTIAL"),
    ("api_key = 0123456789ABCDEF0123456789ABCDEF", "CREDENTIAL"), ("MRN: AB123456", "MRN"), ("The MRN system. MRN: AB123456", "MRN"),
    ("card 4111 1111 1111 1111 of 123-45-6789", "PAN,SSN"), ("CUI//SP-PRVCY", "CUI"), ("é123-45-6789", "SSN"), ("123 - 45 - 6789", "SSN"), ("", ""),
]


@query("single_cases", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{types}', '{'VIOLATION' if types else 'CLEAN'}')" for i, (_, types) in enumerate(CASES)) + ") t(id, types, verdict)")
def single_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "id long, text string")
    return typed(rows).select("id", F.array_join("types", ",").alias("types"), F.col("result.verdict").alias("verdict"))


@query("conformance_outcome", f"SELECT {len(CASES)}::BIGINT AS cases, {len(CASES)}::BIGINT AS passed, '' AS failures, '{pack.VERSION}' AS pack_version")
def conformance_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [(i, "VIOLATION" if types else "CLEAN", types.split(",") if types else [], None) for i, (_, types) in enumerate(CASES)]
    cases = spark.createDataFrame(wanted, "id long, verdict string, types array<string>, violations string")
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "id long, text string")
    got = typed(rows).select("id", F.col("result.verdict").alias("verdict"), "types", F.lit(None).cast("string").alias("violations"))
    record = metrics.conformance_record(metrics.conformance(got, cases), *pack.identity())
    return record.select("cases", "passed", F.array_join("failures", ",").alias("failures"), "pack_version")


_EVENT_TEXT = "concat('n ', case when event_id % 3 = 0 then concat(" + padded("1 + event_id % 600", 3) + ", '-45-6789') when event_id % 3 = 1 then concat('MRN: A', " + padded("event_id", 9) + ") else 'none' end)"


@query("windowed_findings", "SELECT date_trunc('hour', ts) AS hour, CASE event_id % 3 WHEN 0 THEN 'SSN' ELSE 'MRN' END AS type, count(*) AS n FROM events WHERE event_id % 3 < 2 GROUP BY ALL")
def windowed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator over a batch: findings by hour and type."""
    rows = spread(table(spark, sf_dir, "events")).select(F.col("ts").cast("timestamp").alias("ts"), F.expr(_EVENT_TEXT).alias("text"))
    return windowed_counts(rows, "text", "ts", "1 hour", "1 hour").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "type", "n")


_PAGE = "alerts_held long, total long, limit long, producer_state string, population_kind string, population_name string"
_STATES = [("anomalous", "hit", None), ("alerted", "hit", None), ("quiet", "miss", None), ("unheard", "miss", None), ("listed-bad", "hit", None), ("listed-short", "partial", "the page holds 0 of 3 alerts"), ("listed-clean", "miss", None), ("", "error", "empty package name")]


@query("registry_states", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}', {repr(r) if r else 'NULL'})" for n, s, r in _STATES) + ") t(package, status, reason)")
def registry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer of a lookup, with packages that are listed and have answers of their own."""
    page = lambda held, total, kind, name: (held, total, 100, "current", kind, name)
    own = [("listed-bad", *page(1, 1, "package", "listed-bad"), [("X-1", "npm")]), ("listed-short", *page(0, 3, "package", "listed-short"), []), ("listed-clean", *page(0, 0, "package", "listed-clean"), [])]
    found = registry.Registry(
        spark.createDataFrame([("Anomalous", 0.7, 5), ("quiet", 0.0, 0)], "name string, anomaly_score double, event_count long"),
        spark.createDataFrame([("A-1", "Alerted", "npm")], "id string, name string, type string"),
        spark.createDataFrame([page(1, 1, "every package", None)], _PAGE),
        registry.checked_listing(spark.createDataFrame([(n, "npm") for n in ("Listed-Bad", "listed-short", "listed-clean")], "name string, type string")),
        None,
        spark.createDataFrame(own, f"name string, {_PAGE}, alerts array<struct<id:string,type:string>>"),
    )
    docs = spark.createDataFrame([(n,) for n, *_ in _STATES], "package string")
    return registry.lookup(docs, "package", found).select("package", "lookup.status", "lookup.reason")


_GOOD = {"intent": "x", "result": "y", "confidence": 0.9, "attackClass": "prompt_injection", "latencyMs": 3, "modelVersion": "m"}
_ANSWERS = [(_GOOD, "VIOLATION"), (_GOOD | {"confidence": 0.8}, "CLEAN"), (_GOOD | {"attackClass": ""}, "CLEAN"), (_GOOD | {"confidence": 1.2}, None), (_GOOD | {"attackClass": "other"}, None), (_GOOD | {"confidence": "0.9"}, None), (_GOOD | {"evidence": 5}, None), ({"intent": "x"}, None), ("text", None)]


@query("guard_validation", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {repr(v) if v else 'NULL'})" for i, (_, v) in enumerate(_ANSWERS)) + ") t(id, verdict)")
def guard_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, json.dumps(a)) for i, (a, _) in enumerate(_ANSWERS)], "id long, raw string")
    return rows.select("id", guard.mapped(guard.parsed(F.col("raw")), F.lit("some text"))["verdict"].alias("verdict"))


@query("unevaluated_patterns", "SELECT * FROM (VALUES (1::BIGINT, 'VIOLATION', 'INCOMPLETE', 'PATTERN_NOT_EVALUATED:deep'), (2, 'VIOLATION', 'VIOLATION', 'SSN,PATTERN_NOT_EVALUATED:deep')) t(id, verdict, input_verdict, types)")
def unevaluated_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that runs out of stack is reported, and the others still run."""
    deep = pack.Pattern("deep", "MRN", 0.5, "", "none", r"((?:a|[^x])*y)")
    rows = spark.createDataFrame([(1, "plain"), (2, "is 123-45-6789")], "id long, text string")
    done = classify(rows, "text", patterns=(*pack.PATTERNS, deep))
    return done.select("id", F.col("result.verdict").alias("verdict"), input_verdict(F.col("result")).alias("input_verdict"), F.array_join("result.violations.type", ",").alias("types"))


@query("report_totals", "SELECT count(*) AS inputs, sum((key % 2 = 0)::INT)::BIGINT AS findings, 0::BIGINT AS not_evaluated, 2 AS worst FROM (SELECT c_custkey AS key FROM customer)")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "customer")).select(F.expr("case when c_custkey % 2 = 0 then concat('MRN: A', lpad(cast(c_custkey as string), 8, '0')) else 'none' end").alias("text"))
    done = classify(rows, "text").select(F.col("result.verdict").alias("verdict"), F.col("result.violations").alias("violations"))
    return report.totals(done, "verdict", "violations")


@query("percentiles", "SELECT o_orderstatus AS status, quantile_disc(cents, 0.5) AS p50, quantile_disc(cents, 0.95) AS p95, quantile_disc(cents, 0.99) AS p99 FROM (SELECT o_orderstatus, round(o_totalprice * 100)::BIGINT AS cents FROM orders) GROUP BY 1")
def order_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return metrics.percentiles(rows, "cents", ["status"])


def nested(value: Column) -> Column:
    once = F.base64(F.concat(F.lit("see "), value, F.lit(" ok")).cast("binary"))
    return F.base64(F.concat(F.lit("it is "), once).cast("binary"))


@query("nested_payload", "SELECT s_suppkey AS key, 'SSN' AS type, 'decoded-base64' AS view, 2 AS original_start FROM supplier")
def nested_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number in a payload within a payload is found, at the place of the outer one."""
    value = F.concat(F.lpad((F.col("s_suppkey") % 600 + 1).cast("string"), 3, "0"), F.lit("-45-6789"))
    rows = spread(table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").alias("key"), F.concat(F.lit("x "), nested(value), F.lit(" y")).alias("text"))
    return classify(rows, "text").select("key", F.explode("result.violations").alias("v")).select("key", "v.type", "v.view", "v.original_start")
