"""Very long and dense texts, patterns that cannot run, messages, and connectors."""

import json
import os
import random
import re
import socket
import threading
import time
import unicodedata

import lumenguard
import pytest
from lumenguard import sources
from lumenguard.cli import unread_stdin
from lumenguard.functions import masks, pack
from lumenguard.functions import normalize as N
from lumenguard.functions.shown import files_glob, not_evaluated_lines, show_string
from lumenguard.operators import classify as C
from lumenguard.operators import isolation, metrics, registry, risk, scan
from lumenguard.operators.guard import socket_client
from lumenguard.session import Session
from lumenguard.sources import registry_http
from pyspark.sql import functions as F

MILLION = 1_000_000


def test_long_texts(spark):
    """Runs of one kind of character, tracking URLs and tokens of a million characters."""
    rows = [("%41%42" + "a" * MILLION, "CLEAN"), ("http://x.org/?u=%41%42" + "%43" * 100_000, "CLEAN"), ("Bearer " + "a" * MILLION, "VIOLATION"), ("%4" * 200_000, "CLEAN"), ("0 " * 50_000, "CLEAN"), *((c * MILLION, "CLEAN") for c in ("a", "-", "A", " ", "é", "=", "0"))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id int, text string").repartition(4)
    got = {r["id"]: r["verdict"] for r in C.classify(df, "text").select("id", "result.verdict").collect()}
    assert got == {i: v for i, (_, v) in enumerate(rows)}


def test_work_grows_in_line_with_findings(spark):
    took = {}
    for n in (2_000, 20_000):  # the first also warms up
        text = "\n".join(f"id {1 + i % 600:03d}-45-{1 + i % 9000:04d};" for i in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        began = time.perf_counter()
        row = C.classify(df, "text").select(F.size("result.violations").alias("n"), F.length(masks.redact(F.col("text"), F.col("result.violations"))).alias("left")).first()
        took[n] = time.perf_counter() - began
        assert row["n"] == n and row["left"] == n * len("id [REDACTED];") + n - 1
    assert took[20_000] < 5 * took[2_000] + 10, took


def test_scan_in_blocks_equals_a_loop(spark):
    from lumenguard.functions.spans import scan as blocks

    for n in (0, 1, 63, 64, 65, 1000):
        df = spark.range(1).select(F.sequence(F.lit(0), F.lit(n)).alias("x")).select(F.slice("x", 1, n).alias("x"))
        out = df.select(blocks(F.col("x"), F.lit(0).cast("int"), lambda s, v: (s + v, F.array(s + v)), "int").alias("r")).first()["r"]
        sums = [sum(range(i + 1)) for i in range(n)]
        assert (out["state"], out["out"]) == (sums[-1] if n else 0, sums)


def test_redaction_of_many_ranges(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdé日 ") for _ in range(5000))
    cuts = sorted(rng.sample(range(5000), 1400))
    ranges = list(zip(cuts[::2], cuts[1::2], strict=True))
    df = spark.createDataFrame([(text, [(a, b) for a, b in rng.sample(ranges, len(ranges))]), (text, [])], "t string, r array<struct<start:int,end:int>>")
    got = [r["x"] for r in df.select(masks.redact_ranges(F.col("t"), F.col("r"), "#").alias("x")).collect()]
    want, at = "", 0
    for a, b in ranges:
        want, at = want + text[at:a] + "#", b
    assert got == [want + text[at:], text]


def test_later_views_add_only_new_findings(spark):
    text = " x ".join(f"{1 + i % 600:03d}-45-{1000 + i}" for i in range(700)) + " x 123 - 45 - 6789 x"
    found = C.classify(spark.createDataFrame([(text,)], "text string"), "text").selectExpr("inline(result.violations)").collect()
    assert len([v for v in found if v["view"] == "normalized"]) == 700 and [v["view"] for v in found if v["view"] != "normalized"] == ["compact"]


def test_own_forms_are_their_own():
    own = re.compile(f"[{N.OWN_FORMS}]")
    assert not [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and own.match(c) and unicodedata.normalize("NFKC", c) != c]


def test_classify_is_built_quickly(spark):
    df = spark.createDataFrame([("x",)], "text string")
    C.classify(df, "text")
    began = time.perf_counter()
    C.classify(df, "text")
    assert time.perf_counter() - began < 8  # about one second on an idle machine


def test_patterns_that_cannot_run(spark):
    assert all(isolation.runs(spark, pack.java(p)) for p in pack.PATTERNS)
    deep = pack.Pattern("deep", "MRN", 0.5, "", "none", r"((?:a|[^x])*y)")
    late = pack.Pattern("late", "MRN", 0.5, "", "none", r"\b(zz\d)\b")
    assert isolation.unevaluated((deep, late)) == ("deep",)
    with pytest.raises(pack.PackError, match="pattern deep cannot"):
        isolation.whole((late, deep))
    df = spark.createDataFrame([(1, "zz1"), (2, ""), (3, None)], "id int, text string")
    got = {r["id"]: r["result"] for r in C.classify(df, "text", patterns=(deep, late)).collect()}
    assert [(v.type, v.value, v.start, v.end, v.view) for v in got[1].violations] == [("MRN", "***", 0, 3, "normalized"), ("PATTERN_NOT_EVALUATED:deep", "deep", 0, 0, None)]
    assert got[1].unevaluated_patterns == ["deep"] and got[2].violations == [] and got[3] is None


def test_messages():
    assert show_string("a\nb ", "'") == "'a\\nb\\u2028'" and show_string("x" * 70) == "x" * 64 + "... (length 70)" and show_string("it's", "'") == "'it\\'s'"
    assert files_glob("a b/") == "'a b'/*.txt" and files_glob("-x") == "./-x/*.txt" and files_glob("/") == "/*.txt" and files_glob("it's") == "'it'\"'\"'s'/*.txt"
    ids = [f"pattern-number-{i}" for i in range(12)]
    lines = not_evaluated_lines(ids)
    assert all(len(x) <= 80 for x in lines) and " ".join(x.strip() for x in lines).removeprefix("not evaluated: ").split(", ") == ids and not_evaluated_lines([]) == []


def test_inputs_that_cannot_be_read(spark, tmp_path):
    with pytest.raises(sources.UsageError, match="is a directory"):
        sources.refuse_unreadable(str(tmp_path))
    held = os.dup(0)
    try:
        (tmp_path / "in").write_text("x")
        fd = os.open(tmp_path / "in", os.O_RDONLY)
        os.dup2(fd, 0)
        assert unread_stdin() == "content"
        r, w = os.pipe()
        os.dup2(r, 0)
        assert unread_stdin() == "stream"
        os.close(w)
    finally:
        os.dup2(held, 0)


def test_registry_connector(spark):
    page = {"alerts": [{"id": "A", "name": "Bad", "type": "npm"}], "total": 1, "limit": 100, "population": {"name": None, "packageType": None}, "producer": {"state": "current"}}
    own = {"alerts": [], "total": 0, "limit": 100, "population": {"name": "Mine", "packageType": "npm"}, "producer": {"state": "current"}}
    answers = {
        "http://r/api/v1/registry/fleet/anomaly-signal": {"agents": [{"name": "Odd", "anomalyScore": 0.6, "eventCount": 3}]},
        "http://r/api/v1/intelligence/alerts?type=supply_chain": page,
        "http://r/api/v1/registry/fleet/anomaly-signal?name=Mine&type=npm": {"name": "mine", "anomalyScore": 0.1, "eventCount": 2},
        "http://r/api/v1/intelligence/alerts?type=supply_chain&name=Mine&packageType=npm": own,
    }
    get = lambda url: json.dumps(answers[url]) if url in answers else None
    docs = spark.createDataFrame([(n,) for n in ("odd", "bad", "mine", "other")], "p string")
    got = {r["p"]: (r["lookup"].status, r["lookup"].score) for r in registry.lookup(docs, "p", registry_http.load(spark, "http://r/", [("Mine", "npm")], get)).collect()}
    assert got == {"odd": ("hit", 0.6), "bad": ("hit", None), "mine": ("hit", 0.1), "other": ("miss", None)}
    none = registry_http.load(spark, "http://r", [], lambda url: None)
    assert {r["lookup"].status for r in registry.lookup(docs, "p", none).collect()} == {"error"}
    short = registry_http.load(spark, "http://r", [], lambda url: json.dumps(page | {"total": "1"}) if "alerts" in url else None)
    assert {r["lookup"].reason for r in registry.lookup(docs.where("p = 'other'"), "p", short).collect()} == {"the page states no total"}
    with pytest.raises(TypeError):
        registry_http.load(spark, "http://r", [("a", "npm"), ("A", "npm")], lambda url: None)
    times = spark.createDataFrame([("A", 5), ("a", 9), ("b", 7)], "name string, fetched_at long")
    listed = spark.createDataFrame([("a",), ("B",)], "name string")
    assert registry_http.oldest_answer(times, listed).first()["oldest"] == 7
    assert registry_http.oldest_answer(times.where("name <> 'b'"), listed).first()["oldest"] == 0


def test_one_load_for_many_threads():
    loads = []

    def load():
        time.sleep(0.2)
        loads.append(1)
        return registry.Registry()

    session = Session(load, lambda: 0)
    threads = [threading.Thread(target=session.registry) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(loads) == 1


def test_socket_guard(tmp_path):
    path = str(tmp_path / "s")
    server = socket.socket(socket.AF_UNIX)
    server.bind(path)
    server.listen()

    def serve():
        conn, _ = server.accept()
        asked = json.loads(conn.makefile("rb").readline())
        conn.sendall(json.dumps({"got": asked["input"]}).encode() + b"\n")
        conn.close()

    thread = threading.Thread(target=serve)
    thread.start()
    assert json.loads(socket_client(path)("téxt")) == {"got": "téxt"}
    thread.join()
    server.close()
    assert socket_client(path, 200)("x") is None


def test_records_and_small_things(spark):
    outcomes = spark.createDataFrame([(i, i % 3 == 0) for i in range(90)], "id int, passed boolean")
    r = metrics.conformance_record(outcomes, "1", "x").first()
    assert (r.cases, r.passed, len(r.failures), r.failures[0]) == (90, 30, 20, 1)
    p = metrics.percentiles(spark.range(1, 101).withColumnRenamed("id", "v"), "v").first()
    assert (p.p50, p.p95, p.p99) == (50, 95, 99)
    assert [x.risk_score if x else None for (x,) in spark.createDataFrame([("a",), (None,)], "a string").select(risk.behavioural(F.col("a"))).collect()] == [50, None]
    assert set(lumenguard.__all__) <= set(dir(lumenguard))
    assert sources.spread(spark.range(10).coalesce(1)).count() == 10
    assert scan.scan_sql("text") is scan.scan_sql("text")
