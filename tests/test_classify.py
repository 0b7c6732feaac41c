import base64
import random

import pytest
from lumenguard.functions import masks, pack
from lumenguard.operators import scan
from lumenguard.operators.classify import classify
from pyspark.sql import functions as F

KEY = "sk-" + "ant-api03-" + "B" * 40
ENCODED = base64.b64encode(b"my ssn is 123-45-6789 ok").decode()
CASES = [
    ("const k = process.env.SOME_KEY_NAME;", []),
    ("api_key = os.environ['SOME_KEY_NAME']", []),
    ("api_key = os.getenv('SOME_KEY_NAME')", []),
    ('"api_key": "${env:SOME_KEY_NAME}"', []),
    ("SERVICE_API_KEY=\nOTHER=your-key-here\n", []),
    (f"const k = process.env.X || '{KEY}'", [("CREDENTIAL", "...BBBB", "normalized", 28, 28 + len(KEY))]),
    ("api_key = Ab3dEf6hIj9kLm2nOp5q", [("CREDENTIAL", "...Op5q", "normalized", 0, 30)]),
    ("The MRN system stores records.", []),
    ("Patient MRN: AB123456 in.", [("MRN", "********", "normalized", 8, 21)]),
    ("１２３-４５-６７８９ wide", [("SSN", "...89", "normalized", 0, 11)]),
    ("a 123​-45-67​89", [("SSN", "...89", "normalized", 2, 15)]),
    ("123 - 45 - 6789", [("SSN", "...89", "compact", 0, 15)]),
    (f"token {ENCODED}", [("SSN", "...89", "decoded-base64", 6, 6 + len(ENCODED))]),
    ("中123-45-6789", [("SSN", "...89", "normalized", 1, 12)]),
    ("card 4111 1111 1111 1112", []),
    ("000-12-3456 666-12-3456 900-12-3456 123-00-1234", []),
    ("", []),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(99, None)]
    return {r["id"]: r["result"] for r in classify(spark.createDataFrame(rows, "id int, text string"), "text").collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: repr(CASES[i][0][:25]))
def test_findings(results, i):
    r = results[i]
    assert [(v.type, v.value, v.view, v.original_start, v.original_end) for v in r.violations] == CASES[i][1]
    assert r.verdict == ("VIOLATION" if CASES[i][1] else "CLEAN")
    assert r.layers == (["normalize", "regex"] if CASES[i][0] else [])


def test_null_text_has_null_result(results):
    assert results[99] is None


def test_other_types_are_refused(spark):
    with pytest.raises(TypeError):
        classify(spark.range(1), "id")


def greedy(matches):
    kept = []
    for m in matches:
        if not any(k["value"] == m["value"] and m["start"] < k["end"] and m["end"] > k["start"] for k in kept):
            kept.append(m)
    return kept


def test_overlaps_go_as_by_comparing_all_pairs(spark):
    rng, lists = random.Random(7), []
    for i in range(300):
        own = []
        for _ in range(rng.randrange(25)):
            s = rng.randrange(40)
            own.append({"type": "X", "idx": rng.randrange(3), "value": rng.choice("abc"), "start": s, "end": s + rng.randrange(1, 9), "confidence": rng.choice([0.5, 0.9])})
        own.sort(key=lambda m: (-m["confidence"], m["idx"], m["start"]))
        lists.append((i, own))
    df = spark.createDataFrame(lists, f"id int, m array<{scan.MATCH}>")
    got = {r["id"]: [x.asDict() for x in r["k"]] for r in df.select("id", scan.drop_overlaps(F.col("m")).alias("k")).collect()}
    assert all(got[i] == greedy(m) for i, m in lists)
    rows = df.select("id", F.posexplode("m").alias("pos", "x")).select("id", "pos", "x.*").dropDuplicates(["id", "value", "start", "end", "confidence", "idx"])
    kept = scan.drop_overlaps_rows(rows, ["id"]).count()
    unique = [[m for j, m in enumerate(own) if m not in own[:j]] for _, own in lists]
    assert kept == sum(len(greedy(m)) for m in unique)


def test_redaction_merges_touching_ranges(spark):
    v = f"array<{scan.VIOLATION}>"
    finding = lambda s, e: ("X", "*", s, e, 1.0, "regex", "normalized", s, e)
    rows = [("abcdefghij", [finding(1, 3), finding(3, 5), finding(7, 8)]), ("abc", [finding(0, 9)]), ("", [])]
    got = spark.createDataFrame(rows, f"text string, f {v}").select(masks.redact(F.col("text"), F.col("f")).alias("r")).collect()
    assert [r["r"] for r in got] == ["a[REDACTED]fg[REDACTED]ij", "abc", ""]
    pieces = spark.createDataFrame([(["abc", "def", "gh"], [finding(2, 5)])], f"p array<string>, f {v}")
    assert pieces.select(masks.redact_pieces(F.col("p"), F.col("f")).alias("r")).first()["r"] == ["ab[REDACTED]", "f", "gh"]


@pytest.mark.parametrize(
    "bad",
    [
        {"id": "Bad Id"}, {"cls": "OTHER"}, {"flags": "g"}, {"confidence": 1.5}, {"validator": "none-such"},
        {"source": "(a{1,2000})"}, {"source": "(a{2,})"}, {"source": "a(?<=b)(c)"}, {"source": "(a)(b)"}, {"source": "("},
    ],
)
def test_bad_packs_are_refused(bad):
    good = {"id": "own", "cls": "SSN", "confidence": 0.5, "flags": "", "validator": "none", "source": "(a)"}
    assert pack.problems([pack.Pattern(**good)]) == []
    with pytest.raises(pack.PackError):
        pack.checked([pack.Pattern(**(good | bad))])


def test_pack_round_trips():
    assert pack.from_json(pack.as_json()) == pack.PATTERNS
