import base64
import json

import pytest
from lumenguard.operators import policy, registry, signature
from lumenguard.operators.integrations import ComplianceViolation, checked, guard_output
from lumenguard.operators.scan import VIOLATION
from lumenguard.operators.vault import Vault
from lumenguard.session import comply
from pyspark.sql import functions as F


def test_policy_problems():
    bad = policy.Policy("", "1", (policy.Rule("a", "n", (), "STOP"), policy.Rule("a", "n", ("SSN",), "DENY")))
    with pytest.raises(TypeError, match="name must be.*patterns.*occurs twice|name must be"):
        policy.checked(bad)
    with pytest.raises(TypeError):
        policy.load("none-such")


def test_comply_hides_denied_content(spark):
    df = spark.createDataFrame([(1, "ssn 123-45-6789"), (2, "NPI: 1234567893"), (3, "plain"), (4, "")], "id int, text string")
    got = {r["id"]: r["result"] for r in comply(df, "text", policy="default").collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["DENY", "VIOLATION", "CLEAN", "CLEAN"]
    assert got[1].original_content is None and got[2].original_content is not None
    assert [v.type for v in got[2].violations] == ["NPI", "POLICY_WARN:warn-npi"]


def page(spark, total=1, held=1, state="current", kind="every package", name=None):
    return spark.createDataFrame([(held, total, 1000, state, kind, name)], "alerts_held long, total long, limit long, producer_state string, population_kind string, population_name string")


@pytest.mark.parametrize(
    ("tables", "want"),
    [
        ({}, ("error", "registry cache not warmed")),
        ({"page": {}}, ("error", "fleet anomaly signal not loaded")),
        ({"fleet": []}, ("miss", None)),
        ({"fleet": [("P", 0.2, 3)]}, ("partial", "no page has loaded")),
        ({"fleet": [("P", 0.2, 3)], "page": {}}, ("hit", None)),
        ({"fleet": [("P", 0.2, 0)], "page": {}}, ("miss", None)),
        ({"fleet": [], "page": {"total": 5}}, ("partial", "the page holds 1 of 5 alerts")),
        ({"fleet": [], "page": {"total": None, "state": "stale"}}, ("partial", "the page states no total; the page's producer state is 'stale'")),
        ({"fleet": [], "page": {"kind": "package", "name": "q"}}, ("partial", "the page counts another population")),
        ({"fleet": [], "page": {"total": 5}, "alerts": [("A", "p", "npm")]}, ("hit", None)),
        ({"alerts": [("A", "p", "npm")], "page": {}}, ("hit", None)),
    ],
)
def test_registry_states(spark, tables, want):
    r = registry.Registry(
        fleet=spark.createDataFrame(tables["fleet"], "name string, anomaly_score double, event_count long") if "fleet" in tables else None,
        alerts=spark.createDataFrame(tables["alerts"], "id string, name string, type string") if "alerts" in tables else None,
        page=page(spark, **tables["page"]) if "page" in tables else None,
    )
    docs = spark.createDataFrame([(1, "p"), (2, None), (3, "")], "id int, package string")
    got = {x["id"]: x["lookup"] for x in registry.lookup(docs, "package", r).collect()}
    assert (got[1].status, got[1].reason) == want
    assert got[2] is None and got[3].status == "error"


def signed(**over):
    own = {"classification": "data-read", "confidence": 0.9, "modelVersion": "m", "contentHash": "a" * 64, "timestamp": 1_000_000}
    sig = {"alg": signature.ALGORITHM, "ed25519Sig": base64.b64encode(bytes(64)).decode(), "mldsaSig": base64.b64encode(bytes(2420)).decode(), "ts": 1}
    sig |= over.pop("signature", {})
    return json.dumps(own | over | {"signature": sig})


def test_signature_stages(spark):
    cases = {
        "ok": (signed(), None), "hash": (signed(contentHash="x"), "SCHEMA_ERROR"), "alg": (signed(signature={"alg": "none"}), "ALGORITHM_UNSUPPORTED"),
        "size": (signed(signature={"mldsaSig": "AAAA"}), "KEY_FORMAT_ERROR"), "old": (signed(timestamp=699_999), "STALE"), "limit": (signed(timestamp=700_000), None),
        "new": (signed(timestamp=1_030_001), "FUTURE_DATED"), "deny": (signed(classification="credential-access"), "ABSOLUTE_DENY"),
        "other": (signed(classification="dance"), "UNKNOWN_CLASSIFICATION"), "tier": (signed(classification="file-delete"), "TIER_REJECTED"), "null": (None, "SCHEMA_ERROR"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "id string, raw string")
    got = {r["id"]: r["verified"].error for r in signature.verified(df, "raw", F.lit(1_000_000), signature.Options("read", verify=lambda raw, ed, ml: True)).collect()}
    assert got == {k: v[1] for k, v in cases.items()}
    unverified = signature.verified(df.where("id = 'ok'"), "raw", F.lit(1_000_000), signature.Options("read")).first()["verified"]
    assert (unverified.valid, unverified.error) == (False, "SIGNATURE_INVALID")


def test_vault(spark):
    now = [0]
    v = Vault(spark, ttl_ms=10, most=2, now=lambda: now[0])
    v.store("a", "one")
    v.store("b", "two")
    assert v.retrieve("a") == "one"
    v.store("c", "three")
    assert (v.retrieve("a"), v.size()) == (None, 2)
    now[0] = 11
    assert v.size() == 0
    v.destroy()
    with pytest.raises(RuntimeError):
        v.store("d", "x")


def test_guard_modes(spark):
    df = spark.createDataFrame([("ssn 123-45-6789",), ("plain",), (None,)], "text string")
    assert [r["text"] for r in guard_output(df, "text", "redact").collect()] == ["ssn [REDACTED]", "plain", None]
    assert guard_output(df, "text", "allow").count() == 3
    with pytest.raises(ComplianceViolation, match="SSN"):
        checked(df, "text")
    with pytest.raises(Exception, match="VIOLATION: SSN"):
        guard_output(df, "text").collect()


def test_added_findings_fit_the_type(spark):
    row = spark.range(1).select(F.array(policy.added(F.lit("T"), F.lit("v"))).cast(f"array<{VIOLATION}>").alias("x")).first()
    assert row["x"][0].confidence == 1.0
