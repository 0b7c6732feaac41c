"""Signed guard answers: checked stage by stage, ending in a tier decision.

The cryptographic half is a callable, ``verify(canonical_bytes, ed25519_signature, mldsa_signature) -> bool``. The standard library has
neither algorithm, so without one every signature is invalid: nothing is ever accepted unverified.
"""


import base64
import binascii
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import none_of
from .scan import VIOLATION

#: Sizes in bytes, ages in milliseconds, tiers, and what each classification needs.
ALGORITHM, ED25519_SIGNATURE, MLDSA_SIGNATURE = "Ed25519+ML-DSA-44", 64, 2420
MAX_AGE, FUTURE_SKEW = 300_000, 30_000
TIERS = {"minimal": 0, "read": 1, "execute": 2, "mutate": 3, "privileged": 4}
MIN_TIER = {
    "documentation": "minimal",
    "code-analysis": "read",
    "data-read": "read",
    "code-generation": "execute",
    "network-egress": "execute",
    "process-spawn": "execute",
    "data-write": "mutate",
    "file-write": "mutate",
    "file-delete": "privileged",
    "system-mutation": "privileged",
    "privileged-operation": "privileged",
}
ABSOLUTE_DENY = ("credential-access", "credential-exfiltration")
CLEAN_CLASSES = ("documentation", "code-analysis", "data-read")
Verifier = Callable[[bytes, bytes, bytes], bool]


@dataclass(frozen=True)
class Options:
    tier: str
    algorithm: str = ALGORITHM
    max_age: int = MAX_AGE
    future_skew: int = FUTURE_SKEW
    verify: Verifier | None = None


def canonical(answer: dict) -> bytes:
    """JSON with sorted keys at every depth and whole numbers without a fraction, less the signature."""

    def plain(x: object) -> object:
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1e21 else x

    return json.dumps(plain({k: v for k, v in answer.items() if k != "signature"}), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def schema_problem(x: object) -> str | None:
    if not isinstance(x, dict):
        return "the answer is not an object"
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v)
    for k in ("classification", "modelVersion", "contentHash"):
        if not isinstance(x.get(k), str) or not x[k]:
            return f"{k} must be a non-empty string"
    if len(x["contentHash"]) != 64 or any(c not in "0123456789abcdef" for c in x["contentHash"]):
        return "contentHash must be 64 hex characters"
    if not number(x.get("confidence")) or not 0 <= x["confidence"] <= 1:
        return "confidence must be from 0 to 1"
    if not number(x.get("timestamp")):
        return "timestamp must be a number"
    s = x.get("signature")
    if not isinstance(s, dict) or not all(isinstance(s.get(k), str) for k in ("alg", "ed25519Sig", "mldsaSig")):
        return "signature must have alg, ed25519Sig and mldsaSig"
    return None


def crypto_stage(raw: str | None, o: Options) -> str | None:
    """An error code, or None if all stages up to the signature pass."""
    try:
        x = json.loads(raw or "")
    except ValueError:
        return "SCHEMA_ERROR"
    if schema_problem(x):
        return "SCHEMA_ERROR"
    if x["signature"]["alg"] != ALGORITHM or o.algorithm != ALGORITHM:
        return "ALGORITHM_UNSUPPORTED"
    try:
        ed, ml = (base64.b64decode(x["signature"][k], validate=True) for k in ("ed25519Sig", "mldsaSig"))
    except binascii.Error:
        return "KEY_FORMAT_ERROR"
    if len(ed) != ED25519_SIGNATURE or len(ml) != MLDSA_SIGNATURE:
        return "KEY_FORMAT_ERROR"
    try:
        ok = o.verify is not None and o.verify(canonical(x), ed, ml)
    except Exception:  # noqa: BLE001  a verifier that breaks has not accepted
        ok = False
    return None if ok else "SIGNATURE_INVALID"


def freshness(timestamp: Column, now: Column, max_age: int = MAX_AGE, skew: int = FUTURE_SKEW) -> Column:
    """STALE, FUTURE_DATED or null; both limits themselves are still good."""
    age = now - timestamp
    return F.when(age > max_age, "STALE").when(-age > skew, "FUTURE_DATED")


def required_level(classification: Column) -> Column:
    levels = F.create_map(*[F.lit(x) for k, t in MIN_TIER.items() for x in (k, TIERS[t])])
    return F.try_element_at(levels, classification)


def tier_error(classification: Column, tier: Column) -> Column:
    have = F.try_element_at(F.create_map(*[F.lit(x) for k, v in TIERS.items() for x in (k, v)]), tier)
    need = required_level(classification)
    return F.when(classification.isin(*ABSOLUTE_DENY), "ABSOLUTE_DENY").when(need.isNull(), "UNKNOWN_CLASSIFICATION").when(F.coalesce(have < need, F.lit(True)), "TIER_REJECTED")


def verified(df: DataFrame, raw: str, now: Column, o: Options, out: str = "verified") -> DataFrame:
    """``df`` with (valid, error, classification, confidence) of the JSON column ``raw``."""
    if o.tier not in TIERS:
        raise TypeError(f"tier must be one of {', '.join(TIERS)}")

    @F.pandas_udf("string")
    def crypto(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: crypto_stage(x, o) or "")

    x = F.from_json(F.col(raw), "classification string, confidence double, timestamp double")
    first = F.nullif(F.col("_crypto"), F.lit(""))
    error = F.coalesce(first, freshness(x["timestamp"], now, o.max_age, o.future_skew), tier_error(x["classification"], F.lit(o.tier)))
    done = df.withColumn("_crypto", crypto(F.col(raw)))
    return done.withColumn(out, F.struct(error.isNull().alias("valid"), error.alias("error"), F.when(error.isNull(), x["classification"]).alias("classification"), F.when(error.isNull(), x["confidence"]).alias("confidence"))).drop("_crypto")


def as_guard(v: Column, text: Column) -> Column:
    """(verdict, violations) of a verified answer: an invalid one denies."""
    n = F.length(text)
    one = F.struct(v["classification"].alias("type"), F.lit("***GUARD***").alias("value"), F.lit(0).alias("start"), n.alias("end"), v["confidence"].alias("confidence"), F.lit("guard").alias("classifier"), F.lit(None).cast("string").alias("view"), F.lit(0).alias("original_start"), n.alias("original_end"))
    harmless = v["classification"].isin(*CLEAN_CLASSES)
    verdict = F.when(~v["valid"], "DENY").when(harmless, "CLEAN").otherwise("VIOLATION")
    return F.struct(verdict.alias("verdict"), F.when(v["valid"] & ~harmless, F.array(one)).otherwise(none_of(VIOLATION)).alias("violations"))
