"""Answers of a semantic guard: checked, mapped to findings, and asked for only where a client is given."""

import json
import socket
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import GUARD_MASK
from ..functions.spans import none_of
from .scan import VIOLATION

#: Classes of attack that an answer may name, and the confidence that it must exceed.
ATTACKS = ("exfiltration_pattern", "prompt_injection", "tool_misuse", "data_extraction")
THRESHOLD = 0.8
RESPONSE = "intent string, result string, confidence double, attackClass string, evidence string, remediation string, latencyMs double, modelVersion string"


def parsed(raw: Column) -> Column:
    """A JSON answer as a struct, or null unless all fields are there with the right types and ranges."""
    field = lambda n, kind: F.try_variant_get(F.try_parse_json(raw), f"$.{n}", kind)
    kind = lambda n: F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), f"$.{n}", "variant"))
    text = lambda n: kind(n) == "STRING"
    number = lambda n: kind(n).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    optional = lambda n: kind(n).isNull() | kind(n).isin("STRING", "VOID")
    attack, confidence = field("attackClass", "string"), field("confidence", "double")
    good = text("intent") & text("result") & text("attackClass") & text("modelVersion") & number("confidence") & number("latencyMs") & optional("evidence") & optional("remediation")
    valid = F.coalesce(good & confidence.between(0, 1) & (attack == "") | (good & confidence.between(0, 1) & attack.isin(*ATTACKS)), F.lit(False))
    names = [x.split() for x in RESPONSE.split(", ")]
    return F.when(valid, F.struct(*[field(n, t).alias(n) for n, t in names]))


def mapped(answer: Column, text: Column) -> Column:
    """(verdict, violations) of an answer; null without one. What the answer says as evidence is never copied."""
    hit = (answer["attackClass"] != "") & (answer["confidence"] > THRESHOLD)
    n = F.length(text)
    one = F.struct(answer["attackClass"].alias("type"), F.lit(GUARD_MASK).alias("value"), F.lit(0).alias("start"), n.alias("end"), answer["confidence"].alias("confidence"), F.lit("guard").alias("classifier"), F.lit(None).cast("string").alias("view"), F.lit(0).alias("original_start"), n.alias("original_end"))
    return F.when(answer.isNotNull(), F.struct(F.when(hit, "VIOLATION").otherwise("CLEAN").alias("verdict"), F.when(hit, F.array(one)).otherwise(none_of(VIOLATION)).alias("violations")))


def http_client(url: str, timeout_ms: int = 5_000) -> Callable[[str], str | None]:
    """Posts a text to ``/v1/infer``; null for any failure."""

    def ask(text: str) -> str | None:
        body = json.dumps({"input": text}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{url}/v1/infer", body, {"Content-Type": "application/json"}), timeout=timeout_ms / 1000) as r:
                return r.read().decode() if r.status == 200 else None
        except (OSError, ValueError):
            return None

    return ask


def socket_client(path: str, timeout_ms: int = 5_000) -> Callable[[str], str | None]:
    """Sends a text as a line of JSON to a Unix socket and reads a line back; null for any failure. A socket lives on one machine: for local mode, or a guard on every node."""

    def ask(text: str) -> str | None:
        try:
            with socket.socket(socket.AF_UNIX) as s:
                s.settimeout(timeout_ms / 1000)
                s.connect(path)
                s.sendall(json.dumps({"input": text}).encode() + b"\n")
                line = s.makefile("rb").readline()
                return line.decode() if line.endswith(b"\n") else None
        except (OSError, ValueError):
            return None

    return ask


def healthy(url: str, timeout_ms: int = 200) -> bool:
    try:
        with urllib.request.urlopen(f"{url}/health", timeout=timeout_ms / 1000) as r:
            return r.status == 200
    except (OSError, ValueError):
        return False


def asked(df: DataFrame, text: str, client: Callable[[str], str | None], out: str = "guard_raw") -> DataFrame:
    """``df`` with the client's raw answers, one request for each non-empty text."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: client(t) if t else None)

    return df.withColumn(out, ask(F.col(text)))
