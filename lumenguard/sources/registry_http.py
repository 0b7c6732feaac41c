"""The registry's tables from its HTTP service: a few requests on the driver, whose bodies Spark parses. A request that fails leaves its table out."""

from __future__ import annotations

import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry as R

#: Routes and fields of the service's answers.
FLEET, ALERTS = "/api/v1/registry/fleet/anomaly-signal", "/api/v1/intelligence/alerts"
SIGNAL = "struct<name:string,anomalyScore:double,eventCount:double>"
ALERT_ROW = "struct<id:string,name:string,type:string>"
ANSWER = f"struct<alerts:array<{ALERT_ROW}>,total:variant,limit:variant,population:variant,producer:variant>"

Get = Callable[[str], str | None]


def http_get(timeout_ms: int = 8_000) -> Get:
    """The body of an address, or None for any failure."""

    def get(url: str) -> str | None:
        try:
            with urllib.request.urlopen(url, timeout=timeout_ms / 1000) as r:
                return r.read().decode("utf-8") if r.status == 200 else None
        except (OSError, ValueError):
            return None

    return get


def bodies(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "name string, type string, body string")


def fleet_rows(raw: DataFrame) -> DataFrame:
    """(name, anomaly_score, event_count) of bodies that are a list of signals or have one as ``agents``."""
    plain = F.ltrim("body").startswith("[")  # an object would be read as a list of one
    listed = F.when(plain, F.from_json("body", f"array<{SIGNAL}>")).otherwise(F.from_json("body", f"struct<agents:array<{SIGNAL}>>")["agents"])
    return raw.select(F.explode(listed).alias("s")).select("s.name", F.col("s.anomalyScore").alias("anomaly_score"), F.col("s.eventCount").cast("long").alias("event_count"))


def own_fleet_rows(raw: DataFrame) -> DataFrame:
    """The same of bodies with one signal, of the package that was asked for."""
    rows = raw.select("name", F.from_json("body", SIGNAL).alias("s")).where(F.lower("s.name") == F.lower("name"))
    return rows.select("s.name", F.col("s.anomalyScore").alias("anomaly_score"), F.col("s.eventCount").cast("long").alias("event_count"))


def pages(raw: DataFrame) -> DataFrame:
    """(name, type, alerts, and what the page states about itself) of alert bodies."""
    a = F.from_json("body", ANSWER)
    rows = raw.withColumn("a", a).where(F.col("a").isNotNull())
    count = lambda f: F.when(F.schema_of_variant(F.col(f"a.{f}")).isin("BIGINT", "INT"), F.try_variant_get(F.col(f"a.{f}"), "$", "long")).alias(f)
    text = lambda f, path: F.when(F.schema_of_variant(F.try_variant_get(F.col(f"a.{f}"), path, "variant")) == "STRING", F.try_variant_get(F.col(f"a.{f}"), path, "string"))
    stated = F.when(F.schema_of_variant("a.population").startswith("OBJECT"), F.struct(text("population", "$.name").alias("name"), text("population", "$.packageType").alias("package_type")))
    said = R.population(stated)
    alerts = F.coalesce("a.alerts", F.array().cast(f"array<{ALERT_ROW}>"))
    return rows.select("name", "type", alerts.alias("alerts"), F.size(alerts).cast("long").alias("alerts_held"), count("total"), count("limit"), text("producer", "$.state").alias("producer_state"), said["kind"].alias("population_kind"), said["name"].alias("population_name"))


def load(spark: SparkSession, base_url: str, packages: Iterable[tuple[str, str]] = (), get: Get | None = None) -> R.Registry:
    """A registry's tables; ``packages`` (name, type) are asked for one by one as well, under their names as given and in lower case."""
    get = get or http_get()
    base, listed = base_url.rstrip("/"), list(packages)
    query = lambda **x: urllib.parse.urlencode(x)
    found = R.Registry()
    if listed:
        found.listed = R.checked_listing(spark.createDataFrame(listed, "name string, type string"))
    if (body := get(f"{base}{FLEET}")) is not None:
        found.fleet = fleet_rows(bodies(spark, [("", "", body)]))
    if (body := get(f"{base}{ALERTS}?{query(type='supply_chain')}")) is not None:
        page = pages(bodies(spark, [("", "", body)]))
        found.page = page.drop("name", "type", "alerts")
        found.alerts = page.select(F.explode("alerts").alias("x")).select("x.*")
    own = [(n, t, b) for n, t in listed if (b := get(f"{base}{FLEET}?{query(name=n, type=t)}")) is not None]
    if own:
        found.own_fleet = own_fleet_rows(bodies(spark, own))
    asked = [(n, t, x) for n, t in listed for x in dict.fromkeys((n, n.lower()))]
    own = [(n, t, b) for n, t, x in asked if (b := get(f"{base}{ALERTS}?{query(type='supply_chain', name=x, packageType=t)}")) is not None]
    if own:
        answers = pages(bodies(spark, own)).where(F.coalesce(F.col("population_name") != "", F.lit(False)))  # others answer another question
        found.own_pages = answers.withColumn("alerts", F.transform("alerts", lambda x: F.struct(x.id.alias("id"), x.type.alias("type")))).drop("type")
    return found


def oldest_answer(answers: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: when the oldest answer for a listed package came, 0 while one is missing. ``answers`` has (name, fetched_at) in milliseconds."""
    last = answers.groupBy(F.lower("name").alias("key")).agg(F.max("fetched_at").alias("at"))
    both = listed.select(F.lower("name").alias("key")).distinct().join(last, "key", "left")
    return both.agg(F.coalesce(F.min(F.coalesce("at", F.lit(0))), F.lit(0)).cast("long").alias("oldest"))
