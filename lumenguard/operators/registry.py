"""Reputation of source packages: fleet anomalies, supply-chain alerts, and what follows for a verdict.

Dimensions are tables: ``fleet`` (name, anomaly_score, event_count), ``alerts`` (id, name, type), ``page`` (one row: alerts_held,
total, limit, producer_state, population_kind, population_name), and for listed packages ``listed`` (name, type) with their own answers
``own_fleet`` (as fleet) and ``own_pages`` (name, page columns, alerts). Names compare without case. Joins are plain; Spark broadcasts a
dimension when its size, as measured, is under its threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import none_of
from .policy import added
from .risk import sensitivity
from .scan import VIOLATION

THRESHOLD, DELTA = 0.30, -0.15
ALERT = "struct<id:string,type:string>"
PAGE = "struct<alerts_held:bigint,total:bigint,limit:bigint,producer_state:string,population_kind:string,population_name:string>"


@dataclass
class Registry:
    """Tables of the registry; None for what has not loaded."""

    fleet: DataFrame | None = None
    alerts: DataFrame | None = None
    page: DataFrame | None = None
    listed: DataFrame | None = None
    own_fleet: DataFrame | None = None
    own_pages: DataFrame | None = None


def gap(page: Column, name: Column) -> Column:
    """Why a page of alerts can't be taken for complete; null if it can."""
    total = F.when(page["total"].isNull(), "the page states no total").when(page["total"] > page["alerts_held"], F.concat(F.lit("the page holds "), page["alerts_held"].cast("string"), F.lit(" of "), page["total"].cast("string"), F.lit(" alerts")))
    state = F.when(page["producer_state"].isNull(), "the page states no producer state").when(page["producer_state"] != "current", F.concat(F.lit("the page's producer state is '"), page["producer_state"], F.lit("'")))
    kind = page["population_kind"]
    population = F.when(kind.isNull() | (kind == "unstated"), "the page states no population").when((kind == "another") | ((kind == "package") & ~page["population_name"].eqNullSafe(name)), "the page counts another population")
    reasons = F.filter(F.array(total, state, population), lambda x: x.isNotNull())
    return F.when(page.isNull(), F.lit("no page has loaded")).when(F.size(reasons) > 0, F.array_join(reasons, "; "))


def population(value: Column) -> Column:
    """(kind, name) of a stated population (name, package_type)."""
    name, kind = value["name"], value["package_type"]
    both = F.coalesce(name != "", F.lit(False)) & F.coalesce(kind != "", F.lit(False))
    word = F.when(value.isNull(), "unstated").when(name.isNull() & kind.isNull(), "every package").when(both, "package").otherwise("another")
    return F.struct(word.alias("kind"), F.when(both, F.lower(name)).alias("name"))


def fleet_index(fleet: DataFrame) -> DataFrame:
    """(key, score, answered): accepted answers; the score is null where there were no events. Of equal names the greatest score."""
    good = fleet.where(F.col("name").isNotNull() & F.col("anomaly_score").isNotNull() & ~F.isnan("anomaly_score") & (F.abs("anomaly_score") < float("inf")) & F.col("event_count").isNotNull())
    score = F.max(F.when(F.col("event_count") > 0, F.col("anomaly_score"))).alias("score")
    return good.groupBy(F.lower("name").alias("key")).agg(score)


def alerts_by_name(alerts: DataFrame) -> DataFrame:
    """(key, alerts), each alert id once, in order of ids."""
    once = alerts.where(F.col("id").isNotNull() & F.col("name").isNotNull()).select(F.lower("name").alias("key"), "id", "type").dropDuplicates(["key", "id"])
    return once.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "type"))).cast(f"array<{ALERT}>").alias("alerts"))


def first_alerts(alerts: DataFrame, order: str) -> DataFrame:
    """Each id's first row by ``order``."""
    first = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return alerts.withColumn("_n", first).where("_n = 1").drop("_n")


def united(a: Column, b: Column) -> Column:
    """Alerts of both, each id once, first seen first."""
    return F.aggregate(b, a, lambda acc, x: F.when(F.exists(acc, lambda k: k.id == x.id), acc).otherwise(F.concat(acc, F.array(x))))


def lookup(docs: DataFrame, package: str, registry: Registry, out: str = "lookup") -> DataFrame:
    """``docs`` with (status, reason, score, alerts) of their package: hit, miss, partial or error."""
    spark = docs.sparkSession
    key = F.lower(F.col(package))
    df = docs.withColumn("_key", key)

    def joined(df: DataFrame, other: DataFrame | None, names: dict[str, str]) -> DataFrame:
        if other is None:
            return df.withColumns({n: F.lit(None).cast(t) for n, t in names.items()})
        renamed = other.select(F.col("key").alias("_k"), *[F.col(n.removeprefix("_")).alias(n) for n in names])
        return df.join(renamed, F.col("_key") == F.col("_k"), "left").drop("_k")

    df = joined(df, fleet_index(registry.fleet) if registry.fleet is not None else None, {"_score": "double"})
    own = fleet_index(registry.own_fleet).select("key", F.col("score").alias("own_score"), F.lit(True).alias("answered")) if registry.own_fleet is not None else None
    df = joined(df, own, {"_own_score": "double", "_answered": "boolean"})
    df = joined(df, alerts_by_name(registry.alerts) if registry.alerts is not None else None, {"_alerts": f"array<{ALERT}>"})
    listed = registry.listed.select(F.lower("name").alias("key"), F.col("type").alias("listed_type")) if registry.listed is not None else None
    df = joined(df, listed, {"_listed_type": "string"})
    pages = None
    if registry.own_pages is not None:
        page = F.struct("alerts_held", "total", "limit", "producer_state", "population_kind", "population_name").cast(PAGE)
        pages = registry.own_pages.groupBy(F.lower("name").alias("key")).agg(F.collect_list(F.struct(page.alias("page"), F.col("alerts").cast(f"array<{ALERT}>").alias("alerts"))).alias("own"))
    df = joined(df, pages, {"_own": f"array<struct<page:{PAGE},alerts:array<{ALERT}>>>"})
    one = registry.page if registry.page is not None else spark.createDataFrame([], "alerts_held long, total long, limit long, producer_state string, population_kind string, population_name string")
    held = one.agg(F.first(F.struct("alerts_held", "total", "limit", "producer_state", "population_kind", "population_name").cast(PAGE)).alias("p")).scalar()  # a page is one row
    df = df.withColumn("_page", held)

    c = F.col
    no_alerts = none_of(ALERT)
    page_alerts = F.coalesce(c("_alerts"), no_alerts)
    signal = F.coalesce(c("_own_score"), c("_score"))
    mine = F.filter(c("_own"), lambda o: (o.page.population_kind == "package") & o.page.population_name.eqNullSafe(c("_key")))
    own_alerts = F.aggregate(F.transform(mine, lambda o: o.alerts), no_alerts, united)
    gaps = F.filter(F.transform(c("_own"), lambda o: gap(o.page, c("_key"))), lambda g: g.isNotNull())
    usable = c("_listed_type").isNotNull() & (F.size(c("_own")) > 0)
    complete = usable & (F.size(gaps) == 0)
    own_all = F.when(complete, united(own_alerts, F.filter(page_alerts, lambda a: a.type == c("_listed_type")))).otherwise(united(own_alerts, page_alerts))
    fleet_known = F.lit(registry.fleet is not None) | F.coalesce(c("_answered"), F.lit(False))
    page_gap = gap(c("_page"), c("_key"))
    result = lambda status, reason=None, alerts=None: F.struct(F.lit(status).alias("status"), (reason if reason is not None else F.lit(None).cast("string")).alias("reason"), signal.alias("score"), (alerts if alerts is not None else no_alerts).alias("alerts"))
    by_own = (
        F.when(~complete & (F.size(own_all) == 0), result("partial", F.get(gaps, F.lit(0))))
        .when((F.size(own_all) == 0) & ~fleet_known, result("error", F.lit("fleet anomaly signal not loaded")))
        .when((F.size(own_all) == 0) & signal.isNull(), result("miss"))
        .otherwise(result("hit", None, own_all))
    )
    has_page = F.lit(registry.page is not None)
    by_page = (
        F.when(c("_alerts").isNull() & (has_page | signal.isNotNull()) & page_gap.isNotNull(), result("partial", page_gap))
        .when(~fleet_known & c("_alerts").isNull(), result("error", F.when(has_page, "fleet anomaly signal not loaded").otherwise("registry cache not warmed")))
        .when(signal.isNull() & c("_alerts").isNull(), result("miss"))
        .otherwise(result("hit", None, page_alerts))
    )
    found = F.when(c(package) == "", result("error", F.lit("empty package name"))).when(usable, by_own).otherwise(by_page)
    return df.withColumn(out, F.when(c(package).isNotNull(), found)).drop(*[n for n in df.columns if n.startswith("_") and n not in docs.columns])


def apply(verdict: Column, violations: Column, found: Column, package: Column, trust_level: Column, on_unknown: Column) -> Column:
    """(verdict, violations, signals). ``found`` is a lookup; null where no package was named, which changes nothing."""
    mult = sensitivity(trust_level)
    status, score = found["status"], found["score"]
    seen = status.isin("hit", "partial")
    blocked = (status == "hit") & (F.size(found["alerts"]) > 0)
    effective = F.when(seen, score * mult)
    raised = F.coalesce(effective > THRESHOLD, F.lit(False)) & ~blocked
    elevated = raised & (verdict == "CLEAN")
    unknown = F.coalesce(status.isin("miss", "partial", "error") & on_unknown.isNotNull(), F.lit(False))
    own = lambda cond, v: F.when(cond, F.array(v)).otherwise(none_of(VIOLATION))
    alert = added(F.lit("SUPPLY_CHAIN_ALERT"), F.array_join(F.transform(found["alerts"], lambda a: a.id), ","))
    anomaly = added(F.lit("FLEET_ANOMALY_ELEVATED"), F.concat(F.lit("anomalyScore="), score.cast("string"), F.lit(",effectiveScore="), effective.cast("string")), effective)
    missing = added(F.lit("REGISTRY_UNKNOWN"), F.concat(F.lit("status="), status))
    after = F.when(blocked, "DENY").when(elevated, "VIOLATION").otherwise(verdict)
    final = F.when(unknown & ((on_unknown == "deny") | (after == "DENY")), "DENY").when(unknown, "VIOLATION").otherwise(after)
    signals = F.when(
        found.isNotNull(),
        F.struct(
            status.alias("status"),
            F.when(seen, score).alias("fleet_anomaly_score"),
            effective.alias("effective_anomaly_score"),
            mult.alias("trust_sensitivity_multiplier"),
            F.when(raised, DELTA).otherwise(0.0).alias("threshold_delta"),
            F.coalesce(blocked, F.lit(False)).alias("supply_chain_block"),
            package.alias("package_name"),
            found["reason"].alias("reason"),
        ),
    )
    return F.struct(final.alias("verdict"), F.concat(violations, own(blocked, alert), own(elevated, anomaly), own(unknown, missing)).alias("violations"), signals.alias("signals"))


def checked_listing(listed: DataFrame) -> DataFrame:
    """``listed`` (name, type), or a TypeError: names and types must not be empty, and each name must occur once whatever its case."""
    bad = listed.where(F.coalesce(F.trim("name"), F.lit("")) == "").unionByName(listed.where(F.coalesce(F.trim("type"), F.lit("")) == "")).limit(1).count()
    twice = listed.groupBy(F.lower("name").alias("key")).count().where("count > 1").limit(3).collect()
    if bad or twice:
        raise TypeError("source packages need a name and a type each" if bad else f"source packages occur twice: {', '.join(r['key'] for r in twice)}")
    return listed
