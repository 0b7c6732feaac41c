"""Accuracy of detection, conformance with expected findings, and gates against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTS = (50, 95, 99)
#: Bands in which the ranks should lie go from this much below to as much above.
MARGIN = 0.001

def outcome_counts(label: Column, hit: Column) -> list[Column]:
    yes = label == "positive"
    return [F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"), F.count_if(~yes & ~hit).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall (1 where nothing could be missed) and f1 (0 where both are 0)."""
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col("tp") / (F.col(a) + F.col(b)))
    both = df.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))
    total = F.col("precision") + F.col("recall")
    return both.withColumn("f1", F.when(total == 0, 0.0).otherwise(F.col("precision") * 2 * F.col("recall") / total))


def accuracy(df: DataFrame, cls: str, label: str, types: str, variant: str | None = None) -> DataFrame:
    """By class, and with ``variant`` also by class and variant (null variant: all of them)."""
    rows = df.withColumn("_hit", F.array_contains(F.col(types), F.col(cls)))
    counts = outcome_counts(F.col(label), F.col("_hit"))
    if variant is None:
        return rates(rows.groupBy(cls).agg(*counts))
    return rates(rows.groupingSets([[cls], [cls, variant]], cls, variant).agg(*counts))


def regressions(now: DataFrame, baseline: DataFrame, cls: str, tolerance: float = 0.02) -> DataFrame:
    """Classes whose precision or recall fell by more than ``tolerance``."""
    base = baseline.select(F.col(cls), F.col("precision").alias("base_precision"), F.col("recall").alias("base_recall"))
    fell = lambda n: F.col(f"base_{n}") - F.col(n) > tolerance + 1e-9
    return now.join(base, cls).where(fell("precision") | fell("recall"))


def conformance(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(id, passed) of results (id, verdict, types, violations) against cases (id, verdict, types, violations); null violations are not compared."""
    want = cases.select("id", F.col("verdict").alias("w_verdict"), F.col("types").alias("w_types"), F.col("violations").alias("w_violations"))
    same = F.col("verdict").eqNullSafe(F.col("w_verdict")) & F.col("types").eqNullSafe(F.col("w_types")) & (F.col("w_violations").isNull() | F.col("violations").eqNullSafe(F.col("w_violations")))
    return want.join(results, "id", "left").select("id", F.coalesce(same, F.lit(False)).alias("passed"))


def duplicate_ids(cases: DataFrame) -> DataFrame:
    return cases.groupBy("id").count().where("count > 1")


def conformance_record(outcomes: DataFrame, pack_version: str, pack_sha256: str, most: int = 20) -> DataFrame:
    """One row about ``conformance`` outcomes: versions, how many cases there were and passed, and the first ``most`` failing ids in order."""
    spark = outcomes.sparkSession
    failed = outcomes.where(~F.col("passed")).orderBy("id").limit(most).agg(F.array_sort(F.collect_list("id")).alias("failures"))
    counts = outcomes.agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"))
    named = counts.select(F.lit("pyspark").alias("runtime"), F.lit(spark.version).alias("runtime_version"), F.lit(pack_version).alias("pack_version"), F.lit(pack_sha256).alias("pack_sha256"), "cases", "passed")
    return named.join(failed)  # one row each


def percentiles(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """p50, p95 and p99 of ``value`` by nearest rank, in all or by ``keys``; exact, and no group is sorted in one task.

    Values are counted, and fall into bands between approximate quantiles, which need not be right: the sums of bands tell which one
    holds a rank. Only the values of such bands, about one in 500, are put in order, each band by itself.
    """
    keys, c = keys or [], F.col
    groups = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.percentile_approx(value, [p / 100 + d for p in PERCENTS for d in (-MARGIN, MARGIN)], 10_000).alias("_edges"))
    names = [f"_key{i}" for i in range(len(keys))]

    def beside(rows: DataFrame, other: DataFrame) -> DataFrame:
        """``rows`` with the columns of ``other`` of their keys, which may be null."""
        renamed = other.select(*[c(k).alias(n) for k, n in zip(keys, names, strict=True)], *[x for x in other.columns if x not in keys])
        on = [c(k).eqNullSafe(c(n)) for k, n in zip(keys, names, strict=True)] or [F.lit(True)]
        return rows.join(renamed, on).drop(*names)

    counted = df.where(c(value).isNotNull()).groupBy(*keys, c(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    banded = beside(counted, groups.select(*keys, "_edges")).withColumn("_band", F.size(F.filter("_edges", lambda e: e < c("_v")))).drop("_edges")
    bands = banded.groupBy(*keys, "_band").agg(F.sum("_c").alias("_in"))
    upto = F.sum("_in").over(Window.partitionBy(*keys).orderBy("_band"))
    ranks = F.array(*[F.struct(F.lit(p).alias("p"), F.expr(f"(_n * {p} + 99) div 100").alias("rank")) for p in PERCENTS])
    wanted = beside(bands.withColumn("_upto", upto), groups.select(*keys, F.explode(ranks).alias("_w"))).where((c("_w.rank") <= c("_upto")) & (c("_w.rank") > c("_upto") - c("_in")))
    held = wanted.groupBy(*keys, c("_band").alias("_wanted")).agg(F.first(c("_upto") - c("_in")).alias("_before"), F.collect_list("_w").alias("_ws"))
    within = F.sum("_c").over(Window.partitionBy(*keys, "_band").orderBy("_v"))
    placed = beside(banded, held).where(c("_band") == c("_wanted")).withColumn("_to", c("_before") + within).select(*keys, "_v", "_c", "_to", F.explode("_ws").alias("_w"))
    at = placed.where((c("_w.rank") <= c("_to")) & (c("_w.rank") > c("_to") - c("_c"))).select(*keys, c("_w.p").alias("_p"), "_v")
    # groups without a value have a row, too
    every = at.unionByName(groups.select(*keys, F.lit(0).alias("_p"), F.lit(None).cast(dict(df.dtypes)[value]).alias("_v")))
    return every.groupBy(*keys).agg(*[F.max(F.when(c("_p") == p, c("_v"))).alias(f"p{p}") for p in PERCENTS])
