"""URL filters: given rules first, then association rules that pattern growth mines from labelled pages.

A URL is a set of tokens: ``host:`` and each label of its host, ``path:`` and each segment of its path, ``query:`` and each
name in its query. Pages with a label are transactions of all their tokens. A condition is a set of at most ``max_condition``
tokens that ``min_support`` of the labelled pages or more (``min_count`` at least) have and are bad. Conditions grow as in
FP-growth, in a fixed order over the pages that have what is found so far, each with its later tokens; as growth ends with
``max_condition`` tokens, the number of sets of a long URL is a power of its length and not exponential, and no
token has to be left out. All counts are over all labelled pages. A condition is a rule where ``min_confidence`` percent of the
pages with it are bad, or more, unless a rule with part of it is no less sure. A URL meets a rule if it has all its tokens.
For that, each rule is listed in an inverted index under its rarest token, the tokens of all URLs are looked up there, and what
is found is compared in full.

Equal URLs are judged once. Nulls: a null URL has an empty host and path, no tokens, and is allowed; a null or other label
than 0 and 1 counts as 0. A page with several labels is bad if one of them is. No labels, or no pages: no rules. Repeated rows
are each returned. Other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import staged, staged_bytes
from .text import lower_az


@dataclass(frozen=True)
class HostRule:
    """``rule`` is a host, which stands for its subdomains too, and how a path starts, such as ``example.com/en/``."""

    action: str
    rule: str


@dataclass(frozen=True)
class Params:
    min_count: int = 20
    min_support_pm: int = 2  # of the labelled pages, per thousand
    min_confidence: int = 60
    max_condition: int = 3
    broadcast_bytes: int = 8 << 20


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: list[HostRule]) -> Column:
    """(action, rule) of the longest rule that fits, else null; of equally long ones the first."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        own, _, start = r.rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        found = F.when(fits, F.struct(F.lit(r.action).alias("action"), F.lit(r.rule).alias("rule"))).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    each = F.concat(named("host:", F.split(host, r"\.")), named("path:", F.split(lower_az(path), "/")), named("query:", names))
    return F.coalesce(F.array_distinct(each), F.array().cast("array<string>"))


def transactions(labelled: DataFrame, least: int) -> DataFrame:
    """(bad, items) of the pages in ``labelled`` (page_id, toks, bad): all tokens that enough bad pages have, in order."""
    rows = labelled.select("page_id", "bad", F.explode("toks").alias("tok"))
    frequent = rows.where("bad").groupBy("tok").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return rows.join(frequent, "tok").groupBy("page_id", "bad").agg(F.array_sort(F.collect_set("tok")).alias("items")).select("bad", "items")


def conditions(rows: DataFrame, most: int, least: int) -> DataFrame:
    """(toks, n, n_bad): sets of up to ``most`` tokens that ``least`` bad pages have, counted over all ``rows`` (bad, items)."""
    ahead = rows.select("bad", F.array().cast("array<string>").alias("toks"), F.col("items").alias("later"))
    levels = []
    for size in range(1, most + 1):
        grown = ahead.select("bad", "toks", "later", F.posexplode("later").alias("at", "tok"))
        grown = grown.select("bad", F.concat("toks", F.array("tok")).alias("toks"), F.slice("later", F.col("at") + 2, F.greatest(F.size("later"), F.lit(1))).alias("later"))
        counts = grown.groupBy("toks").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"))
        levels.append(staged(counts.where(F.col("n_bad") >= least), f"conditions-{size}"))
        ahead = grown.where(F.size("later") > 0).join(levels[-1].select("toks"), "toks", "left_semi")
    return reduce(DataFrame.unionByName, levels)


def mine(labelled: DataFrame, p: Params) -> DataFrame:
    """(rule_id, toks, n, n_bad): conditions that make a page bad."""
    spark = labelled.sparkSession
    pages = labelled.count()
    least = max(p.min_count, -(-pages * p.min_support_pm // 1000))
    empty = spark.createDataFrame([], "rule_id long, toks array<string>, n long, n_bad long")
    if pages < least:
        return empty
    found = conditions(staged(transactions(labelled, least), "transactions"), p.max_condition, least)
    sure = staged(found.where(F.col("n_bad") * 100 >= F.col("n") * p.min_confidence), "rules")
    parts = sure.select(F.col("toks").alias("p_toks"), F.col("n").alias("p_n"), F.col("n_bad").alias("p_bad"))
    # a condition has at most 2 ** max_condition parts: list them and look them up
    subsets = F.aggregate("toks", F.array(F.array().cast("array<string>")), lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(t)))))
    listed = sure.select("toks", "n", "n_bad", F.explode(F.filter(subsets, lambda s: (F.size(s) > 0) & (F.size(s) < F.size("toks")))).alias("p_toks"))
    idle = listed.join(parts, "p_toks").where(F.col("p_bad") * F.col("n") >= F.col("n_bad") * F.col("p_n")).select("toks").distinct()
    return sure.join(idle, "toks", "left_anti").select(F.xxhash64("toks").alias("rule_id"), "toks", "n", "n_bad")


def fired(urls: DataFrame, rules: DataFrame, p: Params) -> DataFrame:
    """(url, rule): for each of ``urls`` (url, toks) that meets rules the surest one, as its tokens joined by `` & ``."""
    from pyspark.sql import Window

    rules = staged(rules, "index")
    weight = rules.select(F.explode("toks").alias("tok"), "n").groupBy("tok").agg(F.max("n").alias("w"))
    keyed = rules.select("rule_id", "toks", "n", "n_bad", F.explode("toks").alias("tok")).join(weight, "tok")
    rarest = F.row_number().over(Window.partitionBy("rule_id").orderBy("w", "tok"))
    index = keyed.withColumn("at", rarest).where("at = 1").select("tok", F.col("toks").alias("need"), "n", "n_bad")
    if staged_bytes(rules.sparkSession, rules) <= p.broadcast_bytes:
        index = F.broadcast(index)
    found = urls.select("url", "toks", F.explode("toks").alias("tok")).join(index, "tok").where(F.size(F.array_except("need", "toks")) == 0)
    best = F.max(F.struct((F.col("n_bad") / F.col("n")).alias("sure"), F.col("n"), F.array_join("need", " & ").alias("rule")))
    return found.groupBy("url").agg(best.alias("b")).select("url", F.col("b.rule").alias("mined_rule"))


def judge(pages: DataFrame, bad_pages: DataFrame, rules: list[HostRule], p: Params = Params()) -> DataFrame:
    """(page_id, url, host, path, rule, mined_rule, verdict) of every row; ``bad_pages`` has (page_id, bad) of the labelled pages."""
    rows = pages.select("page_id", "url")
    urls = rows.where(F.col("url").isNotNull()).select("url").distinct()
    urls = staged(urls.select("url", tokens(F.col("url"), host_of(F.col("url")), path_of(F.col("url"))).alias("toks")), "urls")
    labels = bad_pages.groupBy("page_id").agg(F.max(F.coalesce(F.col("bad").cast("int"), F.lit(0))).alias("bad")).where(F.col("page_id").isNotNull())
    labelled = rows.join(labels, "page_id").distinct().join(urls, "url").select("page_id", "toks", (F.col("bad") == 1).alias("bad"))
    mined = fired(urls, mine(staged(labelled, "labelled"), p), p).withColumnRenamed("url", "m_url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = rows.select("page_id", "url", host.alias("host"), path.alias("path")).join(mined, F.col("url") == F.col("m_url"), "left")
    given = host_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("g", given).select("page_id", "url", "host", "path", F.col("g.rule").alias("rule"), "mined_rule", F.coalesce("g.action", by_method).alias("verdict"))
