"""Secret scans with corpus-wide ownership frequency.

Base kinds are patterns of contract; further kinds are token shapes of their own. Every match of any kind is a candidate,
and the hash of its secret is counted over the corpus: in how many owners and repositories it occurs. A secret that
``example_owners`` owners or more have is a widely copied example; one with fewer owners is live-looking. Base spans are
always reported; spans of the further kinds only where live-looking and outside the base spans of the text.

The texts are read once; their rows then hold only counts and candidates. Before secrets are counted they are reduced to
distinct (secret, owner, repository), which tasks do first on their own, so an example in a third of all texts is a few
rows. Rows with secrets are joined by secret with one row for each secret; Spark splits the larger side where it is hot.

Nulls: a null text is empty. A null owner or repository counts as one more value. An empty table gives an empty result.
Rows with equal doc_id and equal text are one document in the result. Positions are code points, ends exclusive. Other
columns don't matter. Work in a row is linear in the text and its matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import redact_ranges
from ..functions.spans import scan as in_blocks
from .store import staged
from .text import let


@dataclass(frozen=True)
class Kind:
    """``secret`` is the group of the pattern that holds the secret; it has ``least`` characters or more."""

    name: str
    pattern: str
    secret: int
    least: int


#: The base kinds, in order. Runs of hex digits and of key letters are matched with their least length in the
#: pattern, which finds the same spans as matching all runs and dropping short ones.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Shapes that widely used services give their credentials.
FURTHER = (
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Kind("google", r"AIza[0-9A-Za-z_-]{35,}", 0, 39),
    Kind("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}", 0, 15),
    Kind("jwt", r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}", 0, 29),
)
KINDS = BASE + FURTHER
EXAMPLE_OWNERS = 3
SPAN = "struct<k:int,s:int,e:int,v:string>"


def matches(text: Column, order: int, kind: Kind) -> Column:
    """Array of (k, s, e, v): leftmost non-overlapping matches whose secret v is long enough; k is ``order``."""
    none = F.array().cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m, text, kind, order)))


def placed(found: Column, text: Column, kind: Kind, order: int) -> Column:
    """Positions of the ``found`` matches: what stands before a match is the text between the matches up to it, and those."""
    gaps = F.split(text, kind.pattern, -1)
    secrets = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.secret)) if kind.secret else found
    rows = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), secrets, lambda x, v: F.struct(x.g.alias("g"), x.m.alias("m"), v.alias("v")))

    def take(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + F.length(x["g"])
        e = s + F.length(x["m"])
        return e, F.array(F.struct(F.lit(order).alias("k"), s.alias("s"), e.alias("e"), x["v"].alias("v")))

    return F.filter(in_blocks(rows, F.lit(0), take, SPAN)["out"], lambda x: F.length(x.v) >= kind.least)


def as_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat(F.get(names, x.k), F.lit(":"), x.s.cast("string"), F.lit(":"), x.e.cast("string"))), ",")


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """(doc_id, text_key, owner, repository, found) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t"), F.struct(owner).alias("owner"), F.struct(repository).alias("repository"))
    found = F.concat(*[matches(F.col("t"), i, k) for i, k in enumerate(KINDS)])
    return rows.select("doc_id", F.xxhash64("t").alias("text_key"), F.to_json("owner").alias("owner"), F.to_json("repository").alias("repository"), found.alias("found"))


def ownership(rows: DataFrame) -> DataFrame:
    """(secret, owners, repositories): in how many of each a secret's hash occurs."""
    each = rows.select("owner", "repository", F.explode("found").alias("x")).select(F.sha2("x.v", 256).alias("secret"), "owner", "repository")
    return each.distinct().groupBy("secret").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))


def scan(docs: DataFrame, owner: Column, repository: Column, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc_id, text_key, spans, live): ``spans`` has all reported (k, s, e), ``live`` the live-looking ones among them."""
    rows = staged(candidates(docs, owner, repository), "secrets")
    some = rows.where(F.size("found") > 0)
    each = some.select("doc_id", "text_key", F.explode("found").alias("x")).select("doc_id", "text_key", "x.k", "x.s", "x.e", F.sha2("x.v", 256).alias("secret")).distinct()
    seen = each.join(ownership(some), "secret").withColumn("is_live", F.col("owners") < example_owners)
    span = F.struct("k", "s", "e", "is_live")
    grouped = seen.groupBy("doc_id", "text_key").agg(F.collect_list(span).alias("x"))
    base = F.filter("x", lambda a: a.k < len(BASE))
    more = F.filter("x", lambda a: (a.k >= len(BASE)) & a.is_live & ~F.exists(base, lambda b: (b.s < a.e) & (a.s < b.e)))
    plain = lambda a: F.transform(a, lambda s: F.struct(s.k.alias("k"), s.s.alias("s"), s.e.alias("e")))
    kept = grouped.select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), F.concat(base, more).alias("x"))
    kept = kept.select("g_id", "g_key", plain(F.col("x")).alias("spans"), plain(F.filter("x", lambda s: s.is_live)).alias("live"))
    both = rows.select("doc_id", "text_key").distinct().join(kept, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left")
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    return both.select("doc_id", "text_key", F.coalesce("spans", none).alias("spans"), F.coalesce("live", none).alias("live"))


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each span, overlapping and touching ones put together, replaced by ``mark``."""
    return redact_ranges(text, F.transform(spans, lambda x: F.struct(x.s.alias("start"), x.e.alias("end"))), mark)
