"""Findings of the rule pack in a text or in each of its views, in the row.

Findings are ordered by confidence from high to low, then by pattern, then by place; that order is part of the result. Of
overlapping findings with one value the first stays. Offsets are code points and span the whole match.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window

from ..functions import pack
from ..functions.dual import F, as_text
from ..functions.masks import mask
from ..functions.spans import find, let, none_of, placed, scan
from ..functions.validators import VALIDATORS

MATCH = "struct<type:string,idx:int,value:string,start:int,end:int,confidence:double>"
VIOLATION = "struct<type:string,value:string,start:int,end:int,confidence:double,classifier:string,view:string,original_start:int,original_end:int>"


def is_reference(value: Column) -> Column:
    """True for captures that only name where a secret is."""
    return F.trim(value).rlike(pack.reference_regex())


def may_match(text: Column, low: Column, hint: str) -> Column:
    """A cheap necessary condition. ``low`` is the text in lower case; words are looked up in it, which is faster than a pattern without case."""
    if not hint.startswith("(?i)"):
        return text.contains(hint) if hint.replace("-", "").replace("_", "").isalnum() else text.rlike(hint)
    found = F.lit(False)
    for word in hint.removeprefix("(?i)").split("|"):
        found |= low.contains(word.lower())
    return found


def pattern_matches(text: Column, idx: int, p: pack.Pattern, low: Column | None = None) -> Column:
    """Array of MATCH of one pattern. Values are judged after matching, so a rejected match still takes up its text."""
    ok = VALIDATORS[p.validator]
    good = F.filter(find(text, pack.java(p), 1), lambda x: ~is_reference(x.v) & ok(x.v))
    each = F.transform(good, lambda x: F.struct(F.lit(p.cls).alias("type"), F.lit(idx).alias("idx"), x.v.alias("value"), x.s.alias("start"), x.e.alias("end"), F.lit(p.confidence).alias("confidence")))
    return F.when(may_match(text, F.lower(text) if low is None else low, p.hint), each).otherwise(none_of(MATCH)) if p.hint else each


def ordered(matches: Column) -> Column:
    keyed = F.transform(matches, lambda m: F.struct((-m.confidence).alias("k"), m.idx.alias("i"), m.start.alias("s"), m.alias("m")))
    return F.transform(F.array_sort(keyed), lambda x: x.m)


def drop_overlaps(matches: Column) -> Column:
    """In the order given, keeps a match unless a kept one with the same value overlaps it.

    That is looked at only where neighbours of one value, by start, overlap at all, and then only within runs of such matches.
    """
    by_place = F.array_sort(F.transform(matches, lambda m, i: F.struct(m.value.alias("v"), m.start.alias("s"), m.end.alias("e"), i.alias("i"))))

    def decided(places: Column) -> Column:
        touching = F.exists(F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), lambda x, y: F.coalesce((x.v == y.v) & (y.s < x.e), F.lit(False))), lambda t: t)
        flags = F.transform(F.array_sort(kept_in_runs(F.array_sort(runs_of(places)))), lambda x: x.kept)
        chosen = F.transform(F.filter(F.zip_with(matches, flags, lambda m, k: F.struct(m.alias("m"), k.alias("k"))), lambda x: x.k), lambda x: x.m)
        return F.when(touching, chosen).otherwise(matches)

    return let(by_place, decided)


RUN = "struct<run:int,i:int,s:int,e:int>"
SPANS = "array<struct<s:int,e:int>>"


def runs_of(places: Column) -> Column:
    """Array of RUN of the sorted ``places`` (v, s, e, i): a run ends where a value's next match starts after all before it have ended."""

    def take(state: Column, x: Column) -> tuple[Column, Column]:
        goes_on = F.coalesce((state["v"] == x["v"]) & (x["s"] < state["e"]), F.lit(False))
        run = F.when(goes_on, state["run"]).otherwise(state["run"] + 1)
        after = F.struct(x["v"].alias("v"), F.when(goes_on, F.greatest(state["e"], x["e"])).otherwise(x["e"]).alias("e"), run.alias("run"))
        return after, F.array(F.struct(run.alias("run"), x["i"].alias("i"), x["s"].alias("s"), x["e"].alias("e")))

    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).alias("e"), F.lit(0).alias("run"))
    return scan(places, start, take, RUN)["out"]


def kept_in_runs(rows: Column) -> Column:
    """Array of (i, kept) of ``rows`` of RUN by run and order: in a run the first stays, and each later one that overlaps none that does."""

    def take(state: Column, x: Column) -> tuple[Column, Column]:
        same = state["run"] == x["run"]
        clash = same & F.exists(state["spans"], lambda k: (k["s"] < x["e"]) & (k["e"] > x["s"]))
        own = F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))
        spans = F.when(~same, own).when(clash, state["spans"]).otherwise(F.concat(state["spans"], own))
        return F.struct(x["run"].alias("run"), spans.alias("spans")), F.array(F.struct(x["i"].alias("i"), (~clash).alias("kept")))

    return scan(rows, F.struct(F.lit(0).alias("run"), F.array().cast(SPANS).alias("spans")), take, "struct<i:int,kept:boolean>")["out"]


def valid(kind: Column, value: Column) -> Column:
    """Whether ``value`` passes the validator named ``kind``."""
    ok = F.when(kind == "none", F.lit(True))
    for name, check in VALIDATORS.items():
        if name != "none":
            ok = ok.when(kind == name, check(value))
    return ok.otherwise(F.lit(False))


def all_matches(text: Column, patterns: tuple[pack.Pattern, ...]) -> Column:
    """Array of MATCH of all patterns, by pattern and place. Matches are looked for by each pattern; what follows is written once, for those that have some."""
    fields = lambda p: F.struct(F.lit(p.cls).alias("type"), F.lit(p.confidence).alias("confidence"), F.lit(p.validator).alias("validator"), F.lit(pack.java(p)).alias("pattern"))
    known = F.array(*[fields(p) for p in patterns])

    def by_pattern(low: Column) -> Column:
        found = lambda p: F.regexp_extract_all(text, F.lit(pack.java(p)), F.lit(0))
        each = F.array(*[F.when(may_match(text, low, p.hint), found(p)) if p.hint else found(p) for p in patterns])
        some = F.filter(F.transform(each, lambda f, i: F.struct(i.alias("i"), f.alias("f"))), lambda x: F.size(x.f) > 0)
        return F.flatten(F.transform(some, lambda x: let(F.get(known, x.i), lambda p: of_pattern(x, p))))

    def of_pattern(x: Column, p: Column) -> Column:
        good = F.filter(placed(text, x.f, p.pattern, 1), lambda y: ~is_reference(y.v) & valid(p.validator, y.v))
        return F.transform(good, lambda y: F.struct(p.type.alias("type"), x.i.alias("idx"), y.v.alias("value"), y.s.alias("start"), y.e.alias("end"), p.confidence.alias("confidence")))

    return let(F.lower(text), by_pattern)


def raw_matches(text: Column, patterns: tuple[pack.Pattern, ...] = pack.PATTERNS) -> Column:
    return let(all_matches(text, patterns), lambda all_: F.when(F.size(all_) == 0, none_of(MATCH)).otherwise(let(ordered(all_), drop_overlaps)))


def violations(view: Column, patterns: tuple[pack.Pattern, ...] = pack.PATTERNS) -> Column:
    """Array of VIOLATION of a view (text, view, map, has_map, start, end): values masked, places taken to the original."""

    def placed(m: Column) -> Column:
        start = F.when(~view.has_map, view.start).when(view.map.isNull(), m.start).otherwise(F.get(view.map, m.start))
        end = F.when(~view.has_map, view.end).when(view.map.isNull(), m.end).otherwise(F.get(view.map, m.end - 1) + 1)
        return F.struct(m.type.alias("type"), mask(m.value).alias("value"), m.start.alias("start"), m.end.alias("end"), m.confidence.alias("confidence"), F.lit("regex").alias("classifier"), view.view.alias("view"), start.alias("original_start"), end.alias("original_end"))

    return F.transform(raw_matches(view.text, patterns), placed)


def plain_view(text: Column) -> Column:
    """A text as it is, for scans without normalisation."""
    return F.struct(text.alias("text"), F.lit("normalized").alias("view"), F.lit(None).cast("array<int>").alias("map"), F.lit(True).alias("has_map"), F.lit(0).alias("start"), F.length(text).alias("end"), F.lit(0).alias("depth"))


def scan_text(text: Column, patterns: tuple[pack.Pattern, ...] = pack.PATTERNS) -> Column:
    return let(plain_view(F.coalesce(text, F.lit(""))), lambda v: violations(v, patterns))


@lru_cache(maxsize=16)
def scan_sql(text: str, patterns: tuple[pack.Pattern, ...] = pack.PATTERNS) -> str:
    """``scan_text`` of the column ``text`` as SQL, which is made once."""
    with as_text():
        return scan_text(F.col(text), patterns).sql


def finding_key(v: Column, has_map: Column) -> Column:
    base = F.concat(v.type, F.lit("@"), v.original_start.cast("string"), F.lit("-"), v.original_end.cast("string"))
    return F.when(has_map, base).otherwise(F.concat(base, F.lit("#"), v.view, F.lit(":"), v.start.cast("string"), F.lit("-"), v.end.cast("string")))


def across_views(views: Column, patterns: tuple[pack.Pattern, ...] = pack.PATTERNS) -> Column:
    """Findings of all views: those of the first as they are, of later ones each that has no finding with its key before it."""
    per_view = F.transform(views, lambda v: F.transform(violations(v, patterns), lambda x: F.struct(x.alias("x"), finding_key(x, v.has_map).alias("key"))))

    def merged(parts: Column) -> Column:
        first = F.get(parts, F.lit(0))
        later = F.flatten(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))

        def added(more: Column) -> Column:
            # by key, those of the first view before all others: a later one is new if the one before it has another key
            known = F.transform(first, lambda x: F.struct(x.key.alias("key"), F.lit(-1).alias("i"), x.x.alias("x")))
            rows = F.array_sort(F.concat(known, F.transform(more, lambda x, i: F.struct(x.key.alias("key"), i.alias("i"), x.x.alias("x")))))
            fresh = lambda r: F.filter(r, lambda x, i: (x.i >= 0) & ((i == 0) | ~F.get(r, i - 1)["key"].eqNullSafe(x.key)))
            return F.transform(F.array_sort(F.transform(let(rows, fresh), lambda x: F.struct(x.i.alias("i"), x.x.alias("x")))), lambda x: x.x)

        plain = F.transform(first, lambda x: x.x)
        return F.when(F.size(later) == 0, plain).otherwise(F.concat(plain, let(later, added)))

    return let(per_view, merged)


def exploded(df: DataFrame, findings: str, keys: list[str]) -> DataFrame:
    """One row for each finding, with ``pos`` from 0."""
    return df.select(*keys, F.posexplode(findings).alias("pos", "f")).select(*keys, "pos", "f.*")


def drop_overlaps_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``drop_overlaps`` over a table (keys, value, start, end, confidence, idx), for texts with very many findings.

    Findings of one value that follow one another without a gap are an island; islands can't clash. Only within
    an island of several findings are pairs looked at.
    """
    by_value = Window.partitionBy(*keys, "value").orderBy("start", "end")
    reach = F.max("end").over(by_value.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1))
    islands = marked.withColumn("_island", F.sum("_new").over(by_value.rowsBetween(Window.unboundedPreceding, 0)))
    others = [c for c in rows.columns if c not in (*keys, "value")]
    packed = F.struct((-F.col("confidence")).alias("_k"), F.col("idx").alias("_i"), F.col("start").alias("_s"), F.struct(*others).alias("r"))
    grouped = islands.groupBy(*keys, "value", "_island").agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x.r).alias("m"))
    clash = lambda kept, m: F.exists(kept, lambda k: (k["start"] < m["end"]) & (k["end"] > m["start"]))
    kept = F.aggregate("m", F.slice("m", 1, 0), lambda a, m: F.when(clash(a, m), a).otherwise(F.concat(a, F.array(m))))
    one = F.when(F.size("m") == 1, F.col("m")).otherwise(kept)
    return grouped.select(*keys, "value", F.explode(one).alias("r")).select(*keys, "value", "r.*").select(*rows.columns)
