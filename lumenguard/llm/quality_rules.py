"""Quality rules whose limits follow each language and source.

A first pass measures every text. Each measure goes into quantile sketches, one per (lang, source): counts over
buckets that are exact below 64 and have 32 steps to each doubling above, so a quantile is off by 1/32 at most and
sketches merge by adding counts. Groups with under ``min_group`` texts use the merged sketch of their language, and
languages with too few the one of all texts. A limit is the third quartile plus ``fence`` times the distance between the
quartiles (that distance counts as ``least_spread`` at least, so that a uniform group rejects nothing odd by a hair), or
the mirror image below the first quartile. Texts are then joined with the limits of their group.

Everything is DataFrame code. The sketches have a bounded number of rows per group, added up before any shuffle, so a
source with a third of all rows costs no more than another one.

Nulls: a null text has no words and fails the base rule. A null lang or source is a group of its own. An empty table
gives an empty result. Repeated rows are judged one by one. Columns of the input other than doc_id, text, lang and source
don't matter. Texts may be of any length: all work in a row is linear, or n log n where windows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import staged
from .text import SPACED, let, total, words

SYMBOLS = "[#*$%&|<>]"
FEW = 16
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A measure in whole numbers and the side on which it can be too far out."""

    name: str
    upper: bool
    least_spread: int


#: Symbols and repeats count per thousand, word lengths in hundredths of a character.
RULES = (
    Rule("symbols_pm", True, 15),
    Rule("dup_lines_pm", True, 60),
    Rule("repeats_pm", True, 60),
    Rule("word_length", True, 60),
    Rule("word_length", False, 60),
)


@dataclass(frozen=True)
class Params:
    fence: int = 6
    min_group: int = 200
    min_words: int = 50
    max_repeat_percent: int = 50


def repeated_words(ws: Column) -> Column:
    """Words inside three-word windows that occur twice or more in ``ws``; windows are compared by 64-bit hashes.

    Texts with few repeated windows look each window up among those; beyond ``FEW`` a sort brings equal ones together.
    """

    def inside(starts: Column) -> Column:
        return let(starts, lambda s: total(F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3))).cast("long"))))

    def sorted_out(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda ps: F.filter(ps, lambda p, i: (p.h == F.get(ps, i - 1).h) | (p.h == F.get(ps, i + 1).h))
        return let(pairs, lambda ps: inside(F.sort_array(F.transform(twice(ps), lambda p: p.i))))

    def looked_up(h: Column, again: Column) -> Column:
        at = F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i))
        return inside(F.filter(at, lambda i: i.isNotNull()))

    def covered(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        by_size = lambda a: F.when(F.size(a) <= FEW, looked_up(h, a)).otherwise(sorted_out(h))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(again, by_size))

    windows = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    return let(windows, covered)


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with the base counts and the measures of ``RULES``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(SPACED))
    first = docs.select(*keep, words(F.col("text")).alias("_ws"), lines.alias("_lines"), F.size(F.regexp_extract_all(text, F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"))
    counted = first.select(
        *keep,
        F.size("_ws").cast("long").alias("n_words"),
        F.length(F.array_join("_ws", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        repeated_words(F.col("_ws")).alias("n_repeat_words"),
    )

    def part(a: str, b: str, of: int) -> Column:
        return F.expr(f"coalesce({a} * {of}L div nullif({b}, 0), 0L)")

    return counted.withColumns(
        {
            "symbols_pm": part("n_symbols", "word_chars", 1000),
            "dup_lines_pm": part("n_dup_lines", "_n_lines", 1000),
            "repeats_pm": part("n_repeat_words", "n_words", 1000),
            "word_length": part("word_chars", "n_words", 100),
        }
    ).drop("_n_lines")


def bucket(v: Column) -> Column:
    """Lowest value of the sketch bucket that holds ``v``: itself below 64, else its six leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, v, n): mergeable counts, one row for each bucket in use."""
    names = list(dict.fromkeys(r.name for r in RULES))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), bucket(F.col(n)).alias("v")) for n in names]))
    rows = counted.select("lang", "source", each.alias("m")).select("lang", "source", "m.measure", "m.v")
    return rows.groupBy("lang", "source", "measure", "v").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, n, q1 and q3 of the sketches merged over everything but ``keys``; at most some hundred buckets are in a window."""
    from pyspark.sql import Window

    merged = sketch.groupBy(*keys, "measure", "v").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.select(*keys, "measure", "v", F.sum("n").over(group.orderBy("v")).alias("c"), F.sum("n").over(group).alias("n"))
    q = lambda k: F.min(F.when(F.col("c") * 4 >= F.col("n") * k, F.col("v"))).alias(f"q{k}")
    return ranked.groupBy(*keys, "measure").agg(F.first("n").alias("n"), q(1), q(3))


def limits(sketch: DataFrame, p: Params) -> DataFrame:
    """(lang, source, one limit column for each rule): one row per (lang, source)."""
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), F.col("n").alias("l_n"), F.col("q1").alias("l_q1"), F.col("q3").alias("l_q3"))
    every = quartiles(sketch, []).select(F.col("measure").alias("e_measure"), F.col("q1").alias("e_q1"), F.col("q3").alias("e_q3"))
    all_three = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))).join(every, F.col("measure") == F.col("e_measure"))
    pick = lambda k: F.when(F.col("n") >= p.min_group, F.col(k)).when(F.col("l_n") >= p.min_group, F.col(f"l_{k}")).otherwise(F.col(f"e_{k}"))
    found = all_three.select("lang", "source", "measure", pick("q1").alias("q1"), pick("q3").alias("q3"))

    def limit(r: Rule) -> Column:
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(r.least_spread)) * p.fence
        return F.max(F.when(F.col("measure") == r.name, F.col("q3") + spread if r.upper else F.col("q1") - spread))

    return found.groupBy("lang", "source").agg(*[limit(r).alias(f"limit_{i}") for i, r in enumerate(RULES)])


def judge(docs: DataFrame, keep: list[str] | None = None, p: Params = Params()) -> DataFrame:
    """``keep`` (doc_id, lang and source if None), the base counts, base_failed and kept for every row."""
    keep = keep or ["doc_id", "lang", "source"]
    need = [*keep, *[c for c in ("lang", "source") if c not in keep]]
    counted = staged(measured(docs, need), "quality")
    bounds = limits(sketches(counted), p).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[f"limit_{i}" for i in range(len(RULES))])
    both = counted.join(bounds, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    failed = (F.col("n_words") < p.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * p.max_repeat_percent)
    inside = F.lit(True)
    for i, r in enumerate(RULES):
        inside &= F.col(r.name) <= F.col(f"limit_{i}") if r.upper else F.col(r.name) >= F.col(f"limit_{i}")
    return both.select(*keep, *BASE, *dict.fromkeys(r.name for r in RULES), failed.alias("base_failed"), (~failed & inside).alias("kept"))
