"""Matches of a pattern with their places, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from .dual import F

SPAN = "struct<m:string,v:string,s:int,e:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value`` for a column of its own that later filters do not look through: Spark would put what makes the column into each of them, and work it out again."""
    return F.explode(F.array(value))


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


BLOCK = 64


def cut(xs: Column, size: int) -> Column:
    """``xs`` in parts of ``size`` elements; an empty one is one empty part."""
    last = F.greatest(F.floor((F.size(xs) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * size + 1, size))


def scan(rows: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """(state, out) after going through ``rows``: ``step`` gives the next state and an array of what a row adds to ``out``, whose
    elements are of that type. A list that grows by one is copied each time, so rows are taken in blocks, and lists are put together by block."""

    def one(acc: Column, x: Column) -> Column:
        after, added = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], added).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["state"].alias("state"), none_of(out).alias("out")), one)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def through(xs: Column) -> Column:
        blocks = F.flatten(F.transform(cut(xs, BLOCK * BLOCK), lambda big: cut(big, BLOCK)))  # a slice goes through its array from the start
        start = F.struct(state.alias("state"), none_of(f"array<{out}>").alias("out"))
        return F.aggregate(blocks, start, block, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))

    return let(rows, through)


def placed(text: Column, found: Column, pattern: str | Column, group: int = 0) -> Column:
    """Array of SPAN of the matches ``found`` of ``pattern``. What stands before a match is the pieces between matches up to it, and those matches."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    values = F.regexp_extract_all(text, regex, F.lit(group)) if group else found
    rows = F.zip_with(F.zip_with(pieces, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), values, lambda x, v: F.struct(x.g.alias("g"), x.m.alias("m"), v.alias("v")))

    def take(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + F.length(x["g"])
        e = s + F.length(x["m"])
        return e, F.array(F.struct(x["m"].alias("m"), F.when(x["v"] == "", x["m"]).otherwise(x["v"]).alias("v"), s.alias("s"), e.alias("e")))

    return scan(rows, F.lit(0), take, SPAN)["out"]


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (m, v, s, e): each leftmost non-overlapping match, its group (the match itself where that is empty), and where it
    starts and ends in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, placed(text, m, pattern, group)).otherwise(none_of(SPAN)))


def kept_places(text: Column, removed: Column) -> Column:
    """Places of the characters outside ``removed`` spans (s, e in order)."""
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda x: x.e))
    ends = F.concat(F.transform(removed, lambda x: x.s), F.array(F.length(text)))
    ranges = F.zip_with(starts, ends, lambda s, e: F.when(e > s, F.sequence(s, e - 1)).otherwise(none_of("int")))
    return F.flatten(ranges)
