"""Masks, places in lines, and redaction."""

from __future__ import annotations

from pyspark.sql import Column

from .dual import F
from .spans import let, none_of, scan

GUARD_MASK, REDACTED = "***GUARD***", "[REDACTED]"


def mask(v: Column) -> Column:
    """All stars up to 8 characters, else dots and the last two, or from 13 characters on four."""
    n = F.length(v)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).when(n <= 12, F.concat(F.lit("..."), F.right(v, F.lit(2)))).otherwise(F.concat(F.lit("..."), F.right(v, F.lit(4))))


def line_column(text: Column, at: Column) -> Column:
    """(line, column) from 1 of a place from 0; only a line feed ends a line. Null outside the text."""
    before = F.substring(text, F.lit(1), at)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    column = F.length(F.substring_index(before, "\n", -1)) + 1
    return F.when((at >= 0) & (at <= F.length(text)), F.struct(line.alias("line"), column.alias("column")))


def merge_ranges(ranges: Column) -> Column:
    """Disjoint ranges (start, end) in order; overlapping and touching ones become one."""
    kind = "struct<start:int,end:int>"
    plain = F.array_sort(F.transform(ranges, lambda r: F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end"))))

    def take(last: Column, r: Column) -> tuple[Column, Column]:
        joins = F.coalesce(r["start"] <= last["end"], F.lit(False))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when(joins, wider).otherwise(r), F.when(joins | last.isNull(), none_of(kind)).otherwise(F.array(last))

    done = scan(plain, F.lit(None).cast(kind), take, kind)
    return let(done, lambda d: F.concat(d["out"], F.when(d["state"].isNull(), none_of(kind)).otherwise(F.array(d["state"]))))


def usable(text: Column, findings: Column) -> Column:
    """Ranges of findings that lie in the text."""
    inside = lambda n: F.filter(findings, lambda v: (v.original_start >= 0) & (v.original_start < v.original_end) & (v.original_end <= n))
    return F.transform(let(F.length(text), inside), lambda v: F.struct(v.original_start.alias("start"), v.original_end.alias("end")))


def redact_ranges(text: Column, ranges: Column, mark: str = REDACTED) -> Column:
    """Text with each merged range replaced by ``mark``."""
    own = merge_ranges(ranges)

    def kept(rs: Column) -> Column:
        # a place in a string is found from its start on, so a block of ranges is cut from a piece of the text of its own
        n = F.greatest(F.ceil(F.sqrt(F.size(rs))), F.lit(1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(rs) - 1) / n), F.lit(0)).cast("int")), lambda i: F.struct(F.slice(rs, i * n + 1, n).alias("rs"), F.when(i > 0, F.get(rs, i * n - 1)["end"]).otherwise(F.lit(0)).alias("at")))

        def pieces(b: Column) -> Column:
            part = F.substring(text, b["at"] + 1, F.element_at(b["rs"], -1)["end"] - b["at"])

            def cut(t: Column) -> Column:
                return F.transform(b["rs"], lambda r, i: let(F.when(i > 0, F.get(b["rs"], i - 1)["end"]).otherwise(b["at"]), lambda e: F.substring(t, e - b["at"] + 1, r["start"] - e)))

            return let(part, cut)

        tail = F.substring(text, F.element_at(rs, -1)["end"] + 1, F.length(text))
        return F.array_join(F.concat(F.flatten(F.transform(blocks, pieces)), F.array(tail)), mark)

    return let(own, lambda rs: F.when(F.size(rs) == 0, text).otherwise(kept(rs)))


def redact(text: Column, findings: Column, mark: str = REDACTED) -> Column:
    return redact_ranges(text, usable(text, findings), mark)


def redact_pieces(pieces: Column, findings: Column, mark: str = REDACTED) -> Column:
    """Each piece of a text with its part of the findings masked; a mark stands where its range starts, also over several pieces."""
    joined = F.array_join(pieces, "")
    with_starts = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, x: a + F.length(x)).alias("at")))

    def cut(x: Column, ranges: Column) -> Column:
        end = x.at + F.length(x.p)
        own = F.filter(ranges, lambda r: (r["start"] < end) & (r["end"] > x.at))
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def step(acc: Column, r: Column) -> Column:
            s, e = F.greatest(r["start"] - x.at, F.lit(0)), F.least(r["end"], end) - x.at
            marked = F.when(r["start"] >= x.at, F.lit(mark)).otherwise(F.lit(""))
            return F.struct(F.concat(acc["out"], F.substring(x.p, acc["at"] + 1, s - acc["at"]), marked).alias("out"), e.alias("at"))

        return F.aggregate(own, start, step, lambda acc: F.concat(acc["out"], F.substring(x.p, acc["at"] + 1, F.length(x.p))))

    return let(merge_ranges(usable(joined, findings)), lambda ranges: F.transform(with_starts, lambda x: cut(x, ranges)))
