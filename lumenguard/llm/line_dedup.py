"""Substring dedup by hashing of lines and of what lines are made of.

Whole lines alone miss passages that stand within longer lines, so what is hashed is runs of sentences. A text's pieces are its
lines, parted after sentence ends (``.!?`` before white space); a piece of more than ``LONG`` words is parted again after
each word of a length, in bytes, divisible by five, so that the cuts lie in the words themselves. Units are normalised (A-Z in
lower case, words with one space between) and hashed to 96 bits: from each piece on the least run of pieces with ``min_words``
words, and the least such run up to the end of each line. A line of ``min_words`` words is covered by units of its own, and so is
a repeated passage, wherever it starts and ends; a shorter heading or licence line that stands alone is none.

Of all units with one hash the earliest by (doc_id, position) stays and the rest go, in whatever documents they are; a unit
stays where it overlaps the earliest one. What goes and what stays is returned with its spans in the original text (code
points, ends exclusive); what stays keeps its order, with a line end where something went.

Of each unit 64 bits are counted first, in each task before the shuffle; only units that occur twice or more are kept, and their
occurrences are joined with one row for each, where Spark splits the larger side. So a line in a third of all documents is a few rows
where groups are formed. Texts move once, by document, and only hashes besides.

Nulls: a null text stays null and has no lines. Null ids rank first. Rows with equal doc_id and equal text are one document,
whose own copy does not count; with equal doc_id but other text they are told apart by a hash of the text. An empty table
gives an empty result. Columns other than doc_id and text pass through ``deduplicated``, save those named like its own.
Texts may be of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import staged

MIN_WORDS, LONG, STEP = 20, 40, 5
#: Where one piece ends and the next begins; and white space around a piece.
END = re.compile(r"[.!?]+[ \t\r\v\f]|\n")
SPACE = " \t\n\r\v\f"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^ \t\n\r\v\f]+")
UNITS = "doc_id {id}, text_key long, start long, end long, unit long, more int"
OWN = ["n_lines", "n_words", "n_removed", "n_removed_words", "kept_spans", "removed_spans"]
MOST_WORDS = 400_000  # of a worker's word cache, which is emptied then
#: Odd multipliers of the two polynomials that hash runs of words, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def text_pieces(text: str) -> tuple[list[int], list[int], list[int], list[bool], list[bytes]]:
    """(starts, ends, word counts, whether a line ends, words) of the pieces that have words."""
    starts, ends, counts, line_ends, all_words = [], [], [], [], []
    at = 0
    for stop, closes in [*((m.end(), m.group() == "\n") for m in END.finditer(text)), (len(text), True)]:
        piece = text[at:stop]
        words = piece.encode("utf-8", "surrogatepass").translate(LOWER).split()
        if words:
            all_words += words
            if len(words) <= LONG:
                starts.append(at + len(piece) - len(piece.lstrip(SPACE)))
                ends.append(at + len(piece.rstrip(SPACE)))
                counts.append(len(words))
                line_ends.append(closes)
            else:
                places = [m.span() for m in WORD.finditer(piece)]
                cuts = [i + 1 for i, w in enumerate(words[:-1]) if len(w) % STEP == 0]
                for i, k in zip([0, *cuts], [*cuts, len(words)], strict=True):
                    starts.append(at + places[i][0])
                    ends.append(at + places[k - 1][1])
                    counts.append(k - i)
                    line_ends.append(closes and k == len(words))
        elif closes and line_ends:
            line_ends[-1] = True
        at = stop
    return starts, ends, counts, line_ends, all_words


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)]))[:n]


def text_units(text: str, min_words: int, known: WordHashes) -> tuple[np.ndarray, ...] | None:
    """(start, end, unit, more) of every unit; None if there are none."""
    if len(text) < 2 * min_words - 1:
        return None
    starts, ends, counts, line_ends, words = text_pieces(text)
    if len(words) < min_words:
        return None
    last = np.cumsum(counts)
    first = last - counts
    on = np.searchsorted(last, first + min_words)  # where the least run from each piece ends
    whole = on < len(last)
    closing = np.flatnonzero(np.array(line_ends) & (last >= min_words))
    begins = np.searchsorted(first, last[closing] - min_words, side="right") - 1
    runs = np.unique(np.stack([np.r_[np.flatnonzero(whole), begins], np.r_[on[whole], closing]]), axis=1)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    lo, hi = first[runs[0]], last[runs[1]]
    found = []
    with np.errstate(over="ignore"):
        for base, inverse in zip(BASES, INVERSES, strict=True):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(base, len(h)))])
            x = (sums[hi] - sums[lo]) * powers(inverse, len(h))[lo]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append(x ^ (x >> np.uint64(29)))
            h = h * np.uint64(0x94D049BB133111EB) ^ (h >> np.uint64(32))
    return np.array(starts)[runs[0]], np.array(ends)[runs[1]], found[0].view(np.int64), (found[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def units(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_key, start, end, unit, more): every unit of every text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            at, found = [], []
            for row, text in enumerate(b.column("text")):
                if own := text_units(text.as_py() or "", min_words, known):
                    found.append(own)
                    at.append(np.full(len(own[0]), row))
            if found:
                rows = pa.array(np.concatenate(at))
                columns = [np.concatenate(x) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("text_key").take(rows), *map(pa.array, columns)], ["doc_id", "text_key", "start", "end", "unit", "more"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(each, UNITS.format(id=docs.schema["doc_id"].dataType.simpleString()))


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, gone): the spans of units that go, of documents that have such units."""
    rows = staged(units(docs, min_words), "units")
    again = staged(rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("unit"), "again")  # so that Spark can split the join's larger side
    some = staged(rows.join(again, "unit", "left_semi"), "repeated")
    place = F.struct("doc_id", "start", "text_key", "end")
    first = some.groupBy("unit", "more").agg(F.min(place).alias("f"), F.max(place).alias("l")).where(~F.col("f").eqNullSafe(F.col("l")))
    later = some.join(first.select("unit", "more", "f"), ["unit", "more"]).where(~place.eqNullSafe(F.col("f")))
    own = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("text_key") == F.col("f.text_key"))
    later = later.where(~(own & (F.col("start") < F.col("f.end"))))
    return later.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone"))


def merged(text: str, gone: list[dict]) -> list[tuple[int, int]]:
    """The sorted spans ``gone``, put together where they overlap or have white space between them only."""
    out: list[tuple[int, int]] = []
    for s, e in ((x["start"], x["end"]) for x in gone):
        if out and (s <= out[-1][1] or not text[out[-1][1] : s].strip(SPACE)):
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def left_over(text: str, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of what stays around ``gone``: without the blanks beside it and one line end; an empty line is an empty span."""
    if not gone:
        return [(0, len(text))]
    out = []
    for k, (s, e) in enumerate(zip([0, *(x[1] for x in gone)], [*(x[0] for x in gone), len(text)], strict=True)):
        sides = (k > 0) + (k < len(gone))
        if k:
            while s < e and text[s] in " \t\r":
                s += 1
            if s < e and text[s] == "\n":
                s, sides = s + 1, sides - 1
        if k < len(gone):
            while s < e and text[e - 1] in " \t\r":
                e -= 1
            if s < e and text[e - 1] == "\n":
                e, sides = e - 1, sides - 1
        if s < e or not sides:
            out.append((s, e))
    return out


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text that stays, and what was done: n_lines, n_words (of the original), n_removed (lines with words that went),
    n_removed_words, kept_spans and removed_spans as (start, end). The text is what stands at kept_spans, with line ends between."""
    keep = [c for c in docs.columns if c.lower() not in OWN]
    gone = removals(docs, min_words).select(F.col("doc_id").alias("__lg_id"), F.col("text_key").alias("__lg_gone"), F.col("gone").alias("__lg_spans"))
    keyed = docs.select(*keep).withColumn("__lg_key", F.xxhash64("text"))
    both = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__lg_id")) & (F.col("__lg_key") == F.col("__lg_gone")), "left").drop("__lg_key", "__lg_id", "__lg_gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_spans = lambda x: pa.array([[{"start": s, "end": e} for s, e in y] for y in x], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        for b in batches:
            texts, counts, kept, removed = [], [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("__lg_spans").to_pylist(), strict=True):
                whole = text or ""
                went = merged(whole, spans or [])
                stays = left_over(whole, went) if text is not None else []
                lines = sum(1 + whole[s:e].count("\n") - len(re.findall(r"\n(?=[ \t\r\v\f]*\n)", whole[s:e])) for s, e in went)
                lines -= sum("\n" not in whole[a[1] : b[0]] for a, b in zip(went, went[1:], strict=False))  # parts of one line
                texts.append(None if text is None else whole if not went else "\n".join(whole[s:e] for s, e in stays))
                counts.append((0 if text is None else whole.count("\n") + 1, len(whole.encode("utf-8", "surrogatepass").split()), lines, sum(len(whole[s:e].encode("utf-8", "surrogatepass").split()) for s, e in went)))
                kept.append(stays)
                removed.append(went)
            new = {"text": pa.array(texts, pa.string())}
            columns = [new.get(c, b.column(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x[i] for x in counts], pa.int64()) for i in range(4)], as_spans(kept), as_spans(removed)], [*keep, *OWN])

    span = "array<struct<start:long,end:long>>"
    return both.mapInArrow(cut, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.select(*keep).schema)}, n_lines long, n_words long, n_removed long, n_removed_words long, kept_spans {span}, removed_spans {span}")
