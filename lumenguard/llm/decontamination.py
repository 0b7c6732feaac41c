"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. For
windows of L words, k-grams have k = (L + 1) // 2 words, and of every w = L - k + 1 consecutive k-grams the least hash is
a fingerprint. A window holds exactly w k-grams, so the same window anywhere selects the same fingerprint: no shared
window is missed. Steps:

1. Benchmark: windows, and fingerprints for each window length in use (at most ``span`` lengths).
2. Each text, in its row: k-gram hashes are looked up in a bit table of the fingerprints; only where one hits are the
   selected k-grams worked out. Hits are extended to the windows around them, which must be in a second bit table, of
   window hashes. What is left, overlapping windows put together, are the text's runs. Nearly all texts have none.
3. Runs are compared once for each distinct run, however many texts share it: its fingerprints are joined with the benchmark's,
   and windows around those that meet are compared by their words, so the answer is exact and the bit tables only save work.
4. Results go back to the texts by run.

The bit tables have 16 bits for each entry and at most ``MOST_BITS`` bits; beyond, they let more pass and nothing else changes.

Nulls: a null text or item text has no words. A null item_id counts as no item, but its windows hit. Rows with equal doc_id
and equal words are one document in the result. An empty benchmark hits nothing; empty documents give an empty result.
Other columns don't matter. Work in a row is linear in the length of the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import staged
from .text import NOT_ALNUM, let, lower_az, words

SPAN = 13
MOST_BITS = 1 << 22


def texts_at(ws: Column, starts: Column, size: int | Column) -> Column:
    """For each start (from 0), ``size`` words of ``ws`` with a space between."""
    return F.transform(starts, lambda s: F.array_join(F.slice(ws, s + 1, size), " "))


def as_spans(starts: Column, size: int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("s"), (s + size).alias("e")))


def least_hash(ws: Column, size: int) -> Column:
    """The fingerprint of a window of ``size`` words."""
    k = gram(size)
    return let(grams(ws, k), lambda g: F.array_min(F.slice(g, 1, size - k + 1)))


def item_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_id, size, window): distinct windows as words with a space between."""
    items = benchmark.select("item_id", words(lower_az(F.col("text")), NOT_ALNUM).alias("ws")).where(F.size("ws") > 0)
    sized = items.select("item_id", "ws", F.least(F.size("ws"), F.lit(span)).alias("size"))
    starts = F.sequence(F.lit(0), F.size("ws") - F.col("size"))
    each = sized.select("item_id", "size", F.explode(texts_at(F.col("ws"), starts, F.col("size"))).alias("window"))
    return each.distinct()


def gram(size: int) -> int:
    return (size + 1) // 2


def grams(ws: Column, k: int) -> Column:
    """Hashes of the k-grams of ``ws``."""
    return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (k - 1), F.lit(0))), lambda w, i: F.xxhash64(F.slice(ws, i + 1, k)))


def bit_table(hashes: DataFrame, entries: int) -> Column:
    """A constant array of longs with a bit set for each value of column ``h``; the driver gets ``MOST_BITS`` bits at most."""
    longs = 16
    while longs * 64 < min(MOST_BITS, 16 * entries):
        longs *= 2
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    word = F.call_function("shiftright", F.col("h"), F.lit(6)).bitwiseAND(longs - 1)
    bits = [0] * longs
    for r in hashes.groupBy(word.alias("at")).agg(F.bit_or(bit).alias("bits")).collect():
        bits[r["at"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")  # folded to a literal array


def has_bit(bits: Column, h: Column) -> Column:
    word = F.get(bits, F.call_function("shiftright", h, F.lit(6)).bitwiseAND(F.size(bits) - 1).cast("int"))
    return F.call_function("shiftright", word, h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def candidate_starts(ws: Column, size: int, prints: Column, windows: Column) -> Column:
    """Starts (from 0) of the windows of ``size`` words that may be a benchmark's."""
    k = gram(size)
    w = size - k + 1

    def extended(g: Column, hits: Column) -> Column:
        last = F.size(g) - w  # of the starts of windows
        around = lambda p: F.sequence(F.greatest(p - (w - 1), F.lit(0)), F.least(p, last))
        chosen = F.filter(hits, lambda p: F.exists(around(p), lambda s: F.array_min(F.slice(g, s + 1, w)) == F.get(g, p)))
        starts = F.array_distinct(F.flatten(F.transform(chosen, around)))
        return F.sort_array(F.filter(starts, lambda s: has_bit(windows, F.xxhash64(F.array_join(F.slice(ws, s + 1, size), " ")))))

    def looked_up(g: Column) -> Column:
        at = F.filter(F.transform(g, lambda h, p: F.when(has_bit(prints, h), p)), lambda p: p.isNotNull())
        none = F.array().cast("array<int>")
        return let(at, lambda hits: F.when((F.size(hits) == 0) | (F.size(g) < w), none).otherwise(extended(g, hits)))

    return let(grams(ws, k), looked_up)


def runs(ws: Column, spans: Column) -> Column:
    """Texts of the runs that the sorted ``spans`` (s, e) of words cover together."""
    start = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"))
    open_ = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("done"), start.alias("now"))

    def take(acc: Column, x: Column) -> Column:
        longer = F.struct(acc["done"].alias("done"), F.struct(acc["now"]["s"].alias("s"), F.greatest(acc["now"]["e"], x["e"]).alias("e")).alias("now"))
        other = F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), F.struct(x["s"].alias("s"), x["e"].alias("e")).alias("now"))
        return F.when(x["s"] <= acc["now"]["e"], longer).otherwise(other)

    parts = F.aggregate(spans, open_, take, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    return F.transform(F.filter(parts, lambda r: r.s >= 0), lambda r: F.array_join(F.slice(ws, r.s + 1, r.e - r.s), " "))


def printed(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """``windows`` (with size and window) and the fingerprint of each as ``print``."""
    parts = [windows.where(F.col("size") == size).withColumn("print", least_hash(F.split("window", " "), size)) for size in sizes]
    return reduce(DataFrame.unionByName, parts)


def run_results(distinct_runs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(run, n_hit, items) of the runs with a benchmark's window in them.

    Fingerprints of runs are joined with the benchmark's; where one meets, the windows that selected it are compared by their words."""
    split = distinct_runs.select("run", F.split("run", " ").alias("ws"))
    parts = []
    for size in sizes:
        starts = F.sequence(F.lit(0), F.size("ws") - size)
        each = F.posexplode(texts_at(F.col("ws"), starts, size)).alias("s", "window")
        parts.append(split.where(F.size("ws") >= size).select("run", each).withColumn("size", F.lit(size)))
    prints = printed(windows, sizes).select("size", "print").distinct()
    rows = printed(reduce(DataFrame.unionByName, parts), sizes).join(prints, ["size", "print"], "left_semi")
    own = windows.groupBy("size", "window").agg(F.collect_set("item_id").alias("items"))
    hits = rows.join(own, ["size", "window"])
    spans = F.sort_array(F.collect_list(F.struct("s", (F.col("s") + F.col("size")).alias("e"))))
    found = hits.groupBy("run").agg(spans.alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    grown = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["e"]), F.lit(0))).alias("n"), F.greatest(a["e"], x["e"]).alias("e")),
        lambda a: a["n"],
    )
    return found.select("run", grown.alias("n_hit"), "items")


def words_key(text: Column) -> Column:
    return F.sha2(F.array_join(words(lower_az(text), NOT_ALNUM), " "), 256)


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, percent: int = 5) -> DataFrame:
    """(doc_id, words_key, n_words, n_hit, items, contaminated): hit words, sorted item ids as strings; contaminated from ``percent`` of the words on."""
    windows = staged(item_windows(benchmark, span), "windows")
    sizes = sorted(r.size for r in windows.select(F.col("size").alias("size")).distinct().collect())  # span of them at most
    split = docs.select("doc_id", words(lower_az(F.col("text")), NOT_ALNUM).alias("ws"))
    key = F.sha2(F.array_join("ws", " "), 256).alias("words_key")
    n_words = F.size("ws").cast("long").alias("n_words")
    if not sizes:
        none = F.lit(0).cast("long")
        return split.select("doc_id", key, n_words, none.alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated")).distinct()
    spans = []
    for size in sizes:
        own = windows.where(F.col("size") == size)
        entries = own.count()
        prints = bit_table(own.select(least_hash(F.split("window", " "), size).alias("h")), entries)
        table = bit_table(own.select(F.xxhash64("window").alias("h")), entries)
        starts = candidate_starts(F.col("ws"), size, prints, table)
        spans.append(as_spans(starts, size))
    together = F.sort_array(F.concat(*spans)) if len(spans) > 1 else spans[0]
    hit = split.select("doc_id", "ws", together.alias("spans"))
    some = F.size("spans") > 0
    text_runs = F.when(some, runs(F.col("ws"), F.col("spans"))).otherwise(F.array().cast("array<string>"))
    rows = staged(hit.select("doc_id", key, n_words, text_runs.alias("runs")), "runs")

    each = rows.where(F.size("runs") > 0).select("doc_id", "words_key", F.posexplode("runs").alias("at", "run"))
    results = run_results(each.select("run").distinct(), windows, sizes)
    by_doc = each.join(results, "run").select("doc_id", "words_key", "at", "n_hit", "items").distinct()
    items = F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("items")), lambda x: x.cast("string"))))
    hits = by_doc.groupBy("doc_id", "words_key").agg(F.sum("n_hit").alias("n_hit"), items.alias("items"))
    left = rows.select("doc_id", "words_key", "n_words").distinct()
    hits = hits.select(F.col("doc_id").alias("h_id"), F.col("words_key").alias("h_key"), "n_hit", "items")
    both = left.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("words_key") == F.col("h_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return both.select(
        "doc_id",
        "words_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"),
    )
