"""MinHash near-dedup by an LSH forest.

A text's set is its distinct shingles of ``width`` words (A-Z in lower case; parted by ASCII white space); with fewer words
the whole sequence is its one shingle, without words the set is empty and links with nothing. Shingles are compared as 64-bit
hashes. Documents whose sets have ``similarity`` percent of their union in common, or more, are linked.

1. One pass makes each document's set size, set digest and ``SIGNATURE`` MinHash values of 16 bits.
2. Equal sets are one class, for which its least doc_id stands from here on.
3. Forest: each of ``TREES`` trees sorts the classes by ``DEPTH`` values of the signature, each tree by others first. What
   stands close in an order shares a long prefix, and the denser a region, the longer: depth adapts by itself. Of the
   ``REACH`` classes before it, a class takes that with the longest common prefix, ``LEAST_DEPTH`` values at least, and of
   equally long ones that with the most equal values.
4. Each class confirms up to ``TRIES`` of these neighbours on the full sets, the best of each of as many parts of all classes, and
   components of these links are found. That makes nearly all of a large group of copies one component without looking at its pairs.
5. What neighbours and the ends of partitions hide is found without a reach: classes that share any of ``BANDS`` prefixes of ``BAND``
   values are one bucket, and in a bucket all pairs of different components meet, however large it is. A pair at 80 %
   shares no such prefix with a probability of 5e-8. Pairs whose sizes allow a link and that have ``LEAST_EQUAL`` equal
   values are candidates: a pair at 80 % has 102 on average, with a deviation of 4.5, so about one in a million has fewer.
6. Candidates are confirmed where they meet, each pair in the first bucket that it shares: the sets of classes that have candidates
   are sent to their buckets, the most alike pairs come first, and pairs that have become connected are passed over. So a
   bucket of n classes gives less than n links, and no table of pairs is made.

Sorts are by range over all trees, so a region of any size is dealt over tasks; only REACH neighbours meet. Buckets are
dealt in blocks of about ``BLOCK`` classes, each pair of blocks to a task; buckets of one component are dropped before. The work
in a bucket grows with the number of its pairs in different components, the rows that move do not.

Nulls: a null text has no words. A document with a null doc_id is kept and links with nothing; its component is null. doc_id
is meant to be unique: repeats of a row get its result, and of rows with one doc_id and several texts the text with the least
hash (xxhash64) stands for the document; the others have set sizes of their own and the document's component. An empty table
gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import staged

SIGNATURE, TREES, DEPTH, STEP, REACH, LEAST_DEPTH, TRIES, LEAST_EQUAL = 128, 24, 16, 5, 32, 3, 6, 80
BANDS, BAND, BLOCK = 32, 4, 4096
BUCKET = "bucket long, band int, i int, j int, own int, id long, component long, n_shingles long, sig binary"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MANY_WORDS = 400_000  # of a worker's word cache, which is emptied then
_ROLL = np.random.default_rng(9)
_A = _ROLL.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _ROLL.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    width: int = 5
    similarity: int = 80


class WordHashes(dict):
    """Hashes of words, kept until there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MANY_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """The text's set as sorted hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    acc = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        acc = mixed(acc * _MIX) + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(acc + np.uint64(n)))


def signature(items: np.ndarray) -> bytes:
    """``SIGNATURE`` least values under as many orders, 16 bits of each, big-endian so that bytes sort as they do."""
    least = np.full(SIGNATURE, ~np.uint64(0))
    for at in range(0, len(items), 4096):
        part = items[at : at + 4096]
        np.minimum(least, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=least)
    return (mixed(least) >> np.uint64(48)).astype(">u2").tobytes()


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest, sig) of every row; the last two are null for empty sets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            sizes, digests, sigs = [], [], []
            for text in b.column("text"):
                items = shingles(text.as_py(), p.width, known)
                sizes.append(len(items))
                digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                sigs.append(signature(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (digests, sigs)]], ["doc_id", "text_key", "n_shingles", "digest", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(each, "doc_id long, text_key long, n_shingles long, digest binary, sig binary")


def forest(classes: DataFrame) -> DataFrame:
    """(key, id): one row for each tree and class, in the trees' orders over all partitions."""
    at = lambda t: (STEP * t % SIGNATURE) * 2 + 1
    twice = F.concat("sig", "sig")
    keys = F.array(*[F.concat(F.lit(bytes([t])), F.substring(twice, at(t), 2 * DEPTH)) for t in range(TREES)])
    rows = classes.select("id", F.explode(keys).alias("key")).select("key", "id")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")


def neighbours(rows: DataFrame) -> DataFrame:
    """(a, b, alike) with a < b: for each row its neighbour before it. ``alike`` orders neighbours by common prefix, then by equal values."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last REACH rows, for what follows
        for b in batches:
            if not b.num_rows:
                continue
            now = np.frombuffer(b"".join(b.column("key").to_pylist()), np.uint8).reshape(b.num_rows, 1 + 2 * DEPTH), np.asarray(b.column("id"))
            old = 0 if held is None else len(held[1])
            key, ids = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            vals = np.ascontiguousarray(key[:, 1:]).view(np.uint16)
            tree = key[:, 0]
            top, other = np.zeros(len(ids), np.int16), np.zeros(len(ids), np.int64)  # best so far, and how far before
            for w in range(1, min(REACH, len(ids) - 1) + 1):
                lo = max(w, old)
                i = np.flatnonzero((tree[lo:] == tree[lo - w : len(ids) - w]) & (vals[lo:, :LEAST_DEPTH] == vals[lo - w : len(ids) - w, :LEAST_DEPTH]).all(axis=1)) + lo
                same = vals[i] == vals[i - w]
                alike = (np.logical_and.accumulate(same, axis=1).sum(axis=1) * (DEPTH + 1) + same.sum(axis=1)).astype(np.int16)
                better = alike > top[i]
                top[i[better]], other[i[better]] = alike[better], w
            i = np.flatnonzero(top)
            j = i - other[i]
            pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), top[i].astype(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b", "alike"])
            held = key[-REACH:], ids[-REACH:]

    return rows.mapInArrow(each, "a long, b long, alike long")


def buckets(classes: DataFrame) -> DataFrame:
    """Rows of BUCKET: ``classes`` in buckets of several components, by (bucket, i, j).

    A bucket is dealt in blocks; ``own`` is the row's block, and i <= j are two blocks that meet, own being one of them."""
    keys = F.array(*[F.struct(F.xxhash64(F.lit(t), F.substring("sig", 2 * BAND * t + 1, 2 * BAND)).alias("bucket"), F.lit(t).alias("band")) for t in range(BANDS)])
    rows = classes.select("id", "component", F.explode(keys).alias("k")).select("id", "component", "k.bucket", "k.band")
    mixed_up = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    some = rows.join(mixed_up.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))).alias("m")
    dealt = some.join(classes.select("id", "n_shingles", "sig"), "id").select("bucket", "band", met, "own", "id", "component", "n_shingles", "sig")
    return in_order(dealt.select("bucket", "band", "m.i", "m.j", "own", "id", "component", "n_shingles", "sig"))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")


@dataclass
class Bucket:
    """The classes of one (bucket, i, j)."""

    band: int
    meets: bool  # blocks i and j are one: all pairs meet; otherwise those across
    own: np.ndarray
    ids: np.ndarray
    comps: np.ndarray
    sizes: np.ndarray
    sigs: np.ndarray

    def candidates(self, similarity: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, equal): places of pairs in different components that may be linked and share no earlier bucket."""
        for w in range(1, len(self.ids)):
            i = np.flatnonzero(self.comps[w:] != self.comps[:-w]) + w
            i = i[100 * np.minimum(self.sizes[i], self.sizes[i - w]) >= similarity * np.maximum(self.sizes[i], self.sizes[i - w])]
            if not self.meets:
                i = i[self.own[i] != self.own[i - w]]
            if len(i):
                same = self.sigs[i] == self.sigs[i - w]
                equal = same.sum(axis=1)
                pick = equal >= LEAST_EQUAL
                before = same[pick, : BAND * self.band].reshape(int(pick.sum()), self.band, BAND)
                pick[pick] = ~before.all(axis=2).any(axis=1)
                yield i[pick], i[pick] - w, equal[pick]


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Bucket, pa.Table]]:
    """Buckets with their rows, of rows that come in their order."""

    def made(rows: pa.Table) -> tuple[Bucket, pa.Table]:
        number = lambda c: rows.column(c).to_numpy()
        sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(rows.num_rows, SIGNATURE)
        return Bucket(int(number("band")[0]), number("i")[0] == number("j")[0], number("own"), number("id"), number("component"), number("n_shingles"), sigs), rows

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        place = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")], axis=1)
        starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)])
        for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
            if held and (place[s] != last).any():
                yield made(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(s, e - s))
            last = place[s]
    if held:
        yield made(pa.Table.from_batches(held))


def active(rows: DataFrame, p: Params) -> DataFrame:
    """The ``rows`` of BUCKET whose class has candidates there."""
    similarity = p.similarity

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in by_bucket(batches):
            some = np.zeros(own.num_rows, bool)
            for a, b, _ in bucket.candidates(similarity):
                some[a] = some[b] = True
            if some.any():
                yield from own.filter(pa.array(some)).to_batches()

    return rows.mapInArrow(each, BUCKET)


def linked_exactly(u: np.ndarray, v: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets have ``similarity`` percent of their union in common."""
    u, v = (u, v) if len(u) >= len(v) else (v, u)
    both = int((u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v).sum())
    return both > 0 and 100 * both >= similarity * (len(u) + len(v) - both)


def settled(rows: DataFrame, p: Params) -> DataFrame:
    """(u, v): pairs of components with linked classes, of ``rows`` of BUCKET with their sets as ``items``; enough to connect all that are."""
    similarity = p.similarity

    def links(bucket: Bucket, sets: pa.ChunkedArray) -> list[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        def take(pairs: list) -> None:
            a, b, equal = (np.concatenate(x) for x in zip(*pairs, strict=True))
            for k in np.argsort(-equal, kind="stable").tolist():
                i, j = a[k], b[k]
                u, v = find(int(bucket.comps[i])), find(int(bucket.comps[j]))
                if u != v and linked_exactly(items[i], items[j], similarity):
                    root[max(u, v)] = min(u, v)
                    found.append((u, v))

        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets]
        found: list[tuple[int, int]] = []
        held, n = [], 0
        for pairs in bucket.candidates(similarity):
            held.append(pairs)
            n += len(pairs[0])
            if n > 1_000_000:
                take(held)
                held, n = [], 0
        if held:
            take(held)
        return found

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in by_bucket(batches):
            found = links(bucket, own.column("items"))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    return rows.mapInArrow(each, "u long, v long")


def confirmed(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The (a, b) of ``pairs`` that are linked by their full sets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sets, held = WordHashes(), OrderedDict(), 0

        def items(i: int, text: pa.StringScalar) -> np.ndarray:
            nonlocal held
            if i in sets:
                sets.move_to_end(i)
                return sets[i]
            own = sets[i] = shingles(text.as_py(), p.width, known)
            held += len(own)
            while held > 4_000_000 and len(sets) > 2:
                held -= len(sets.popitem(last=False)[1])
            return own

        for b in batches:
            ends = zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("text_a"), b.column("text_b"), strict=True)
            mask = pa.array([linked_exactly(items(a, x), items(c, y), p.similarity) for a, c, x, y in ends], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(each, "a long, b long")


def relabelled(rows: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """``column`` replaced by its component in ``groups``, where it has one."""
    on = groups.select(F.col("id").alias("_id"), F.col("component").alias("_to"))
    return rows.join(on, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_to", column)).drop("_id", "_to")


def texts_of(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the classes in ``ids`` (id)."""
    wanted = classes.join(ids, "id", "left_semi").select("id", F.col("text_key").alias("_key"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_own"))
    found = rows.join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("_own") == F.col("_key"))).select("id", "text")
    return staged(found.dropDuplicates(["id"]), "texts")


def sets_of(texts: DataFrame, p: Params) -> DataFrame:
    """(id, items): the sets of ``texts`` (id, text), as sorted 64-bit hashes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array([shingles(t.as_py(), p.width, known).tobytes() for t in rows.column("text")], pa.binary())], ["id", "items"])

    return texts.mapInArrow(each, "id long, items binary")


def classes_of(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``sigs`` with the digest of the text that stands for the document, classes (id, text_key, digest, sig, n_shingles))."""
    own = F.struct("text_key", "digest")
    several = sigs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi"), F.min(own).alias("first"))
    several = staged(several.where("lo <> hi").select(F.col("doc_id").alias("_id"), "first"), "several")
    rows = sigs.join(several, F.col("doc_id") == F.col("_id"), "left")
    stands = F.col("first").isNull() | (F.col("first.text_key") == F.col("text_key"))
    named = rows.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull() & stands)
    least = F.min(F.struct("doc_id", "text_key")).alias("m")
    classes = named.groupBy("digest").agg(least, *[F.first(c).alias(c) for c in ("sig", "n_shingles")]).select(F.col("m.doc_id").alias("id"), F.col("m.text_key").alias("text_key"), "digest", "sig", "n_shingles")
    return rows.withColumn("digest", F.when(F.col("first").isNull(), F.col("digest")).otherwise(F.col("first.digest"))), staged(classes, "classes")


def linked(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``; doc_id must be whole numbers."""
    sigs, classes = classes_of(staged(signatures(docs, p), "signatures"))
    first = staged(neighbours(forest(classes.select("id", "sig"))), "pairs")
    ends = first.select(F.col("a").alias("id"), "b", "alike").unionByName(first.select(F.col("b").alias("id"), F.col("a").alias("b"), "alike"))
    part = F.pmod(F.xxhash64("b"), F.lit(TRIES)).alias("part")
    best = ends.groupBy("id", part).agg(F.max(F.struct("alike", (-F.col("b")).alias("m"))).alias("x")).select("id", (-F.col("x.m")).alias("other"))
    tried = staged(best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "best")
    ids = tried.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = staged(confirmed(tried, texts_of(docs, classes, ids), p), "confirmed")
    groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    again = staged(relabelled(classes.select("id", "sig", "n_shingles", F.col("id").alias("component")), "component", groups), "again")
    some = staged(active(buckets(again), p), "active")
    sets = staged(sets_of(texts_of(docs, classes, some.select("id").distinct()), p), "sets")
    more = components(staged(settled(in_order(some.join(sets, "id").select(*some.columns, "items")), p), "settled"))
    component_of = classes.select("digest", F.col("id").alias("component"))
    for found in (groups, more):
        component_of = relabelled(component_of, "component", found)
    with_class = sigs.select("doc_id", "n_shingles", "digest").join(component_of, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return with_class.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
