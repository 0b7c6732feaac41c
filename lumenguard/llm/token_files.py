"""Token ids in ORC files.

Documents are dealt by ranges of doc_id, sorted within them and encoded; each range is one file, so files follow one another in
ascending doc_id. A row is (doc_id, part, local_start, n_tokens, ids). ORC stores the integers run-length encoded in stripes of
``STRIPE`` bytes, keeps the least and greatest doc_id of each stripe and of every ``ROW_GROUP`` rows, and a Bloom filter of doc_id for
each such group: readers split files by stripe, and a lookup of ids reads only groups that may have them.

Encoding gives the tokenizers library distinct words only: the tokenizer's own splitting drops white space, so a text's ids are
those of its pieces between ASCII white space, one after another. Pieces of printable ASCII and Latin-1 letters are split here, by the
tokenizer's rule, which for them needs no tables of Unicode, and distinct parts go to the library's BPE model, many in one call. Other distinct pieces go to
the whole tokenizer, parted by a character that is one token of its own; pieces with that character in them go alone. A worker keeps the
ids of pieces for later texts and tasks: of twice ``MOST_PIECES`` at most, those used last. A tokenizer of another make than the rule's goes
without the short way.

Nulls: a null text is empty: it has the end id only. Null ids come first. Rows with equal doc_id follow in no set order
but by text. An empty table gives no rows. Columns other than doc_id and text don't matter. A document's ids are one row, so a text may be of any
length that fits a row.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import new_path

STRIPE, ROW_GROUP, BLOOM_FPP = 16 << 20, 1_000, 0.01
MOST_PIECES, SLICE_BYTES, BLOCK, PARTS = 350_000, 8_000_000, 1_000, 20_000
MARK = "\x01"
#: The tokenizer's splitting rule as its file has it, and the same for the lower-case characters of ``PLAIN``.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_RULE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
LETTERS = "".join(chr(c) for c in range(0x61, 0x100) if chr(c).islower() and PLAIN.fullmatch(chr(c)))
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
LETTERS_ONLY = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_ENCODERS: dict[int, WordEncoder] = {}  # a worker's, by tokenizer


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the others follow from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Ids of texts as little-endian 32-bit integers, by a tokenizer that drops white space and never joins across it."""

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        mark = self.ids([MARK])[0]
        self.mark = int(np.frombuffer(mark, "<u4")[0]) if len(mark) == 4 else None
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # pieces known but not used since ``known`` was last full
        self.parts: dict[str, bytes] = {}
        own = json.loads(tokenizer_json)
        kinds = [x["type"] for x in (own["normalizer"] or {}).get("normalizers", [])]
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and RULE in json.dumps(own["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self.letters = byte_letters()
        # the same model for words with spaces between; a word's last token is one that ends a word
        self.model = Tokenizer.from_str(json.dumps(own | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        vocab, suffix = own["model"]["vocab"], own["model"].get("end_of_word_suffix") or "\0"
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def learn_parts(self, parts: list[str]) -> None:
        if len(self.parts) + len(parts) > MOST_PIECES:
            self.parts.clear()
        for at in range(0, len(parts), PARTS):
            block = parts[at : at + PARTS]
            words = [p if p.isascii() else "".join(self.letters[b] for b in p.encode()) for p in block]
            ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(cuts) == len(block):
                raw = ids.tobytes()
                self.parts.update((p, raw[s:e]) for p, s, e in zip(block, [0, *cuts], cuts, strict=False))
            else:
                self.parts.update((p, np.array([t.id for t in self.tokenizer.model.tokenize(w)], "<u4").tobytes()) for p, w in zip(block, words, strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        short = [p for p in pieces if "<|" not in p and PLAIN.fullmatch(p)] if self.plain else []
        split = [PLAIN_RULE.findall(p.lower()) for p in short]
        for _ in range(2):  # what was known may be forgotten for new ones
            self.learn_parts(list({x for parts in split for x in parts if x not in self.parts}))
        self.known.update((p, b"".join(map(self.parts.__getitem__, parts))) for p, parts in zip(short, split, strict=True))
        other = [p for p in pieces if p not in self.known] if len(short) < len(pieces) else []
        alone = [p for p in other if MARK in p or self.mark is None]
        rest = [p for p in other if MARK not in p and self.mark is not None]
        self.known.update(zip(alone, self.ids(alone), strict=True))
        for at in range(0, len(rest), BLOCK):
            block = rest[at : at + BLOCK]
            found = np.frombuffer(self.ids([f" {MARK} ".join(block)])[0], "<u4")
            ends = np.flatnonzero(found == self.mark)
            if len(ends) != len(block) - 1:  # the mark came up inside a piece after all
                self.known.update(zip(block, self.ids(block), strict=True))
                continue
            raw, cuts = found.tobytes(), [-4, *(4 * ends).tolist(), 4 * len(found)]
            self.known.update((p, raw[s + 4 : e]) for p, s, e in zip(block, cuts, cuts[1:], strict=False))

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        fresh = [p for p in pieces if p not in self.known]
        if len(self.known) + len(fresh) > MOST_PIECES:
            self.before, self.known = self.known, {}
            fresh = pieces
        again = [p for p in fresh if p in self.before]
        self.known.update((p, self.before[p]) for p in again)
        self.learn([p for p in fresh if p not in self.before] if again else fresh)
        return list(map(self.known.__getitem__, pieces))

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids of all, one after another) of distinct pieces. Letters with marks after them are two parts, told apart by Arrow."""
        bare = pc.utf8_rtrim(pieces, characters=MARKS)
        simple = pc.match_substring_regex(bare, LETTERS_ONLY) if self.plain else pa.array(np.zeros(len(pieces), bool))
        low = pc.utf8_lower(pieces.filter(simple))
        cores, tails = pc.utf8_rtrim(low, characters=MARKS).dictionary_encode(), pc.utf8_ltrim(low, characters=LETTERS).dictionary_encode()
        parts = [*cores.dictionary.to_pylist(), *tails.dictionary.to_pylist()]
        for _ in range(2):  # what was known may be forgotten for new ones
            self.learn_parts([p for p in dict.fromkeys(parts) if p and p not in self.parts])
        self.parts[""] = b""
        found = [*map(self.parts.__getitem__, parts), *self.ids_of(pieces.filter(pc.invert(simple)).to_pylist())]
        n, where = len(cores.dictionary), simple.to_numpy(zero_copy_only=False)
        two = np.full((len(pieces), 2), len(found))  # the last is none
        two[where, 0], two[where, 1] = cores.indices.to_numpy(), n + tails.indices.to_numpy()
        two[~where, 0] = len(parts) + np.arange(len(found) - len(parts))
        sizes = np.fromiter(map(len, [*found, b""]), np.int64, len(found) + 1) // 4
        ids, _ = gathered(np.frombuffer(b"".join(found), "<i4"), sizes, two.ravel())
        return sizes[two].sum(axis=1), ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each text has, the ids of all). Python sees each distinct part once; texts are split and put together by Arrow and numpy."""
        split = pc.ascii_split_whitespace(texts)  # white space that every part of the tokenizer takes for such
        words = split.flatten().dictionary_encode()
        sizes, flat = self.distinct(words.dictionary)
        ids, ends = gathered(flat, sizes, words.indices.to_numpy())
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        return np.diff(ends[offsets]), ids


def gathered(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what the lists ``at`` hold, one after another, and where each begins and ends); ``flat`` has all lists, of ``sizes``."""
    starts, own = np.cumsum(sizes) - sizes, sizes[at]
    ends = np.concatenate([[0], np.cumsum(own)])
    return flat[np.repeat(starts[at] - ends[:-1], own) + np.arange(ends[-1])], ends


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to) of rows with about ``SLICE_BYTES`` bytes together, one row at least."""
    until = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(until):
        before = until[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(until, before + SLICE_BYTES)))
        yield at, to
        at = to


def worker_encoder(tokenizer_json: str) -> WordEncoder:
    """One for all tasks of a worker process."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(tokenizer_json)
    return _ENCODERS[key]


def write(docs: DataFrame, tokenizer_json: str, end_id: int, path: str, parts: int) -> None:
    """Encode the texts of ``docs`` and write them to ``path`` in ``parts`` files at most, in ascending doc_id."""
    names = ["doc_id", "part", "local_start", "n_tokens", "ids"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = worker_encoder(tokenizer_json), 0
        for b in batches:
            for at, to in slices(b.column("text")):
                rows = b.slice(at, to - at)
                sizes, ids = encoder.encode(rows.column("text"))
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                sizes = sizes + 1
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), pa.array(starts), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(each, f"doc_id {kind}, part int, local_start long, n_tokens long, ids array<int>")
    options = {"orc.stripe.size": STRIPE, "orc.create.index": "true", "orc.row.index.stride": ROW_GROUP, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": BLOOM_FPP, "compression": "zstd"}
    rows.write.options(**{k: str(v) for k, v in options.items()}).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files with ``start``, the ids of all documents before. Files are summed first: one row for each of them is ordered."""
    rows = spark.read.orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = sums.select("part", before.alias("before"))
    return rows.join(offsets, "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Rows of some documents; stripes and row groups without them are skipped by their indexes."""
    return spark.read.orc(path).where(F.col("doc_id").isin(ids))


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``read``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            raw, offsets = np.asarray(ids.values).astype("<u4").tobytes(), (4 * np.asarray(ids.offsets, np.int64)).tolist()
            crcs = [zlib.crc32(raw[s:e]) for s, e in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(np.array(offsets)) // 4, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "ids").mapInArrow(each, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def file_count(docs: DataFrame) -> int:
    """One file for each shuffle partition, which the session sizes to its data."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def written_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    path = new_path(docs.sparkSession, "tokens")
    write(docs, tokenizer_json, end_id, path, file_count(docs))
    return digests(read(docs.sparkSession, path))
