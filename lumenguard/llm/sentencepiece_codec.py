"""SentencePiece BPE encoding by suffix-array matching, and decoding.

A batch's texts are cut before every run of spaces: no piece of the model has a space after another character, so merges
never cross a cut. Distinct parts are put one after another and indexed by a suffix array (in the order of their first
characters, as many as the longest piece has). Binary search finds, for every piece, its range in the array, that is all its occurrences.
These are edges from a start to an end; they are placed by position in a table of start and length. Relaxing goes
by the model's rule: a part begins as its characters, and of all edges that join two neighbouring tokens the one with the
best score is taken, the leftmost of equals, until none is left. A BPE model does not ask for the best path over the edges, so a shortest-path
relaxation would give other ids than the library; this order gives the same. Parts of one length are relaxed together.
Characters that are no piece become their UTF-8 bytes' pieces.

Parts seen before are kept for later batches in a table of ``MOST_PARTS``; it is emptied when full. A batch is worked off in
slices of ``SLICE_CHARS`` characters and its new parts in blocks of ``BLOCK_CHARS`` (or one that is longer), which bounds memory.

Decoding joins the pieces' bytes, turns the space mark into a space, drops the space that encoding puts first, and replaces
malformed bytes by U+FFFD.

Nulls: a null text has null ids, and null ids decode to null. An empty text has no ids. The space mark itself in a text decodes to
a space. Repeated rows are encoded each. An empty table gives an empty result. Columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
NONE = 0xFFFF
MOST_PARTS, BLOCK_CHARS, SLICE_CHARS, LONG_PART = 600_000, 600_000, 4_000_000, 48


@dataclass(frozen=True)
class Model:
    """Pieces by id, their scores, and ids of the byte pieces in order."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]
    unk_id: int


def load_model(path: str) -> Model:
    """Read on the driver; tasks get it with the code. Fit for BPE models with an identity normaliser and a space put first."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or len(m.pieces) >= NONE:
        raise ValueError(f"{path}: not a BPE model with an identity normaliser, a dummy prefix and under {NONE} pieces")
    if any(SPACE in p.piece.lstrip(SPACE) for p in m.pieces if p.type == 1):
        raise ValueError(f"{path}: has a piece with a space inside")
    by_byte = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 6}
    byte_ids = [by_byte.get(f"<0x{b:02X}>", m.trainer_spec.unk_id) for b in range(256)]
    return Model([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type == 1 for p in m.pieces], byte_ids, m.trainer_spec.unk_id)


def cut(text: str) -> list[str]:
    """Parts of a text as the model sees it: a run of space marks and what follows up to the next."""
    if not text:
        return []
    words = text.replace(SPACE, " ").split(" ")
    if "" not in words:
        return words
    parts, lead = [], ""
    for i, w in enumerate(words):
        if w:
            parts.append(lead + w)
            lead = ""
        elif i < len(words) - 1:
            lead += SPACE
        else:
            parts.append(lead)
    return parts


class Encoder:
    """Ids of parts; a part's first space mark is left out of its name here, since every part has one."""

    def __init__(self, model: Model) -> None:
        self.model = model
        ids = [i for i, ok in enumerate(model.normal) if ok]
        order = {s: k for k, s in enumerate(sorted({model.scores[i] for i in ids}, reverse=True))}
        self.rank = np.full(NONE + 1, NONE, np.int32)
        self.rank[ids] = [order[model.scores[i]] for i in ids]
        self.ids = np.array(ids, np.uint16)
        self.lengths = np.array([len(model.pieces[i]) for i in ids], np.int64)
        self.depth = int(self.lengths.max())
        self.chars = np.zeros((len(ids), self.depth), np.uint32)
        for k, i in enumerate(ids):
            self.chars[k, : self.lengths[k]] = np.frombuffer(model.pieces[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        self.known: dict[str, bytes] = {}

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """Table of ids by start and length in ``codes``, where parts end with a 0; NONE where no piece is."""
        alphabet, text = np.unique(codes, return_inverse=True)  # 0 comes first
        text = text.astype(">u2") if len(alphabet) < NONE else text.astype(">u4")
        wide = np.zeros(len(text) + self.depth, text.dtype)
        wide[: len(text)] = text
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, self.depth)[: len(text)])
        width = self.depth * text.dtype.itemsize
        bits = np.pad(suffixes.view(np.uint8).reshape(len(text), width), ((0, 0), (0, -width % 8))).view(">u8").astype(np.uint64)
        array = np.lexsort(bits.T[::-1])
        names = suffixes.view(f"S{width}").ravel()[array]

        at = np.minimum(np.searchsorted(alphabet, self.chars), len(alphabet) - 1)
        inside = np.arange(self.depth)[None, :] < self.lengths[:, None]
        usable = np.flatnonzero(((alphabet[at] == self.chars) | ~inside).all(axis=1))
        low = np.where(inside, at, 0)[usable].astype(text.dtype)
        high = np.where(inside, at, np.iinfo(text.dtype).max)[usable].astype(text.dtype)
        lo = np.searchsorted(names, np.ascontiguousarray(low).view(f"S{width}").ravel(), "left")
        hi = np.searchsorted(names, np.ascontiguousarray(high).view(f"S{width}").ravel(), "right")

        n = hi - lo
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        table = np.full((len(text), self.depth + 1), NONE, np.uint16)
        table[array[where], np.repeat(self.lengths[usable], n)] = np.repeat(self.ids[usable], n)
        return table

    def spelled(self, table: np.ndarray, bounds: list[int], codes: np.ndarray) -> bytes:
        """Ids between ``bounds``, characters without a piece as bytes."""
        out: list[int] = []
        for s, e in zip(bounds, bounds[1:], strict=False):
            if (i := int(table[s, e - s])) != NONE:
                out.append(i)
            else:
                out += [self.model.byte_ids[b] for b in codes[s:e].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")]
        return np.array(out, "<u4").tobytes()

    def relax_together(self, table: np.ndarray, starts: np.ndarray, n: int, codes: np.ndarray) -> list[bytes]:
        """Ids of the parts of ``n`` characters at ``starts``. All rows still open have lost as many bounds, so they stay a table."""
        out: list[bytes] = [b""] * len(starts)
        rows, bounds = np.arange(len(starts)), starts[:, None] + np.arange(n + 1)[None, :]
        wide = table.shape[1]

        def rank(s: np.ndarray, e: np.ndarray) -> np.ndarray:
            n = e - s
            return np.where(n < wide, self.rank[table[s, np.minimum(n, wide - 1)]], NONE)

        ranks = rank(bounds[:, :-2], bounds[:, 2:])
        while len(rows):
            r = np.arange(len(rows))
            j = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            done = ranks[r, j] == NONE if ranks.shape[1] else np.ones(len(rows), bool)
            if done.any():
                own = bounds[done]
                ids = table[own[:, :-1], np.minimum(own[:, 1:] - own[:, :-1], wide - 1)]
                plain = (ids != NONE).all(axis=1)
                packed = ids.astype("<u4")
                for k, row in enumerate(rows[done].tolist()):
                    out[row] = packed[k].tobytes() if plain[k] else self.spelled(table, own[k].tolist(), codes)
                rows, bounds, ranks, j = rows[~done], bounds[~done], ranks[~done], j[~done]
                r = np.arange(len(rows))
            if not len(rows):
                break
            left = np.ones(bounds.shape, bool)
            left[r, j + 1] = False
            bounds = bounds[left].reshape(len(rows), -1)
            left = np.ones(ranks.shape, bool)
            left[r, j] = False
            ranks = ranks[left].reshape(len(rows), -1)
            if before := np.flatnonzero(j > 0).tolist():
                k = j[before] - 1
                ranks[before, k] = rank(bounds[before, k], bounds[before, k + 2])
            if after := np.flatnonzero(j < ranks.shape[1]).tolist():
                k = j[after]
                ranks[after, k] = rank(bounds[after, k], bounds[after, k + 2])
        return out

    def relax_alone(self, table: np.ndarray, start: int, n: int, codes: np.ndarray) -> bytes:
        """The same for one long part, by a heap."""
        end = list(range(1, n + 1)) + [0]
        before = list(range(-1, n))
        alive = [True] * n
        wide = table.shape[1]
        heap: list[tuple[int, int, int]] = []

        def offer(s: int) -> None:
            if s >= 0 and end[s] < n and (e := end[end[s]]) - s < wide and (r := int(self.rank[table[start + s, e - s]])) != NONE:
                heapq.heappush(heap, (r, s, e))

        for s in range(n - 1):
            offer(s)
        while heap:
            _, s, e = heapq.heappop(heap)
            if not alive[s] or end[s] >= n or end[end[s]] != e:
                continue
            alive[end[s]] = False
            end[s] = e
            if e < n:
                before[e] = s
            offer(before[s])
            offer(s)
        return self.spelled(table, [start + s for s in range(n) if alive[s]] + [start + n], codes)

    def learn(self, parts: set[str]) -> None:
        """Put ``parts``, none of them known, into the table of known ones, some ``BLOCK_CHARS`` characters at a time."""
        block, chars = [], 0
        for p in sorted(parts, key=len):
            block.append(p)
            chars += len(p) + 2
            if chars >= BLOCK_CHARS:
                self.learn_block(block)
                block, chars = [], 0
        if block:
            self.learn_block(block)

    def learn_block(self, names: list[str]) -> None:
        """``names`` come by length."""
        joined = "\0".join(SPACE + p.replace("\0", "﷐") for p in names) + "\0"  # a noncharacter stands for NUL, which ends parts here
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        table = self.edges(codes)
        if any("\0" in p or "﷐" in p for p in names):
            table, codes = self.with_nul(table, codes, names)
        sizes = np.array([len(p) + 1 for p in names])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        at = 0
        while at < len(names):
            n = int(sizes[at])
            to = int(np.searchsorted(sizes, n, "right"))
            if n <= LONG_PART:
                found = self.relax_together(table, starts[at:to], n, codes)
            else:
                found = [self.relax_alone(table, int(s), n, codes) for s in starts[at:to]]
            self.known.update(zip(names[at:to], found, strict=True))
            at = to

    @staticmethod
    def with_nul(table: np.ndarray, codes: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes with the real characters back for spelling them as bytes; neither is part of a piece of more characters."""
        real = np.frombuffer("\0".join(SPACE + p for p in names).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)
        return table, real

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids as little-endian 32-bit integers."""
        out: list[bytes | None] = []
        at = 0
        while at < len(texts):
            cuts, chars = [], 0
            while at < len(texts) and (not cuts or chars < SLICE_CHARS):
                chars += len(texts[at] or "")
                cuts.append(None if texts[at] is None else cut(texts[at]))
                at += 1
            fresh = {p for c in cuts if c for p in c if p not in self.known}
            if len(self.known) + len(fresh) > MOST_PARTS:  # all parts of the slice must be known at once
                self.known.clear()
                fresh = {p for c in cuts if c for p in c}
            self.learn(fresh)
            out += [None if c is None else b"".join(map(self.known.__getitem__, c)) for c in cuts]
        return out


class Decoder:
    def __init__(self, model: Model) -> None:
        own = {i: bytes([b]) for b, i in enumerate(model.byte_ids) if i != model.unk_id}
        control = lambda i: not model.normal[i]
        self.bytes = [own[i] if i in own else b" \xe2\x81\x87 " if i == model.unk_id else b"" if control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)]

    def decode(self, ids: bytes | None) -> str | None:
        if ids is None:
            return None
        raw = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) of every row."""
    model = load_model(model_path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for b in batches:
            found = encoder.encode(b.column("text").to_pylist())
            ids = [None if x is None else np.frombuffer(x, "<u4").astype(np.int32) for x in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, ids array<int>")


def decoded(tokens: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of a table with doc_id and ids."""
    model = load_model(model_path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for b in batches:
            texts = [None if x is None else decoder.decode(np.array(x, "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(each, f"doc_id {kind}, text string")


def round_trips(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_crc32, round_trip): of the ids as 32-bit and the decoded text as UTF-8; ids don't leave the worker."""
    model = load_model(model_path)
    names = ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(model), Decoder(model)
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes, crcs, backs, same = [], [], [], []
            for text, ids in zip(texts, encoder.encode(texts), strict=True):
                back = decoder.decode(ids)
                sizes.append(None if ids is None else len(ids) // 4)
                crcs.append(None if ids is None else zlib.crc32(ids))
                backs.append(None if back is None else zlib.crc32(back.encode("utf-8", "surrogatepass")))
                same.append(None if text is None else back == text.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(backs, pa.int64()), pa.array(same, pa.bool_())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
