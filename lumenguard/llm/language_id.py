"""Language identification by interpolated Kneser-Ney character language models.

Training takes, for each language, the ``TRAIN_DOCS`` texts with the least hashes of their doc_id, fewer where there
are many languages (``TRAIN_TOTAL`` in all). That bound is a parameter of the classifier; prediction covers all texts. Words are
those between white space, in lower case, words of more than ``LONG_WORD`` characters in pieces, for training as for prediction. They are
counted by language in Spark and come to the driver, which makes the models: for orders 1 to ``ORDER``, sorted arrays of n-gram
hashes with the interpolated log-probability under every language, and of history hashes with the log-weights of backing off. Lower orders count
different left neighbours, as Kneser and Ney have it, and occurrences where an n-gram begins a word, as nothing stands before it. Each order's
discount is n1 / (n1 + 2 n2), from how many n-grams have count 1 and 2. Words are seen with a boundary on both sides, and histories end there.

A text's score under a language is the cross-entropy per character of its words; the lowest wins, and equals go to the language that sorts
first. A tenth of the training texts is kept from counting: on it the sharpness of ``score`` (the winner's share of the
likelihoods after normalising for length) is fitted, and for each language a limit: texts with a higher cross-entropy than ``REJECT_PERCENT`` percent
of its own have are marked rejected. They keep their prediction, as the contract has no other value for texts with letters.

Nulls: null texts and texts without a letter are ``und`` with score 0 and not rejected. Rows with a null language don't train. Without
training rows every text is ``und``. Repeated rows are judged each. Empty tables give an empty result. Other columns don't
matter; neither do lang and doc_id to a prediction. Texts may be of any length: words are looked up one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import staged

ORDER, LEAST_DISCOUNT, MOST_DISCOUNT = 4, 0.1, 0.9
TRAIN_DOCS, TRAIN_TOTAL, REJECT_PERCENT = 600, 4_000, 99
MOST_WORDS, LONG_WORD = 300_000, 64
EDGE = 1  # code of a word's boundary
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` codes that end at each place; the first n - 1 places wrap and are not for use."""
    acc = np.zeros(len(codes), np.uint64)
    for k in range(n - 1, -1, -1):
        acc = (acc ^ np.roll(codes, k).astype(np.uint64)) * _STEP
        acc ^= acc >> np.uint64(29)
    return acc


def laid_out(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words with boundaries, the word of each code and its place in the word."""
    joined = "".join(f"\x01{w}\x01" for w in names)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) + 2 for w in names], np.int64)
    word = np.repeat(np.arange(len(names)), sizes)
    return codes, word, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, weights, len(unique))


def discount_of(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(max(once / max(once + 2 * twice, 1), LEAST_DISCOUNT), MOST_DISCOUNT)


def one_language(names: list[str], counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For orders 1 to ORDER: n-gram hashes, their log-probabilities, history hashes, their log-weights of backing off."""
    codes, word, at = laid_out(names)
    weight = counts[word].astype(float)
    grams = {n: (at >= n - 1) & (at > 0) for n in range(1, ORDER + 1)}  # a first boundary is never predicted
    out, below = [], None
    alphabet = len(np.unique(codes)) + 1
    for n in range(1, ORDER + 1):
        use = grams[n]
        own, history, shorter = hashed(codes, n), np.roll(hashed(codes, n - 1), 1) if n > 1 else np.zeros(len(codes), np.uint64), hashed(codes, n - 1) if n > 1 else None
        if n < ORDER:  # different left neighbours; an n-gram that begins a word has none and is counted
            inner = np.flatnonzero(use & (at >= n))
            first = np.unique(np.stack([own[inner], hashed(codes, n + 1)[inner]]), axis=1, return_index=True)[1]
            begins = np.flatnonzero(use & (at == n - 1))
            pick = np.concatenate([inner[first], begins])
            value = np.concatenate([np.ones(len(first)), weight[begins]])
        else:
            pick = np.flatnonzero(use)
            value = weight[pick]
        keys, c = summed(own[pick], value)
        discount = discount_of(c)
        where = np.zeros(len(keys), np.int64)
        where[np.searchsorted(keys, own[pick])] = pick
        h_keys, total = summed(history[pick], value)
        kinds = np.bincount(np.searchsorted(h_keys, history[where]), minlength=len(h_keys))
        h = np.searchsorted(h_keys, history[where])
        lower = np.full(len(keys), 1.0 / alphabet)
        if n > 1:
            k = np.minimum(np.searchsorted(below[0], shorter[where]), len(below[0]) - 1)
            lower = np.where(below[0][k] == shorter[where], below[1][k], 1.0 / alphabet)
        p = np.maximum(c - discount, 0) / total[h] + discount * kinds[h] / total[h] * lower
        below = keys, p
        out.append((keys, np.log(p), h_keys, np.log(discount * kinds / total)))
    return out


@dataclass
class Models:
    """Of all languages together: a row for each hash, a column for each language; NaN where a language lacks it."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    histories: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    sharpness: float = 1.0
    limits: np.ndarray | None = None

    def score(self, names: list[str]) -> np.ndarray:
        """Sum of log-probabilities of each word (rows) under each language, its end included."""
        codes, word, at = laid_out(names)
        total = np.zeros((len(codes), len(self.langs)))
        open_ = np.ones(total.shape, bool)
        for n in range(ORDER, 0, -1):
            use = (at >= n - 1) & (at > 0)
            rows = np.flatnonzero(use & open_.any(axis=1))
            keys, values = self.grams[n - 1]
            own = hashed(codes, n)[rows]
            k = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            found = np.where((keys[k] == own)[:, None], values[k], np.nan)
            hit = open_[rows] & ~np.isnan(found)
            total[rows] += np.where(hit, found, 0)
            h_keys, h_values = self.histories[n - 1]
            before = np.roll(hashed(codes, n - 1), 1)[rows] if n > 1 else np.zeros(len(rows), np.uint64)
            k = np.minimum(np.searchsorted(h_keys, before), len(h_keys) - 1)
            back = np.where((h_keys[k] == before)[:, None], h_values[k], np.nan)
            miss = open_[rows] & ~hit
            total[rows] += np.where(miss & ~np.isnan(back), back, 0)
            open_[rows] = miss
        total[open_] += self.floor
        total[at == 0] = 0
        out = np.zeros((len(names), len(self.langs)))
        np.add.at(out, word, total)
        return out


def together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([p[0] for p in parts]))
    values = np.full((len(keys), len(parts)), np.nan, np.float32)
    for i, (k, v) in enumerate(parts):
        values[np.searchsorted(keys, k), i] = v
    return keys, values


def text_words(text: str) -> list[str]:
    """Words in lower case, long ones in pieces."""
    found = text.lower().split()
    if len(text) <= LONG_WORD or max(map(len, found), default=0) <= LONG_WORD:
        return found
    return [w[k : k + LONG_WORD] for w in found for k in range(0, len(w), LONG_WORD)]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Scorer:
    """Cross-entropies of texts; sums of words seen before are kept, up to MOST_WORDS."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self.at: dict[str, int] = {}
        self.sums = np.zeros((0, len(models.langs)))
        self.sizes = np.zeros(0, np.int64)

    def learn(self, names: list[str]) -> None:
        sums = self.models.score(names)
        start = len(self.at)
        self.at.update((w, start + i) for i, w in enumerate(names))
        self.sums = np.concatenate([self.sums, sums])
        self.sizes = np.concatenate([self.sizes, np.array([len(w) + 1 for w in names], np.int64)])

    def entropies(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.models.langs)))
        for i in range(0, len(texts), 200):
            split = [text_words(t) for t in texts[i : i + 200]]
            fresh = {w for ws in split for w in ws if w not in self.at}
            if len(self.at) + len(fresh) > MOST_WORDS:
                self.__init__(self.models)
                fresh = {w for ws in split for w in ws}
            if fresh:
                names = list(fresh)
                for k in range(0, len(names), 20_000):
                    self.learn(names[k : k + 20_000])
            for j, ws in enumerate(split):
                if ws:
                    at = np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))
                    out[i + j] = -self.sums[at].sum(axis=0) / self.sizes[at].sum()
        return out


def sampled(named: DataFrame, sizes: dict[str, int], bound: int) -> DataFrame:
    """(text, lang, held): of each language the ``bound`` rows of ``named`` with the least hashes; a tenth is held."""
    hashed_id = F.xxhash64(F.col("doc_id").cast("string"))
    chance = F.call_function("shiftrightunsigned", hashed_id, F.lit(11)) / F.lit(float(1 << 53))
    near = F.lit(False)
    for lang, n in sizes.items():  # rows that may be among them: twice as many, and more of few
        near |= (F.col("lang") == lang) & (chance < min(1.0, (2 * bound + 100) / n))
    order = Window.partitionBy("lang").orderBy("chance", F.xxhash64("text"))
    rows = named.where(near).withColumn("chance", chance).withColumn("at", F.row_number().over(order)).where(F.col("at") <= bound)
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.lit(10)) == 0
    return staged(rows.select("text", "lang", F.coalesce(held, F.lit(False)).alias("held")), "languages")


def counted_words(sample: DataFrame) -> pa.Table:
    """(lang, w, n) of the words in texts that are not held."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = Counter(text_words(text))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "w", "n"])

    rows = sample.where(~F.col("held")).select("lang", "text").mapInArrow(each, "lang string, w string, n long")
    return rows.groupBy("lang", "w").agg(F.sum("n").alias("n")).toArrow()


def train(rows: DataFrame) -> Models | None:
    """From rows (doc_id, text, lang) that may be learned from."""
    named = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    langs = sorted(sizes)
    bound = max(1, min(TRAIN_DOCS, TRAIN_TOTAL // len(langs)))
    sample = sampled(named, sizes, bound)
    counted = counted_words(sample)
    by_lang: dict[str, tuple[list[str], list[int]]] = {x: ([], []) for x in langs}
    for lang, w, n in zip(*[counted.column(c).to_pylist() for c in ("lang", "w", "n")], strict=True):
        by_lang[lang][0].append(w)
        by_lang[lang][1].append(n)
    langs = [x for x in langs if by_lang[x][0]]
    if not langs:
        return None
    each = [one_language(by_lang[x][0], np.array(by_lang[x][1])) for x in langs]
    grams = [together([m[n][:2] for m in each]) for n in range(ORDER)]
    histories = [together([m[n][2:] for m in each]) for n in range(ORDER)]
    models = Models(langs, grams, histories, -np.log(max(len(k) for k, _ in grams[:1]) + 1.0))
    return calibrated(models, sample.where("held").select("text", "lang").toArrow())


def calibrated(models: Models, held: pa.Table) -> Models:
    n = len(models.langs)
    models.limits = np.full(n, np.inf)
    pairs = [(t, x) for t, x in zip(held.column("text").to_pylist(), held.column("lang").to_pylist(), strict=True) if has_letter(t) and x in models.langs]
    if not pairs:
        return models
    e = Scorer(models).entropies([t for t, _ in pairs])
    own = np.array([models.langs.index(x) for _, x in pairs])
    right = np.arange(len(own))
    losses = {s: -np.log(np.maximum(shares(e, s)[right, own], 1e-9)).mean() for s in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)}
    models.sharpness = min(losses, key=losses.get)
    for i in range(n):
        if (own == i).sum() >= 20:
            models.limits[i] = np.percentile(e[own == i, i], REJECT_PERCENT)
    return models


def shares(entropies: np.ndarray, sharpness: float) -> np.ndarray:
    x = np.exp(-sharpness * (entropies - entropies.min(axis=1, keepdims=True)))
    return x / x.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, models: Models | None, keep: list[Column | str]) -> DataFrame:
    """``keep`` with lang_pred, score and rejected for every row."""
    rows = docs.select(*keep, F.col("text").alias("_text"))
    names = rows.columns[:-1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models) if models else None
        for b in batches:
            texts = b.column("_text").to_pylist()
            lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            use = [i for i, t in enumerate(texts) if scorer and has_letter(t)]
            if use:
                e = scorer.entropies([texts[i] for i in use])
                best, share = e.argmin(axis=1), shares(e, models.sharpness)
                for k, i in enumerate(use):
                    lang[i], score[i], rejected[i] = models.langs[best[k]], float(share[k, best[k]]), bool(e[k, best[k]] > models.limits[best[k]])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(each, f"{kinds}, lang_pred string, score double, rejected boolean")
