"""Views of a text: compatibility folding, zero-width removal, compaction between number parts, and decoded payloads.

Offset maps give the place in the original for each character of a view; null is the identity.
"""


import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T

from .dual import F
from .spans import find, kept_places, let, none_of

#: Zero-width and direction controls; white space that may part numbers; what stands on both sides of it.
ZERO_WIDTH = r"[​-‏‪-‮⁠⁦-⁩﻿]+"
WHITE = r"[\x09-\x0D\x20   -     　]+"
BETWEEN = rf"(?<=[0-9\-_/.:]){WHITE}(?=[0-9\-_/.:])"
BASE64 = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}={0,2}"  # the look back saves trying a run from each of its characters
URL = r"[A-Za-z0-9_\-.~!*'();:@&=+$,/?#\[\]%]+"
ESCAPE = "%[0-9A-Fa-f]{2}"
#: Characters that are their own compatibility forms: ASCII, and common letters and marks of Latin, Cyrillic, Greek, Chinese, Japanese and Korean.
OWN_FORMS = r"\x00-\x7F¡¿«»À-ıĴ-ľŁ-ňŊ-žΆΈ-ΊΌΎ-ΡΣ-ώЀ-ҁ–—‘’“”•€ぁ-ゖァ-ヺ一-鿿가-힣"
#: A character outside ``OWN_FORMS``. The engine asks one range after the other, so ASCII is set apart first, then letters of Latin and of other scripts.
WIDE = rf"[\x{{80}}-\x{{10FFFF}}&&[[^À-ı]&&[[^Ѐ-ҁぁ-ゖァ-ヺ一-鿿가-힣]&&[^{OWN_FORMS}]]]]"
LEAST, LEFT_TRIMS = 24, 4
#: What a text needs to have for a Base64 run or a run with escapes of ``LEAST`` characters.
LONG_RUN = rf"(?<!\S)\S{{{LEAST}}}"
VIEW = "struct<text:string,view:string,map:array<int>,has_map:boolean,start:int,end:int,depth:int>"
FOLDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("map", T.ArrayType(T.IntegerType())), T.StructField("changed", T.IntegerType())])


class Forms(dict):
    """Compatibility forms of characters, worked out when first asked for."""

    def __missing__(self, c: str) -> str:
        form = self[c] = unicodedata.normalize("NFKC", c)
        return form


@F.pandas_udf(FOLDED)
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Each code point on its own; rows that need no folding come as null and stay so."""
    known = Forms()

    def fold(text: str | None) -> tuple:
        if text is None or unicodedata.is_normalized("NFKC", text):  # then each code point is, too
            return text, None, 0
        forms = [c if c < "\x80" else known[c] for c in text]
        changed = sum(f != c for f, c in zip(forms, text, strict=True))
        moved = any(len(f) != 1 for f in forms)
        return "".join(forms), [i for i, f in enumerate(forms) for _ in f] if moved else None, changed

    for s in batches:
        yield pd.DataFrame([fold(t) for t in s], columns=["text", "map", "changed"])


def nfkc(text: Column) -> Column:
    """(text, map, changed). There is no built-in for it; only texts with characters outside ``OWN_FORMS`` go to Python."""
    plain = F.struct(text.alias("text"), F.lit(None).cast("array<int>").alias("map"), F.lit(0).alias("changed"))
    wide = (F.octet_length(text) != F.length(text)) & text.rlike(WIDE)
    folded = _nfkc(F.when(wide, text))  # what has no text did not go, so texts are looked through once
    return F.when(folded["text"].isNotNull(), folded).otherwise(plain)


def composed(outer: Column, inner: Column) -> Column:
    """Map through both; null is the identity."""
    return F.when(outer.isNull(), inner).when(inner.isNull(), outer).otherwise(F.transform(outer, lambda i: F.get(inner, i)))


def _places(text: Column, pattern: str) -> Column:
    return let(find(text, pattern), lambda spans: kept_places(text, spans))


def _without(text: Column, pattern: str) -> Column:
    """(text, map, removed): ``text`` less the matches of ``pattern``."""

    def placed(out: Column) -> Column:
        removed = F.length(text) - F.length(out)
        places = F.when(removed > 0, _places(text, pattern))
        return F.struct(out.alias("text"), places.alias("map"), removed.alias("removed"))

    return let(F.regexp_replace(text, pattern, ""), placed)


def _may_hold_zero_width(text: Column) -> Column:
    """Only texts with one of the bytes that these characters begin with are looked through."""
    raw = text.cast("binary")
    return F.contains(raw, F.unhex(F.lit("E280"))) | F.contains(raw, F.unhex(F.lit("E281"))) | F.contains(raw, F.unhex(F.lit("EFBBBF")))


def zero_width_at_once(text: Column) -> Column:
    """``zero_width`` for use in a larger expression, where all fields are needed and each part is to be worked out once."""
    plain = F.struct(text.alias("text"), F.lit(None).cast("array<int>").alias("map"), F.lit(0).alias("removed"))
    return F.when(_may_hold_zero_width(text), _without(text, ZERO_WIDTH)).otherwise(plain)


def zero_width(text: Column) -> Column:
    """(text, map, removed). The fields stand side by side, so that a query works out only those it asks for."""
    out = F.when(_may_hold_zero_width(text), F.regexp_replace(text, ZERO_WIDTH, "")).otherwise(text)
    removed = F.coalesce(F.length(text) - F.length(out), F.lit(0))
    return F.struct(out.alias("text"), F.when(removed > 0, _places(text, ZERO_WIDTH)).alias("map"), removed.alias("removed"))


def compact(text: Column) -> Column:
    return _without(text, BETWEEN)


def printable(text: Column) -> Column:
    """Nine tenths or more are printable ASCII, tabs or line ends; false for empty texts."""
    shown = F.length(F.regexp_replace(text, r"[^\x20-\x7E\t\n\r]", ""))
    return F.coalesce((F.length(text) > 0) & (shown * 10 >= F.length(text) * 9), F.lit(False))


def base64_aligned(token: Column) -> Column:
    def checked(raw: Column) -> Column:
        same = F.regexp_replace(F.base64(raw), "[\r\n=]", "") == F.regexp_replace(token, "=+$", "")
        return let(raw.cast("string"), lambda text: F.when(same & F.is_valid_utf8(text) & printable(text), text))

    fits = (F.length(token) >= LEAST) & (F.length(token) % 4 == 0)
    return F.when(fits, let(F.try_to_binary(token, F.lit("base64")), checked))


def base64_text(token: Column) -> Column:
    """Decoded text, after the fewest characters cut from the left that make it one; else null."""
    cut = lambda i: let(F.substring(token, i + 1, F.length(token)), base64_aligned)
    tries = F.sequence(F.lit(0), F.lit(LEFT_TRIMS - 1))
    return F.aggregate(tries, F.lit(None).cast("string"), lambda done, i: F.coalesce(done, cut(i)))


def url_text(token: Column) -> Column:
    """Percent escapes decoded; null if malformed, not UTF-8, unchanged or not printable. A plus sign stays."""
    parts = F.regexp_extract_all(token, F.lit(f"{ESCAPE}|[^%]+"), F.lit(0))
    code = F.transform(parts, lambda p: F.when(p.startswith("%"), F.substring(p, 2, 2)).otherwise(F.hex(p.cast("binary"))))
    decoded = F.unhex(F.array_join(code, "")).cast("string")
    bad = token.rlike("%(?![0-9A-Fa-f]{2})")  # a repeated group over the whole token would recurse once a character
    return F.when(~bad, let(decoded, lambda text: F.when(F.is_valid_utf8(text) & (text != token) & printable(text), text)))


def candidates(text: Column) -> Column:
    """Array of (v, s, e, view): Base64 runs, then runs with two percent escapes or more; 24 characters at least."""
    kind = "struct<v:string,s:int,e:int,view:string>"
    tagged = lambda spans, view: F.transform(spans, lambda x: F.struct(x.v.alias("v"), x.s.alias("s"), x.e.alias("e"), F.lit(view).alias("view")))
    long_ = lambda spans: F.filter(spans, lambda x: F.length(x.v) >= LEAST)
    urls = F.when(text.contains("%"), F.filter(long_(find(text, URL)), lambda x: F.regexp_count(x.v, F.lit(ESCAPE)) >= 2))
    none = none_of("struct<m:string,v:string,s:int,e:int>")
    both = F.concat(tagged(long_(find(text, BASE64)), "decoded-base64"), tagged(F.coalesce(urls, none), "decoded-url"))
    return F.when(text.rlike(LONG_RUN), both).otherwise(none_of(kind))


def _decoded(text: Column) -> Column:
    """Array of (text, view, s, e) of the candidates that decode."""
    each = F.transform(candidates(text), lambda c: F.struct(F.when(c.view == "decoded-base64", base64_text(c.v)).otherwise(url_text(c.v)).alias("text"), c.view.alias("view"), c.s.alias("s"), c.e.alias("e")))
    return F.filter(each, lambda c: c.text.isNotNull())


def _view(text: Column, view: Column, map_: Column, has_map: bool, start: Column, end: Column, depth: int) -> Column:
    return F.struct(text.alias("text"), view.alias("view"), map_.alias("map"), F.lit(has_map).alias("has_map"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(depth).alias("depth"))


def encoded_views(text: Column) -> Column:
    """Decoded payloads of the original; each is looked at once more, and what it holds has its place."""
    null = F.lit(None).cast("array<int>")

    def with_inner(c: Column) -> Column:
        inner = F.transform(_decoded(c.text), lambda d: _view(d.text, d.view, null, False, c.s, c.e, 2))
        return F.concat(F.array(_view(c.text, c.view, null, False, c.s, c.e, 1)), inner)

    return F.flatten(F.transform(_decoded(text), with_inner))


STEP = "struct<transform:string,count:int>"


def views(text: Column, folded: Column) -> Column:
    """(normalized, views, steps, compacted): ``views`` begins with the normalized text; steps that did something, in order. ``folded`` is ``nfkc(text)`` as a column."""

    def build(zw: Column) -> Column:
        base = composed(zw.map, folded["map"])

        def rest(x: Column) -> Column:
            to_original = composed(x.c.map, base)
            start = F.coalesce(F.get(to_original, F.lit(0)), F.lit(0))
            end = F.least(F.coalesce(F.try_element_at(to_original, F.lit(-1)), F.length(text) - 1) + 1, F.length(text))
            first = _view(zw.text, F.lit("normalized"), base, True, F.lit(0), F.length(text), 0)
            has_compact = (x.c.removed > 0) & (F.length(x.c.text) > 0)
            tight = F.when(has_compact, F.array(_view(x.c.text, F.lit("compact"), to_original, True, start, end, 1))).otherwise(none_of(VIEW))
            count = lambda view: F.size(F.filter(x.enc, lambda v: v.view == view))
            step = lambda name, n: F.struct(F.lit(name).alias("transform"), n.cast("int").alias("count"))
            steps = F.array(
                step("nfkc", folded["changed"]),
                step("strip-zero-width", zw.removed),
                step("compact-whitespace", F.when(has_compact, x.c.removed).otherwise(F.lit(0))),
                step("decode-base64", count("decoded-base64")),
                step("decode-url", count("decoded-url")),
            )
            return F.struct(zw.text.alias("normalized"), F.concat(F.array(first), tight, x.enc).cast(f"array<{VIEW}>").alias("views"), F.filter(steps, lambda s: s["count"] > 0).alias("steps"))

        return let(F.struct(compact(zw.text).alias("c"), encoded_views(text).alias("enc")), rest)

    return let(zero_width_at_once(folded["text"]), build)
