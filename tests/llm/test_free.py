"""The other operators against libraries, brute force, round trips and held-out rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from lumenguard.llm import language_id, line_dedup, near_dedup, sentencepiece_codec, token_files, warc
from lumenguard.llm.components import components
from pyspark.sql import functions as F

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "word " * 4000), (6, "same same"), (6, "same same")]
HARD = ["", " ", "   ", "a  b   ", "\x00a\x01", "﷐\x00", "▁x ▁", "é☃😀", "<s> <0x41> </s>", "a" * 500, "ab" * 700 + " " * 70, "日本語 テキスト", "x\r\ny\t\u3000z", "<|endoftext|> İ é", "don't we'll"]


def test_pieces_equal_the_library(documents, prose):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*ODD, *enumerate(HARD, 10), *[(100 + i, prose(i, 50)) for i in range(20)]]
    df = documents(rows)
    tokens = sentencepiece_codec.encoded(df, path)
    texts = dict(rows)
    for r in tokens.collect():
        assert r.ids == (None if texts[r.doc_id] is None else lib.encode(texts[r.doc_id])), texts[r.doc_id]
    for r in sentencepiece_codec.decoded(tokens, path).collect():
        assert r.text == (None if texts[r.doc_id] is None else lib.decode(lib.encode(texts[r.doc_id])))
    for r in sentencepiece_codec.round_trips(df, path).where("doc_id <> 1").collect():
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    assert sentencepiece_codec.encoded(documents([]), path).count() == 0


def test_token_files(spark, documents, prose):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = sorted({*ODD, *enumerate(HARD, 10), *[(100 + i, prose(i, 50)) for i in range(20)]}, key=lambda r: r[0])
    got = sorted(tuple(r) for r in token_files.written_and_read(documents(random.Random(1).sample(rows, len(rows))), path, 2).collect())
    start, want = 0, []
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.written_and_read(documents([]), path, 2).count() == 0


def test_token_files_skip_by_index(spark, documents, tmp_path):
    import pyarrow.orc

    out = str(tmp_path / "t")
    token_files.write(documents([(i, "x y") for i in range(100)]), open(public_tokenizers.path("word_bpe_49k.json")).read(), 2, out, 4)
    assert [r.doc_id for r in token_files.lookup(spark, out, [5, 500]).collect()] == [5]
    firsts = [pyarrow.orc.ORCFile(f).read(["doc_id"]).column(0).to_pylist() for f in sorted((tmp_path / "t").glob("*.orc"))]
    assert sum(firsts, []) == list(range(100))


def test_language_models(documents):
    rng = random.Random(3)
    words = {"aa": ["kato", "kita", "koto", "takit"], "bb": ["sümü", "lösö", "müsü", "sölüm"], "cc": ["brend", "drang", "grund", "blend"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), (x, "s")) for i in range(240) for x in [("aa", "bb", "cc")[i % 3]]]
    odd = [(1000, None), (1001, ""), (1002, "12 34 !"), (1003, "Kato"), (1004, "kato" * 5000), (1005, "kato", (None, None))]
    df = documents(rows + odd)
    models = language_id.train(df.where("doc_id < 160 or doc_id >= 1000"))
    assert models.langs == ["aa", "bb", "cc", "en"]
    got = {r.doc_id: r for r in language_id.predict(df, models, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == r[0] for i, _, r in rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert got[1005].lang_pred in models.langs
    assert language_id.train(df.where("lang is null")) is None
    assert {r.lang_pred for r in language_id.predict(df, None, ["doc_id"]).collect()} == {"und"}


def brute_kneser_ney(names, counts):
    """(probability of a character after a history, alphabet) by dictionaries, of words with boundaries."""
    grams = {n: Counter() for n in range(1, language_id.ORDER + 1)}
    left = {n: {} for n in grams}
    for w, k in zip(names, counts, strict=True):
        t = f"\x01{w}\x01"
        for end in range(1, len(t)):
            for n in grams:
                if end - n + 1 >= 0:
                    g = t[end - n + 1 : end + 1]
                    grams[n][g] += k
                    if end - n >= 0:
                        left[n].setdefault(g, set()).add(t[end - n])
    top = language_id.ORDER
    own = {n: {g: k if n == top or (g[0] == "\x01" and n > 1) else len(left[n][g]) for g, k in grams[n].items()} for n in grams}
    alphabet = sorted({c for w in names for c in w} | {"\x01"})
    discount = {n: language_id.discount_of(np.array(list(own[n].values()))) for n in own}

    def p(c, history):
        n = len(history) + 1
        lower = 1 / (len(alphabet) + 1) if n == 1 else p(c, history[1:])
        total = sum(k for g, k in own[n].items() if g[:-1] == history)
        if not total:
            return lower
        kinds = sum(g[:-1] == history for g in own[n])
        return max(own[n].get(history + c, 0) - discount[n], 0) / total + discount[n] * kinds / total * lower

    return p, alphabet


def test_kneser_ney_by_brute_force():
    names, counts = ["ka", "kb", "kc", "ta", "tatak", "é"], np.array([1000, 1000, 1000, 1, 2, 1])
    p, alphabet = brute_kneser_ney(names, counts.tolist())
    assert p("k", "\x01") > 0.9 > 0.1 > p("t", "\x01")  # not how many kinds of words begin with it, but how many words do
    models = language_id.one_language(names, counts)
    code = lambda g, n: language_id.hashed(np.array([ord(c) for c in g], np.uint32), n)[-1]
    seen = 0
    for w in names:
        t = f"\x01{w}\x01"
        for end in range(1, len(t)):
            for n in range(1, min(language_id.ORDER, end + 1) + 1):
                keys, logs = models[n - 1][:2]
                g = t[end - n + 1 : end + 1]
                at = np.searchsorted(keys, code(g, n))
                assert keys[at] == code(g, n) and abs(np.exp(logs[at]) - p(g[-1], g[:-1])) < 1e-12, g
                seen += 1
    assert seen > 40
    for history in ("", "\x01", "k", "\x01ta", "at"):
        assert abs(sum(p(c, history) for c in alphabet) + p("\x02", history) - 1) < 1e-12  # the last stands for all others


def test_language_sample_is_of_one_size(documents):
    """However many texts there are, each language trains on the same number."""
    df = documents([(i, f"t{i}", (("aa", "bb")[i % 2], "s")) for i in range(3000)])
    sizes = {"aa": 1500, "bb": 1500}
    got = Counter(r.lang for r in language_id.sampled(df, sizes, 100).collect())
    assert got == {"aa": 100, "bb": 100}


def test_language_of_long_words(documents):
    """A language without spaces is learned."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("あいうえおかきくけこ" if i % 2 else "さしすせそたちつてと") for _ in range(150)), (("xx", "yy")[i % 2], "s")) for i in range(80)]
    df = documents(rows)
    models = language_id.train(df)
    assert models is not None and models.langs == ["xx", "yy"]
    assert {r.doc_id: r.lang_pred for r in language_id.predict(df, models, ["doc_id"]).collect()} == {i: x for i, _, (x, _) in rows}


def test_warc(spark):
    rows = [(i, f"http://h{i % 3}.org/p", f"<p>{i % 4}</p>") for i in range(30)]
    rows += [(50, None, None), (51, "http://x y\n/é", ""), (52, "no scheme", "é" * 50_000), (None, "http://n.org", "<p>0</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records, index = warc.archived_and_read(pages, F.coalesce("page_id", F.lit(0)))
    got = {r.page_id: r for r in records.collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    for i, _, h in rows:
        raw = (h or "").encode()
        want = ("response", None) if i is None or last[h or ""] == i else ("revisit", last[h or ""])
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *want)
    places = index.orderBy("place").collect()
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in places]
    assert [r.place for r in places] == list(range(len(rows))) and keys == sorted(keys)
    assert max(r.capture_no for r in places if r.url_key == "org,h0)/p") == 10
    empty, none = warc.archived_and_read(pages.limit(0), F.lit(0).cast("long"))
    assert empty.count() == none.count() == 0


def test_loser_tree():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(n)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(sum(runs, []))


def brute_components(sets):
    ids = [i for i, s in sets if s]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    own = dict(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i, _ in sets}


def test_near_dedup(documents, prose):
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "w " * 5000)]
    for g in range(12):
        base = prose(100 + g, rng.randrange(20, 120)).split()
        for _ in range(rng.randrange(1, 14)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 9)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(9999)}"
            rows.append((len(rows) + 1, " ".join(own).upper() if rng.random() < 0.2 else "  ".join(own)))
    for width in (2, 5):
        def shingles(t, width=width):
            w = (t or "").lower().split()
            return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

        sets = [(i, shingles(t)) for i, t in rows]
        want = brute_components(sets)
        got = {r.doc_id: r for r in near_dedup.linked(documents(rows), near_dedup.Params(width=width)).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in sets)
    odd = near_dedup.linked(documents([(None, "a b c"), (7, "a b c"), (7, "a b c")])).collect()
    assert sorted((r.component_id or 0, r.kept) for r in odd) == [(0, True), (7, True), (7, True)]
    assert near_dedup.linked(documents([])).count() == 0


def test_near_dedup_of_large_groups(documents):
    """Links to one member of hundreds of distinct near copies, among other texts of its neighbourhood."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]

    def changed(words, n, tag):
        own = list(words)
        for i in rng.sample(range(len(own)), n):
            own[i] = f"{tag}_{i}"
        return own

    sets = [(1000 + k, changed(base, 8, f"copy{k}")) for k in range(600)] + [(5000, base)]
    sets += [(10 + k, changed(base, 22, f"outer{k}")) for k in range(40)]  # 80.2 % to the original, less to its copies
    sets += [(6000 + k, changed(base, 60, f"templ{k}")) for k in range(300)]  # of one template, linked with nothing
    rng.shuffle(sets)
    want = brute_components([(i, frozenset(w)) for i, w in sets])
    assert len({want[10 + k] for k in range(40)}) == 1
    got = {r.doc_id: r.component_id for r in near_dedup.linked(documents([(i, " ".join(w)) for i, w in sets]), near_dedup.Params(width=1)).collect()}
    assert got == want


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]
    links = chain + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)] + [(500, 400 + i) for i in range(40)] + [(None, 3), (7, 7)]
    parent = {x: x for e in links if None not in e and e[0] != e[1] for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: root(i) for i in parent}


def test_line_dedup(documents, prose):
    a, b, short = prose(1, 60), prose(2, 25), "All rights reserved."
    rows = [(9, f"{a}\n{short}\nend"), (3, f"start\n{a.upper()}  \n{b}"), (5, f"{b}\n{b}\n{short}"), (6, b), (6, b), (7, None), (8, ""), (None, prose(4, 30)), (4, prose(4, 30) + "\n")]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.deduplicated(documents(rows)).collect()), key=str)
    want = [(3, rows[1][1], 3, 0), (9, f"{short}\nend", 3, 1), (5, short, 3, 2), (6, "", 1, 1), (6, "", 1, 1), (7, None, 0, 0), (8, "", 1, 0), (None, prose(4, 30), 1, 0), (4, "", 2, 1)]
    assert got == sorted(want, key=str)
    for r in line_dedup.deduplicated(documents(rows)).collect():
        source = [t for i, t, *_ in rows if i == r.doc_id and t is not None]
        assert not source or any("\n".join(t[s.start : s.end] for s in r.kept_spans) == (r.text or "") for t in source)
    assert line_dedup.deduplicated(documents([])).count() == 0


def test_line_dedup_of_short_lines(documents, prose):
    """Passages of short lines go wherever they repeat, but for short headings; the first copy stays whole."""
    words = prose(21, 63).split()
    verse = "\n".join(" ".join(words[i : i + 7]) for i in range(0, 63, 7))
    stanzas = verse.replace("\n", "\n\n", 2)
    lone = prose(22, 22).split()
    uneven = "\n".join([" ".join(lone[:19]), *lone[19:]])
    rows = [(1, f"Heading\n{verse}\nend one"), (2, f"Heading\nother start\n{verse.upper()}\nend two"), (3, verse), (4, f"Heading\n{prose(5, 30)}\nend one"), (5, uneven + "\n" + prose(6, 22)), (6, uneven), (7, "la la\n" * 30), (8, stanzas)]
    got = {r.doc_id: r for r in line_dedup.deduplicated(documents(rows)).collect()}
    text = dict(rows)
    assert [got[i].text for i in (1, 4, 5)] == [text[i] for i in (1, 4, 5)]
    assert (got[2].text, got[2].n_removed) == ("Heading\nother start\nend two", 9)
    assert got[3].text == got[6].text == got[8].text == "" and got[3].n_removed == 9
    assert got[7].text == "la la\n" * 10
    for i, r in got.items():
        assert "\n".join(text[i][s.start : s.end] for s in r.kept_spans) == r.text
