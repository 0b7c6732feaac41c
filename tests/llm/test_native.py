"""URL filters, quality rules, decontamination and secret scans against brute force on small tables with odd rows."""

import hashlib
import random
import re
from collections import Counter

from lumenguard.llm import decontamination, quality_rules, secret_scan, url_filter
from pyspark.sql import functions as F

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "a b " * 3000), (6, "same same"), (6, "same same"), (None, "null id")]


def repeated(ws):
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})


def test_quality_counts(documents, prose):
    rows = [*ODD, (7, prose(1, 90) + "\n# one\n# one\n\n" + prose(1, 30)), (8, prose(2, 60), (None, None)), (9, " ".join(prose(9, 40).split() * 9))]
    got = quality_rules.judge(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated(ws))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(ws) < 50 or 100 * want[4] > 50 * len(ws)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(documents([])).count() == 0


def test_quality_limits_follow_their_group(documents, prose):
    """What is usual in one source is odd in another."""
    plain = [(i, prose(i, 80), ("en", "plain")) for i in range(210)]
    marked = [(1000 + i, prose(i, 60) + " ##" * 20, ("en", "marked")) for i in range(210)]
    odd = [(5000, prose(5000, 60) + " ##" * 20, ("en", "plain"))]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(documents(plain + marked + odd)).collect()}
    assert not kept[5000] and all(kept[r[0]] for r in plain + marked)


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    ws, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(len(iw), 13)
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(ws), len(hit), sorted(map(str, found))


def test_decontamination(spark, documents, prose):
    items = [(1, prose(50, 40)), (2, prose(51, 13)), (3, "Short, Item here"), (4, "solo"), (5, None), (6, ""), (7, prose(50, 40)), (8, prose(53, 14) + " É tail")]
    a, b = prose(50, 40).split(), prose(51, 13).split()
    rows = [*ODD, (10, " ".join(a[5:30])), (11, "x " + " ".join(a[5:17]) + " y"), (12, " ".join(b).upper() + "! SOLO"), (13, " ".join(b[:12])), (14, "a short; item, here solo" + prose(3, 300)),
            (15, " ".join(a[:13] + a[20:33] + b)), (16, prose(53, 14) + " é tail"), (17, " ".join(a * 3))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontamination.contamination(documents(rows), bench).collect()}
    for i, t, *_ in rows:
        n, hit, found = brute_hits(t, items)
        assert got[(i, n)] == (n, hit, found, hit > 0 and 20 * hit >= n), (i, t)
    assert len(got) == len({(i, t) for i, t, *_ in rows})
    assert {r.n_hit for r in decontamination.contamination(documents(rows), bench.limit(0)).collect()} == {0}
    assert decontamination.contamination(documents([]), bench).count() == 0


def test_secrets(documents):
    key, hex_ = "Ab1" * 7, "0123456789abcdef"
    pat = "gh" + "p_" + "a1B2" * 9
    live, example = "tok" + "3" * 20, "example" + "4" * 20
    rows = [*ODD[:-1], (10, f"é password={key} x"), (11, f'"token": "short" Secret : {key}'), (12, f"AKIA{'Z9' * 9}, {hex_} {hex_[:15]}"), (13, f"see {pat} ok"), (14, f"api_key={pat}"), (15, f"password=token={key}"),
            *[(20 + i, f"secret={example}", ("en", f"s{i}")) for i in range(4)], *[(30 + i, f"secret={live}", ("en", "own")) for i in range(4)]]
    df = documents(rows)
    got = {(r.doc_id, r.text_key): r for r in secret_scan.scan(df, F.col("source"), F.col("source")).select("doc_id", "text_key", secret_scan.as_text(F.col("spans")).alias("spans"), "live").collect()}
    by_id = {k[0]: r for k, r in got.items()}
    for i, t, *_ in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(secret_scan.BASE[0].pattern, t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        names = ["assign", "access", "hex"]
        want = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
        extra = f"github:4:{4 + len(pat)}" if i == 13 else ""
        assert by_id[i].spans == (want or extra), (i, t)
    assert all(not by_id[20 + i].live and by_id[30 + i].live for i in range(4))
    masked = df.where("doc_id = 10").select(secret_scan.masked(F.col("text"), F.array(F.struct(F.lit(2).alias("s"), F.lit(9).alias("e")), F.struct(F.lit(5).alias("s"), F.lit(11).alias("e")))).alias("m")).first()["m"]
    t = rows[7][1]
    assert masked == t[:2] + "[SECRET]" + t[11:]
    assert secret_scan.scan(documents([]), F.col("source"), F.col("source")).count() == 0


RULES = [url_filter.HostRule(*x) for x in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"))]
URLS = {
    "http://A.Example.COM/en/1?q": ("a.example.com", "/en/1", "com/en/", "block"),
    "x://example.com/en/77#f": ("example.com", "/en/77", "example.com/en/7", "allow"),
    "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
    "http://com/en/": ("com", "/en/", "com/en/", "block"),
    "http://xcom/en/": ("xcom", "/en/", None, "allow"),
    "http://example.net?de/": ("example.net", "", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "http://": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_url_rules_and_mining(spark):
    pages = [(i, u) for i, u in enumerate(URLS)]
    pages += [(100 + i, f"http://{'bad' if i % 3 == 0 else 'good'}.org/{'casino' if i % 2 else 'news'}/{i}") for i in range(300)]
    labels = [(100 + i, i % 3 == 0 and i % 2 == 1) for i in range(0, 300)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame(labels, "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filter.judge(df, lab, RULES).collect()}
    assert len(got) == len(pages)
    for i, u in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == URLS[u], u
    for i in range(300):
        assert got[100 + i].verdict == ("block" if i % 3 == 0 and i % 2 else "allow")
    assert got[103].mined_rule == "host:bad & path:casino"
    none = url_filter.judge(df, lab.limit(0), RULES)
    assert none.where("mined_rule is not null").count() == 0 and none.count() == len(pages)
    assert url_filter.judge(df.limit(0), lab, RULES).count() == 0


def test_url_mining_of_long_urls(spark):
    """The commonest tokens of URLs with many frequent ones make rules, too."""
    rng = random.Random(4)
    pool = [f"p{i}" for i in range(48)]
    bad = lambda i: i < 150
    pages = [(i, f"http://{'hot.org' if bad(i) else f'g{i}.net'}/{'/'.join(rng.sample(pool, 12))}") for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame([(i, bad(i)) for i in range(400)], "page_id long, bad boolean")
    got = {r.page_id: (r.mined_rule, r.verdict) for r in url_filter.judge(df, lab, RULES).collect()}
    assert all(got[i] == (("host:org", "block") if bad(i) else (None, "allow")) for i in range(400))


def test_words_key_tells_texts_apart(documents):
    keys = {r.k for r in documents([(1, "a b"), (1, "A, b"), (2, "ab")]).select(decontamination.words_key(F.col("text")).alias("k")).collect()}
    assert keys == {hashlib.sha256(x.encode()).hexdigest() for x in ("a b", "ab")}
