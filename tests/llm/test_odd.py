"""Every operator over odd rows: other columns with clashing names change nothing, repeated rows and very long texts have results, empty tables have none."""

import public_tokenizers
import pytest
from lumenguard.llm import decontamination, language_id, line_dedup, near_dedup, quality_rules, secret_scan, sentencepiece_codec, token_files, url_filter, warc
from pyspark.sql import functions as F

CLASHING = ["id", "component", "sig", "digest", "text_key", "start", "end", "unit", "gone", "spans", "live", "found", "owner", "words_key", "ws", "runs", "run", "n_words", "n_hit", "items", "kept", "part", "ids", "n_tokens", "lang_pred", "score", "n_lines", "kept_spans", "measure", "v", "n"]
PAGE_CLASHING = ["host", "path", "rule", "verdict", "mined_rule", "toks", "tok", "bad", "url_key", "captured", "digest", "size", "place", "file", "offset", "part", "refers_to", "r_id", "g", "t"]


def documents_ops(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta " * 4), (None, "solo item")], "item_id long, text string")
    bpe, piece = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")

    def languages(docs):
        return language_id.predict(docs, language_id.train(docs), ["doc_id"])

    return {
        "sentencepiece": lambda d: sentencepiece_codec.round_trips(d, piece),
        "quality": lambda d: quality_rules.judge(d).select("doc_id", *quality_rules.BASE, "base_failed", "kept"),
        "decontamination": lambda d: decontamination.contamination(d, bench),
        "languages": languages,
        "secrets": lambda d: secret_scan.scan(d, F.col("source"), F.col("lang")),
        "tokens": lambda d: token_files.written_and_read(d, bpe, 2),
        "near": near_dedup.linked,
        "lines": lambda d: line_dedup.deduplicated(d.select("doc_id", "text", *[c for c in d.columns if c in CLASHING])).select("doc_id", "text", "n_removed_words"),
    }


@pytest.mark.parametrize("name", ["sentencepiece", "quality", "decontamination", "languages", "secrets", "tokens", "near", "lines"])
def test_documents(spark, documents, prose, name):
    op = documents_ops(spark)[name]
    text = prose(1, 80) + ". " + prose(2, 40) + " password=Ab12Cd34Ef56Gh"
    rows = [(1, text), (2, text), (2, text), (3, None), (3, None), (4, ""), (None, prose(3, 60)), (5, "x"), (6, "alpha beta gamma delta " * 6), (7, "日本語" * 50), (8, (prose(8, 500) + "\n") * 60)]
    docs = documents(rows)
    plain = sorted(map(repr, op(docs).collect()))
    single = {"decontamination", "secrets"}  # one row for repeated ones, as documented
    assert len(plain) == (len(rows) - 2 if name in single else len(rows))
    clashing = docs.select("*", *[F.lit(7).alias(c) for c in CLASHING])
    again = op(clashing)
    assert sorted(map(repr, again.select(op(docs).columns).collect())) == plain
    assert op(documents([])).count() == 0


def test_pages(spark):
    long_url = "http://long.org/" + "a/" * 20_000 + "?q=" + "b" * 50_000
    rows = [(1, "http://a.com/en/1", "<p>x</p>"), (1, "http://a.com/en/1", "<p>x</p>"), (1, "http://b.com/", "<p>x</p>"), (2, long_url, "y" * 300_000), (3, None, None), (None, "", ""), (None, None, "<p>x</p>"), (4, "http://a.com/en/1", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, True), (4, False), (None, True)], "page_id long, bad boolean")
    clashing = pages.select("*", *[F.lit(7).alias(c) for c in PAGE_CLASHING])
    rules = [url_filter.HostRule("block", "com/en/")]
    judged = [sorted(map(repr, url_filter.judge(p, labels, rules).collect())) for p in (pages, clashing)]
    assert judged[0] == judged[1] and len(judged[0]) == len(rows)
    when = F.coalesce("page_id", F.lit(0).cast("long"))
    archived = [sorted(map(repr, warc.archived_and_read(p, when)[0].collect())) for p in (pages, clashing)]
    assert archived[0] == archived[1] and len(archived[0]) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.archived_and_read(pages, when)[0].collect())
    assert kinds == [(0, "response", 0), (0, "response", 0), (1, "revisit", 4), (1, "revisit", 4), (1, "revisit", 4), (2, "response", 0), (3, "response", 0), (4, "response", 0)]


def test_one_id_with_several_texts(documents, prose):
    """The text with the least hash stands for the document."""
    base, other = prose(1, 100), prose(2, 100)
    rows = [(1, base), (5, base), (5, other), (9, other)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.linked(documents(rows)).collect())
    keys = {t: documents([(1, t)]).select(F.xxhash64("text")).first()[0] for t in (base, other)}
    five, nine = (1, 9) if keys[base] < keys[other] else (5, 5)
    assert [(i, c) for i, _, c in got] == [(1, 1), (5, five), (5, five), (9, nine)]


def test_empty_training(documents):
    assert language_id.predict(documents([]), None, ["doc_id"]).count() == 0


def test_passages_within_lines(documents, prose):
    """A passage goes wherever it stands in a line, also without sentence ends; what only looks like it stays."""
    passage = ". ".join(prose(50 + i, 9).capitalize() for i in range(6)) + "."
    bare = prose(90, 60)
    rows = [
        (1, f"{prose(1, 30)} {passage} {prose(2, 30)}\n{prose(3, 30)} {bare} {prose(4, 30)}"),
        (2, f"{prose(5, 33)} {passage} {prose(6, 20)}"),
        (3, f"{prose(7, 47)} {bare} {prose(8, 35)}"),
        (4, f"{prose(9, 60)} {passage[:40]} {prose(10, 60)}"),
    ]
    text = dict(rows)
    got = {r.doc_id: r for r in line_dedup.deduplicated(documents(rows)).collect()}
    assert got[1].text == text[1] and got[4].text == text[4]
    assert got[2].n_removed_words >= 40 and got[3].n_removed_words >= 25
    for i in (2, 3):
        assert all(text[i][s.start : s.end] in text[1] for s in got[i].removed_spans)
        assert "\n".join(text[i][s.start : s.end] for s in got[i].kept_spans) == got[i].text
