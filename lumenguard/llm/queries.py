"""One query for each operator of this subpackage, over its whole table, and the same in DuckDB's SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, line_dedup, near_dedup, quality_rules, secret_scan, sentencepiece_codec, sql, token_files, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules that hold before mined ones.
HOST_RULES = [
    url_filter.HostRule("block", "com/en/"),
    url_filter.HostRule("allow", "example.com/en/7"),
    url_filter.HostRule("allow", "net/de/"),
    url_filter.HostRule("block", "example.net/de/8"),
    url_filter.HostRule("block", "org/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose id is the first number in its path; it is bad if that is labelled toxic or of low quality."""
    pages = table(spark, sf_dir, "pages")
    shown = pages.select("page_id", F.regexp_extract(url_filter.path_of(F.col("url")), r"/(\d{1,18})(?!\d)", 1).try_cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    found = url_filter.judge(pages, shown.join(labels, "doc_id").select("page_id", "bad"), HOST_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each text and the text back from them, as digests."""
    return sentencepiece_codec.round_trips(table(spark, sf_dir, "documents"), piece_model())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", n_items, F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    models = language_id.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return language_id.predict(docs, models, ["doc_id", held_out.alias("held_out")])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of a text is its source, its repository that and its language."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))
    n = lambda i: F.size(F.filter("spans", lambda x: x.k == i)).cast("long")
    base = secret_scan.as_text(F.filter("spans", lambda x: x.k < len(secret_scan.BASE)))
    counts = [n(i).alias(f"n_{k.name}") for i, k in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scan.as_text(F.col("spans")).alias("spans"), F.size("live").cast("long").alias("n_live"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no time of capture; their ids, as seconds, stand for it."""
    captured = F.coalesce(F.pmod("page_id", F.lit(1_000_000_000)), F.lit(0).cast("long"))
    records, index = warc.archived_and_read(table(spark, sf_dir, "pages"), captured)
    places = index.select(F.col("page_id").alias("i_id"), "url_key", "place", "capture_no").dropDuplicates(["i_id"])
    found = records.join(places, F.col("page_id").eqNullSafe(F.col("i_id")), "left")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "place", "capture_no")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.written_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.linked(table(spark, sf_dir, "documents"), near_dedup.Params(width=2))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of each text, as spans, and the text that stays."""
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed_spans", lambda x: F.concat_ws(":", x.start, x.end)), ",")
    return found.select("doc_id", "n_lines", "n_words", "n_removed", "n_removed_words", spans.alias("removed_spans"), (F.col("n_removed_words") == 0).alias("untouched"), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_secret_scan": op6_secret_scan,
    "op7_warc": op7_warc,
    "op8_token_files": op8_token_files,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": sql.URL_FILTER,
    "op3_quality_rules": sql.QUALITY_RULES,
    "op4_decontamination": sql.DECONTAMINATION,
    "op6_secret_scan": sql.SECRET_SCAN,
    "op7_warc": sql.WARC,
    "op9_minhash_near_dedup": sql.NEAR_DEDUP,
    "op10_substring_dedup": sql.SUBSTRING_DEDUP,
}
