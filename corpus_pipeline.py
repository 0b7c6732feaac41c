"""Quality rules, near-dedup, decontamination, secret masking and SentencePiece encoding of a corpus, one after another.

Each stage works on all that the one before it kept. Rows go through as they are, with all their columns, but for stage 4,
which masks secrets in the text, and stage 5, which returns ids as digests. A document is a row of its own; repeats of a row are
exact copies, of which one stays. Nulls and empty tables are as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenguard.llm import decontamination, near_dedup, quality_rules, secret_scan, sentencepiece_codec
from lumenguard.llm.queries import piece_model, table
from lumenguard.llm.store import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What tells rows of documents apart: the id, and the text for ids that are not unique.
KEY = ["__lg_id", "__lg_key"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__lg_id": F.col("doc_id"), "__lg_key": F.xxhash64("text")})


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) is not in ``gone`` (g_id, g_key)."""
    on = F.col("__lg_id").eqNullSafe(F.col("__lg_gone_id")) & (F.col("__lg_key") == F.col("__lg_gone_key"))
    return keyed(docs).join(gone, on, "left_anti").drop(*KEY)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = quality_rules.judge(keyed(docs), [*KEY, "lang", "source"])
    return without(docs, judged.where(~F.col("kept")).select(F.col("__lg_id").alias("__lg_gone_id"), F.col("__lg_key").alias("__lg_gone_key")).distinct())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays; of repeats of its row, one."""
    groups = near_dedup.linked(docs)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("__lg_gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__lg_gone_id"), "left_anti").dropDuplicates(["doc_id", "text"])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark's window go, however long they are: a passage in a long text is as much of a leak."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where("n_hit > 0").select(F.col("doc_id").alias("__lg_gone_id"), F.col("words_key").alias("__lg_gone_key"))
    words_key = decontamination.words_key(F.col("text"))
    on = F.col("doc_id").eqNullSafe(F.col("__lg_gone_id")) & (words_key == F.col("__lg_gone_key"))
    return docs.join(gone, on, "left_anti")


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked; widely copied examples stay as they are."""
    found = secret_scan.scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    live = found.where(F.size("live") > 0).select(F.col("doc_id").alias("__lg_gone_id"), F.col("text_key").alias("__lg_gone_key"), F.col("live").alias("__lg_live"))
    on = F.col("__lg_id").eqNullSafe(F.col("__lg_gone_id")) & (F.col("__lg_key") == F.col("__lg_gone_key"))
    both = keyed(docs).join(live, on, "left")
    text = F.when(F.col("__lg_live").isNull(), F.col("text")).otherwise(secret_scan.masked(F.col("text"), F.col("__lg_live")))
    return both.withColumn("text", text).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, as digests, with the text back from them."""
    return sentencepiece_codec.round_trips(docs, piece_model())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("secret scans", secrets_masked),
    ("sentencepiece", pieces),
]
#: The last stage has no SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
