"""Plans and results that only larger tables show: rows dealt evenly, each text scanned once, exact ranks."""

import re
import unicodedata

import pytest
from lumenguard.functions import normalize, pack
from lumenguard.operators import metrics, report, scan
from lumenguard.operators.classify import expressions
from lumenguard.plans.catalogue import QUERIES
from lumenguard.sources import spread
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
MARK = "github_pat_"


def test_rows_of_one_row_group_are_dealt(spark, tmp_path):
    spark.range(2000).coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")  # many splits, of which one reads all rows
    try:
        counts = [r["count"] for r in spread(spark.read.parquet(str(tmp_path / "t"))).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(counts) >= spark.sparkContext.defaultParallelism and max(counts) < 2 * min(counts)


def test_parts_grow_with_the_bytes_read(spark, tmp_path):
    spark.range(30_000).select(F.sha2(F.col("id").cast("string"), 256).alias("h")).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    few = spread(df).rdd.getNumPartitions()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")  # the table has about 2 MB
    try:
        many = spread(df).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert few == 3 * spark.sparkContext.defaultParallelism and many > 2 * few


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["cross_view_dedupe", "report_totals", "nested_payload", "windowed_findings"])
def test_texts_are_classified_once(spark, name):
    found = plan(QUERIES[name](spark, SF))
    assert found.count(MARK) == expressions("text", pack.PATTERNS)[1].count(MARK) and "Repartition" in found


@pytest.mark.parametrize("name", ["findings_by_nation_cube", "findings_by_type", "findings_ordered", "types_per_doc", "precision_recall_f1", "policy_default", "registry_unknown_action", "precision_recall_grouping_sets"])
def test_texts_are_scanned_once(spark, name):
    found = plan(QUERIES[name](spark, SF))
    assert found.count(MARK) == scan.scan_sql("text").count(MARK) and "Repartition" in found


def test_listed_rows_are_bounded_before_they_are_put_together(spark):
    df = QUERIES["findings_top50"](spark, SF)
    assert "WindowGroupLimit" in plan(df) and "collect_list" not in plan(df) and "Repartition" in plan(df)
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    kept = report.listed(rows, ["g"], [F.desc("id")], 5).collect()
    assert sorted(r["id"] for r in kept) == list(range(985, 1000))


def test_percentiles_are_exact(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 3).cast("string")).alias("g"), (F.hash("id") % 40_000_000).cast("long").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("none", None), ("one", 7), ("two", 1), ("two", 2)], "g string, v long"))
    got = {r["g"]: (r["p50"], r["p95"], r["p99"]) for r in metrics.percentiles(rows, "v", ["g"]).collect()}
    values = {}
    for r in rows.collect():
        values.setdefault(r["g"], []).extend([] if r["v"] is None else [r["v"]])
    nearest = lambda vs, p: sorted(vs)[(len(vs) * p + 99) // 100 - 1] if vs else None
    assert got == {g: tuple(nearest(vs, p) for p in (50, 95, 99)) for g, vs in values.items()}
    every = [v for vs in values.values() for v in vs]
    assert tuple(metrics.percentiles(rows, "v").first()) == tuple(nearest(every, p) for p in (50, 95, 99))


def test_percentiles_of_many_values_are_exact(spark):
    n = 4_000_037
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("v"))  # each number below n once
    assert tuple(metrics.percentiles(rows, "v").first()) == tuple((n * p + 99) // 100 - 1 for p in (50, 95, 99))


def test_places_are_left_out_where_not_asked_for(spark):
    found = plan(QUERIES["zero_width_strip"](spark, SF))
    assert "regexp_replace" in found and "regexp_extract_all" not in found and "Repartition" in found
    rows = spark.createDataFrame([("a\u200bb\ufeff",), ("ab",), ("é\u200b",), (None,)], "t string")
    for whole in (normalize.zero_width, normalize.zero_width_at_once):
        assert [tuple(r["x"]) for r in rows.select(whole(F.col("t")).alias("x")).collect()] == [("ab", [0, 2], 2), ("ab", None, 0), ("é", [0], 1), (None, None, 0)]


def test_characters_to_fold_are_those_without_own_forms(spark):
    own = re.compile(f"[{normalize.OWN_FORMS}]")
    every = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    rows = spark.range(0x110000).where("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.concat(F.lit("00000078"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32").alias("c"))  # after an x, as a byte order mark at the start goes
    assert [chr(r["id"]) for r in rows.where(F.col("c").rlike(normalize.WIDE)).orderBy("id").collect()] == [c for c in every if not own.match(c)]


@pytest.mark.parametrize("name", ["nfkc_full", "comply_full_result"])
def test_texts_are_looked_through_for_folding_once(spark, name):
    found = plan(QUERIES[name](spark, SF))
    assert found.count("octet_length(") == 1 and found.count("가-힣") == normalize.WIDE.count("가-힣")


def test_folding_takes_each_character_alone(spark):
    texts = ["", None, "plain", "für “dich” – 中文 가", "１２３ ﬁne", "é", "e\u0301", "½", "K \u212a", "\U0001d7d8\U0001f600", "ǆ가 ﷺ"]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalize.nfkc(F.col("t")).alias("x")).collect()]
    for t, x in zip(texts, got, strict=True):
        forms = [unicodedata.normalize("NFKC", c) for c in t or ""]
        places = [i for i, f in enumerate(forms) for _ in f]
        assert tuple(x) == (None if t is None else "".join(forms), places if any(len(f) != 1 for f in forms) else None, sum(f != c for f, c in zip(forms, t or "", strict=True)))
