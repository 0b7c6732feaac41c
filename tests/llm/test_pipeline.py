"""The pipeline stage by stage, and the queries that have SQL against it."""

import re
import sys
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from lumenguard.llm import queries

SF = Path("/root/testdata/sf0.001")


def test_stages_take_effect(spark, documents, prose, tmp_path):
    item = prose(70, 30)
    rows = [(1, prose(1, 120)), (2, prose(1, 120)), (3, prose(3, 120)), (4, "too short"), (5, f"{item} {prose(5, 40)}"), (6, prose(6, 80) + " password=Ab12Cd34Ef56Gh"), (7, None), (8, prose(1, 119) + " other")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(rows)
    docs = docs.selectExpr("*", "cast(length(text) as long) as n_chars", "1 as score", "'x' as component")
    left = [{1, 2, 3, 5, 6, 8}, {1, 3, 5, 6}, {1, 3, 6}, {1, 3, 6}, {1, 3, 6}]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, left, strict=True):
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id: r for r in docs.collect()}
        assert set(got) == ids, name
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "secret scans":
            assert got[6].text == prose(6, 80) + " [SECRET]" and got[3].text == prose(3, 120)
    assert all(r.round_trip for r in got.values())


def test_empty_tables(spark, documents, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    documents([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_decontamination", "op6_secret_scan", "op7_warc", "op9_minhash_near_dedup", "op10_substring_dedup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in SF.iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    df, rel = queries.QUERIES[name](spark, str(SF)), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want))


def test_nothing_outside_imports_the_subpackage():
    root = Path(sys.modules["lumenguard"].__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"(import|from)[^\n]*\bllm\b", f.read_text()), f
