"""Queries against their SQL twins on the smallest tables; LUMENGUARD_ALL=1 runs every one."""

import os
from pathlib import Path

import duckdb
import pytest
from lumenguard.plans.catalogue import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")
QUICK = ["scan_pan_documents", "scan_iban_derived", "scan_generic_key_derived", "validator_luhn", "findings_ordered", "policy_default", "redact_text", "merge_ranges", "compact_view", "url_decode_view", "registry_unknown_action", "guard_mapping", "tier_matrix"]


def same(spark, name, query, sql, sf):
    con = duckdb.connect()
    for f in sf.iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    df, rel = query(spark, str(sf)), con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want)), name


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", list(ORACLE_SQL) if os.environ.get("LUMENGUARD_ALL") else QUICK)
def test_query_equals_sql(spark, name):
    same(spark, name, QUERIES[name], ORACLE_SQL[name], SF)


def test_entry_has_all_queries():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
