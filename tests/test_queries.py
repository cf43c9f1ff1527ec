"""The driver contract, and a cross-section of the registered queries against SQL."""

import os
import sys

import pytest

import __spark_entry__ as entry
from check import compare, database
from veilmark.catalog.queries import ORACLES, QUERIES

SAMPLE = [
    "s4_assemble_document", "c7_clean_text", "d2_phone", "d19_suppress_overlaps", "f2_iou", "f7_fuse", "v21_validate_context",
    "k3_recalibrate_tables", "n3_apply_verifier_scores", "q2_superset_dedup", "q6_adjusted_risk", "a7_tokenize",
    "a11_pseudonymize", "a22_apply_to_text", "o2_entities_report", "o7_to_audit_log", "m4_daily_trend", "p4_analyze_stream",
]


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "anonymized_text" in rows.columns


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_matches_sql(spark, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toArrow()
    sql = entry.oracle_sql().get(name)
    assert got.num_rows > 0
    assert sql is None or compare(database(sf_dir), got, sql) == ""


def test_queries_without_what_the_subpackage_needs(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("veilmark.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)  # as if it were not installed
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)


def test_analyzed_files_hold_a_text_for_each_supplier(spark, tmp_path):
    tables = {"supplier": ([(1,), (2,), (3,)], "s_suppkey bigint"), "nation": ([(0,)], "n_nationkey int"), "region": ([(0, "r")], "r_regionkey int, r_name string"),
              "customer": ([(7, "Ann", 0, 1.5, "x")], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = entry.queries()["p2_analyze_files"](spark, str(tmp_path)).select("name").collect()
    assert sorted(row[0] for row in found) == ["fin-1", "fin-2", "fin-3", "nation-0"]
