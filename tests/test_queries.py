"""Every registered query against its DuckDB oracle on the smallest tables, and
the driver contract (entry, queries, oracle_sql)."""

import os

import pytest

import __spark_entry__ as entry_mod
from oracle_check import canon, duck
from testsieve.plans.queries import QUERIES

SF = os.environ.get("TESTSIEVE_TEST_SF", "/root/testdata/sf0.001")
FAST = ["statistics", "statistics_by_dir", "func_decls", "valid_tests", "imports", "line_depth",
        "classify_runs", "outcome_compare", "path_root", "unit_share", "detect_format", "enum_decode",
        "analyze_report", "expand_calls", "subtest_rewrite", "refactor_summary", "report_text"]
NAMES = sorted(QUERIES) if os.environ.get("TESTSIEVE_ALL_QUERIES") else FAST


def test_contract_shapes():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["projectDir", "testCases", "testFiles", "totalFiles", "testLines",
                          "avgLinesPerTest", "percentTestLines"]
    assert df.count() == 25


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    df = entry_mod.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    orc = entry_mod.oracle_sql().get(name)
    if orc is None:
        assert rows and all(len(r) == len(df.columns) for r in rows)
        return
    cur = duck(SF).execute(orc)
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, rows) == canon(ocols, cur.fetchall())


def test_same_result_under_1_and_64_partitions(spark):
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            q = entry_mod.queries()
            rows = [tuple(r) for r in q["statistics"](spark, SF).collect()]
            # a distinct folder spelling per run, so the fact store is rebuilt
            # under this partition count instead of being reused
            rows += [tuple(r) for r in q["analyze_summary"](spark, SF + "/" * int(n == "64")).collect()]
            results.append(sorted(rows, key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert results[0] == results[1]
