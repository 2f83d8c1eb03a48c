"""Plan shape: the properties the design relies on at scale, checked with the
physical plan (AQE off for a deterministic plan)."""

import re

from conftest import corpus
from testsieve.plans import statistics as st
from testsieve.sources import corpus as cp


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statistics_plan_shape(spark, tmp_path):
    src = {f"/src/p{i % 3}/pkg/f{i}_test.go": f"package pkg\n\nfunc TestA{i}(t *testing.T) {{\n}}\n"
           for i in range(40)}
    out = str(tmp_path / "corpus")
    corpus(spark, src).write.parquet(out)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files = cp.read_source_table(spark, out)
        facts = st.statistics_facts(files)
        plan = _plan(facts)
        # the vendor predicate and the column projection reach the Parquet scan
        assert "PushedFilters: [IsNotNull(path), Not(StringContains(path,vendor))]" in plan
        assert "ReadSchema: struct<project:string,path:string,content:string>" in plan
        # exactly one exchange of file rows, on the file key; windows and the
        # per-file aggregates reuse it
        exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert len(exchanges) == 1 and exchanges[0].startswith("project#")
        assert plan.count("Window [") >= 3
        report = _plan(st.statistics(files))
        groups = re.findall(r"Exchange hashpartitioning\((\w+)#", report)
        # + partial-aggregate exchanges by report group only
        assert sorted(groups) == ["project", "projectDir", "projectDir"]
        assert "BroadcastHashJoin" not in facts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
