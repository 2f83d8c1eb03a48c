"""Joins of facts go by sizes that a run has measured; keys are dealt before texts are made."""

import pytest
from pyspark.sql import functions as F

from testsieve.plans import roundtrip as rt
from testsieve.sources import fixtures as fx


def written(spark, tmp_path, **tables):
    for name, (column, n) in tables.items():
        spark.range(n).select(F.col("id").alias(column)).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_facts_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    calls = rt.selector_calls(spark, written(spark, tmp_path, orders=("o_orderkey", 200)))
    assert "Broadcast" not in calls._jdf.queryExecution().executedPlan().toString()
    assert calls.count() == len({r.k for r in fx.shape_functions(spark, str(tmp_path)).filter("f % 17 != 16 and f % 19 != 18").collect()})


@pytest.mark.parametrize("corpus, table, key", [
    (fx.chain_corpus, "part", "p_partkey"), (fx.owner_corpus, "customer", "c_custkey"),
    (fx.table_corpus, "customer", "c_custkey"), (fx.packed_corpus, "customer", "c_custkey")])
def test_texts_of_one_row_group_are_made_in_many_tasks(spark, tmp_path, monkeypatch, corpus, table, key):
    monkeypatch.setattr(fx, "FUNCS_PER_TASK", 10)
    files = corpus(spark, written(spark, tmp_path, **{table: (key, 40)}))
    assert files.rdd.getNumPartitions() == 4
    assert files.count() == 40
