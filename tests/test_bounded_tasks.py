"""Tasks stay small when a corpus grows: partitions follow the bytes of text, tables that plans
read again are columnar."""

from pyspark.sql import functions as F

from conftest import corpus
from testsieve.operators import lines as ln
from testsieve.plans import analyze as an
from testsieve.session import cut_lineage
from testsieve.sources import corpus as cp

SRC = "package p\n\nfunc TestA(t *testing.T) {\n\tt.Log(1)\n}\n"


def files(spark, n):
    return corpus(spark, {f"/src/p/d/f{i}_test.go": SRC for i in range(n)})


def test_partitions_follow_the_text(spark, monkeypatch):
    assert cp.partitions_of(0, 200) == 2
    assert cp.partitions_of(100 << 20, 200) == 100
    assert cp.partitions_of(100 << 30, 200) == 6400
    monkeypatch.setattr(cp, "MOST_TEXT", 2 * len(SRC))
    few, many = (cp.prepare_files(files(spark, n)) for n in (10, 40))
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (5, 20)
    assert many.count() == 40


def test_lines_need_no_further_exchange(spark, monkeypatch):
    monkeypatch.setattr(cp, "MOST_TEXT", len(SRC))
    lines = ln.file_lines(cp.prepare_files(files(spark, 6)))
    assert lines.rdd.getNumPartitions() == 6
    assert lines._jdf.queryExecution().sparkPlan().toString().count("Exchange hashpartitioning") <= 1
    assert "Exchange SinglePartition" not in cp.prepare_files(files(spark, 0))._jdf.queryExecution().executedPlan().toString()


def test_facts_have_a_bucket_for_each_partition(spark, monkeypatch):
    monkeypatch.setattr(cp, "MOST_TEXT", 2 * len(SRC))
    f = an.Facts(files(spark, 12))
    for facts in (f.lines, f.funcs, f.stmts):
        assert facts.select("project", "path").groupBy("project", "path").count().rdd.getNumPartitions() == 6
    assert f.funcs.count() == 12 and f.stmts.count() == 12


def test_a_cut_reads_only_the_columns_that_are_used(spark):
    cut = cut_lineage(files(spark, 3).withColumn("none", F.lit(None)))
    assert sorted(r.path for r in cut.collect()) == [f"/src/p/d/f{i}_test.go" for i in range(3)]
    assert {r.none for r in cut.collect()} == {None}
    plan = cut.select("path")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_files_that_come_from_a_shuffle_are_dealt_again(spark, monkeypatch):
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(cp, "MOST_TEXT", len(SRC))
    grouped = files(spark, usual).groupBy("project", "path").agg(F.max("content").alias("content"))
    assert cp.prepare_files(grouped).rdd.getNumPartitions() == usual + 1
