"""Intermediate tables leave no shuffle files behind, and n-grams travel one order at a time."""

import glob
import time

from fixtures_llm import docs
from pyspark.sql import functions as F

from testsieve.llm import lm_score
from testsieve.llm.common import written


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def test_a_written_table_deletes_its_shuffle(spark):
    before = shuffle_files(spark)
    rows = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()
    out = written(rows, "shuffled")
    for _ in range(40):  # deletion goes on behind the write
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    assert not left
    assert out.count() == 700


def test_orders_are_asked_for_one_by_one(spark, monkeypatch):
    asked = []

    def kept(df, name):
        out = written(df, name)
        if name.startswith("lm-answers"):
            asked.append({r.n for r in out.select("n").distinct().collect()})
        return out

    monkeypatch.setattr(lm_score, "written", kept)
    lm_score.scored(docs(spark, [(i, f"a b c d{i}") for i in range(30)]), 3)
    assert asked == [{1}, {2}, {3}]
