"""The generated corpus is made by many tasks: keys are dealt by file, texts follow behind that."""

from testsieve.sources import fixtures as fx


def test_texts_are_made_behind_the_exchange(spark, tmp_path, monkeypatch):
    keys = [(k,) for k in range(60)] + [(7,), (None,)]
    spark.createDataFrame(keys, "o_orderkey bigint").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(fx, "FUNCS_PER_TASK", 10)
    corpus = fx.shape_corpus(spark, str(tmp_path))
    plan = corpus._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file" in plan and ", 7)" in plan  # 62 rows, 10 a task
    assert plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "func Test" not in below and "/src/" not in below
    got = {r.path: r.content for r in corpus.collect()}
    assert len(got) == 13
    one = got["/src/proj01/pkg0/f1_test.go"]  # k 5 to 9 with k 7 twice
    assert one.startswith('package pkg0\n\nimport (\n\t"testing"\n\tstr "strings"\n)\n\n') and one.endswith("\n\n// trailing }\n")
    names = [p for p in ("TestK5(", "TestK6(", "TestK7(", "TestK8(", "TestK9(") if p in one or p.replace("TestK", "helper") in one or p.replace("TestK", "Test_") in one]
    assert len(names) == 5 and one.index("K6" if "K6" in one else "6(") < one.index("K7")
    assert one.count("TestK7") == 2
