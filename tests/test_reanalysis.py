"""`rewrite_reanalysis` at size: nothing is made twice, nothing sorted is sorted again, and short
ways give what the long ones give."""

import pytest
from pyspark.sql import functions as F

from conftest import corpus
from testsieve.operators import exprtypes as et
from testsieve.operators import refactor as rf
from testsieve.operators import scenarios as sc
from testsieve.operators import statements as sm
from testsieve.plans import analyze as an
from testsieve.plans import roundtrip as rt

SRC = """package p

import "testing"

func TestA(t *testing.T) {
	tests := []struct {
		caseName string
		EXPECTED int
	}{
		{"a", 1},
	}
	for _, tt := range tests {
		t.Log(tt.caseName)
	}
}
"""


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def prepared(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def facts(spark):
    return an.Facts(corpus(spark, {f"/src/p/d/f{i}_test.go": SRC for i in range(4)}))


def test_functions_are_rewritten_and_patched_once(spark, tmp_path, monkeypatch):
    spark.range(60).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    seen = {"files": []}
    patched, built = rf.patched_files, an.Facts.__init__

    def patched_files(lines, rewritten):
        seen["rewritten"] = plan_of(rewritten)
        return patched(lines, rewritten)

    def init(self, files, *more, **named):
        seen["files"].append(plan_of(files))
        built(self, files, *more, **named)
    monkeypatch.setattr(rf, "patched_files", patched_files)
    monkeypatch.setattr(an.Facts, "__init__", init)
    rows = rt.rewrite_reanalysis(spark, str(tmp_path)).collect()
    # keys 0 to 59: shapes 0 and 2 with scenarios, in files that are visited
    assert rows and all(tuple(r)[2:] == (True, 2, True) for r in rows)
    assert "Join" not in seen["rewritten"] and "Aggregate" not in seen["rewritten"]
    assert len(seen["files"]) == 2 and not any("Aggregate" in p or "Exchange" in p for p in seen["files"])


def test_sorted_facts_are_not_sorted_again(spark, facts):
    assert "Sort [" not in prepared(sm.statement_lines(facts.lines))


def test_no_function_is_looked_up_where_every_loop_has_its_type(spark, facts, monkeypatch):
    def index(*_):
        raise AssertionError("no expression is left to follow")
    monkeypatch.setattr(et, "function_index", index)
    rows = an.analysis(facts).collect()
    assert [(r.name_field, r.expected_fields, r.scenario_count, r.imports) for r in rows] == [("caseName", ["EXPECTED"], 1, ["testing"])] * 4


def test_no_job_builds_the_tables_of_cases(spark, facts):
    a = an.analysis(facts)
    for df in (a, rf.plan_refactoring(a, "SubTest")):
        assert "lower(" not in df._jdf.queryExecution().analyzed().toString().lower()
    assert {r.strategy for r in rf.plan_refactoring(a, "SubTest").collect()} == {"subtest"}
    assert {r.strategy for r in rf.plan_refactoring(a, "other").collect()} == {"none"}


def test_files_without_imports_have_an_empty_list(spark):
    f = an.Facts(corpus(spark, {"/src/p/d/f_test.go": "package p\n\nfunc TestA(t *testing.T) {\n}\n"}))
    assert [(r.package, r.imports) for r in an.analysis(f).collect()] == [("p", [])]


def test_flatten_of_texts_with_nothing_to_separate(spark):
    texts = ["\t t.Log(1,\t2) ", "x := f( a )", "", "  ", "a\n", "if x {\n\ty()\n}", "a; b ;", "f(\n\ta,\n)", "a\r", "g()\t\r\t"]
    want = ["t.Log(1, 2)", "x := f( a )", "", "", "a", "if x { y() }", "a; b", "f( a, )", "a", "g()"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, masked string")
    assert [r.f for r in df.orderBy("i").select(sm.flatten(F.col("masked")).alias("f")).collect()] == want


def test_continue_is_found_only_where_it_stands(spark):
    rows = [("a()\ncontinue\nb()",) * 2, ("a()\nb()",) * 2, ('s := "continue"', 's := """"""""""'), ("discontinued()",) * 2]
    got = [r.x for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, m string").orderBy("i").select(
        rf.continue_to_return(F.col("t"), F.col("m")).alias("x")).collect()]
    assert got == ["a()\nreturn\nb()", "a()\nb()", 's := "continue"', "discontinued()"]


def test_deepest_nesting(spark):
    df = spark.createDataFrame([("f(a, b)",), ("x := []T{{1, (2)}}",), ("",), (None,)], "flat string")
    assert sm.deepest(df) == 4 and sm.deepest(df.limit(0)) == 1


def test_literals_are_set_with_an_equals_sign(spark, facts):
    assert [r.var_name for r in sc.local_literals(facts.stmts, facts.levels(), facts.types()).select("var_name").collect()] == ["tests"] * 4
