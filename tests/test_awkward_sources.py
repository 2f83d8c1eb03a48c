"""Ordinary Go that once came out wrong: deep nesting, type chains, grouped declarations,
comments among statements and imports, one-line loops."""

from conftest import corpus
from pyspark.sql import functions as F

from testsieve.functions import lexical as lx
from testsieve.operators import expand as ex
from testsieve.operators import refactor as rf
from testsieve.operators import statements as sm
from testsieve.plans import analyze as an

DEEP = "(" * 30 + "1" + ")" * 30
SOURCE = '''package p

import (
	"testing" // std
	/* "dead" */
	tool "a/b"
)

type L []B
type (
	B A
	A struct {
		name string
		opts struct{ x int; label string; y int }
		want int
	}
)

var (
	cases = []B{
		{"a", o(1), 2},
		{"b", o(2), 3},
	}
)

func TestChain(t *testing.T) {
	a := 1
	// a comment

	_ = a
\t
	for _, tt := range cases {
		t.Run(
			tt.name, func(t *testing.T) {
				t.Log(tt.want)
			})
	}
}

func TestDeclared(t *testing.T) {
	var tests []A
	tests = append(tests, A{})
	for _, tt := range tests { t.Log(tt.want) }
}
'''


def test_analysis_of_awkward_source(spark):
    facts = an.Facts(corpus(spark, {"p/a_test.go": SOURCE}), None, store="checkpoint")
    counts = {r.name: r.n_statements for r in facts.funcs.join(sm.count_statements(facts.stmts), ["project", "path", "func_line"]).collect()}
    assert counts == {"TestChain": 3, "TestDeclared": 3}
    got = {r.name: r for r in an.analysis(facts).collect()}
    chain, declared = got["TestChain"], got["TestDeclared"]
    assert chain.imports == ["testing", "a/b"]
    assert (chain.data_structure, chain.scenario_count, chain.uses_subtest, chain.name_field) == ("structList", 2, True, "name")
    assert [(f.name, f.type) for f in chain.fields] == [("name", "string"), ("opts", "struct{x int;label string;y int}"), ("want", "int")]
    assert declared.data_structure == "structList"


def test_calls_at_any_depth(spark):
    df = spark.createDataFrame([(f"_ = g({DEEP})",), ("_ = h(1)",), (f"f(a, k({DEEP}))",)], "flat string")
    deep = sm.deepest(df)
    rows = df.select(ex.statement_calls(F.col("flat"), deep).alias("c"), ex.is_expr_stmt(F.col("flat"), deep).alias("e")).collect()
    assert [[c.callee for c in r.c] for r in rows] == [["g"], ["h"], ["f"]]
    assert [r.e for r in rows] == [False, False, True] and len(rows[2].c[0].arg_calls) == 1


def rewritten(spark, text):
    df = spark.createDataFrame([(text, None, "tt.name", "t")], "text string, new_key string, name_expr string, t_var string")
    return rf.rewrite_runner(df.withColumn("masked", lx.mask(F.col("text")))).first().new_runner


def test_rewrite(spark):
    assert rewritten(spark, "for _, tt := range tests { t.Log(tt.name) }") == (
        "for _, tt := range tests {\n\tt.Run(tt.name, func(t *testing.T) {\n\t\tt.Log(tt.name)\n\t})\n}")
    inline = 'for _, tt := range []struct {\n\tname string\n}{\n\t{"a"},\n} {\n\tt.Log(tt.name)\n}'
    assert rewritten(spark, inline).startswith('for _, tt := range []struct {\n\tname string\n}{\n\t{"a"},\n} {\n\tt.Run(')
    body = rewritten(spark, 'for _, tt := range tests {\n\tt.Log("we continue"); continue\n\tfor i := range x { if i == 1 { continue } }\n\tcontinue outer\n}')
    assert '"we continue"); return' in body and "{ if i == 1 { continue } }" in body and "continue outer" in body
