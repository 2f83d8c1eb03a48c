"""Call expansion rules (R1-R5, W6) and refactoring."""

from pyspark.sql import functions as F

from conftest import corpus
from testsieve.operators import expand as ex
from testsieve.operators import refactor as rf
from testsieve.plans import analyze as an

HEAD = 'package p\n\nimport "testing"\n\n'


def _expand(spark, src):
    f = an.Facts(corpus(spark, {"/x/a_test.go": HEAD + src}), persist=False)
    nodes = ex.expand(f.tests(), f.stmts, f.funcs, spark)
    return sorted((r["node_path"], r["text"].strip()) for r in nodes.collect())


def test_sibling_rule_and_non_expression_statements(spark):
    nodes = _expand(spark, """func TestS(t *testing.T) {
	x := h() + h()
	_ = x
}

func h() int {
	return 1
}
""")
    texts = [t for _, t in nodes]
    # the first h() is entered (its body is one node), the second is a node that is not entered
    assert texts.count("h(...)") == 2
    assert texts.count("return 1") == 1


def test_cycle_is_a_node_but_not_entered(spark):
    nodes = _expand(spark, """func TestC(t *testing.T) {
	a(t)
}

func a(t *testing.T) {
	b(t)
}

func b(t *testing.T) {
	a(t)
}
""")
    assert [p for p, _ in nodes] == [[0], [0, 0], [0, 0, 0]]


def test_helper_outside_test_file_not_expanded(spark):
    files = {"/x/a_test.go": HEAD + "func TestO(t *testing.T) {\n\thelp(t)\n}\n",
             "/x/b.go": "package p\n\nfunc help(t interface{}) {\n\tprintln()\n}\n"}
    f = an.Facts(corpus(spark, files), persist=False)
    nodes = ex.expand(f.tests(), f.stmts, f.funcs, spark).collect()
    assert len(nodes) == 1


def test_continue_becomes_return_outside_inner_loops(spark):
    src = HEAD + """func TestR(t *testing.T) {
	tests := []struct {
		name string
		in   []int
	}{
		{"a", nil},
	}
	for _, tt := range tests {
		if tt.in == nil {
			continue
		}
		for _, v := range tt.in {
			if v > 0 {
				continue
			}
		}
	}
}
"""
    f = an.Facts(corpus(spark, {"/x/a_test.go": src}), persist=False)
    a = an.analysis(f)
    plan, rewritten = an.refactoring(f, a)
    assert plan.first()["generation_status"] == "success"
    text = rewritten.first()["refactored"]
    assert "t.Run(tt.name, func(t *testing.T) {" in text
    assert text.count("return") == 1 and text.count("continue") == 1


def test_status_bad_fields_and_map_key_rename(spark):
    src = HEAD + """func TestB(t *testing.T) {
	tests := []struct{ in int }{{1}}
	for _, tt := range tests {
		_ = tt
	}
}

func TestK(t *testing.T) {
	tests := map[string]struct{ in int }{"a": {1}}
	for _, tt := range tests {
		_ = tt
	}
}
"""
    f = an.Facts(corpus(spark, {"/x/a_test.go": src}), persist=False)
    plan = rf.plan_refactoring(an.analysis(f)).collect()
    by = {r["name"]: r for r in plan}
    assert by["TestB"]["generation_status"] == "badFields"
    assert by["TestK"]["generation_status"] == "success" and by["TestK"]["name_expr"] == "testName"


def test_argument_calls_come_before_the_body(spark):
    nodes = _expand(spark, """func TestA(t *testing.T) {
	outer(inner(t), t.Name(), 1+other())
}

func outer(x, y, z int) {
	println(x)
}

func inner(t *testing.T) int {
	return 1
}

func other() int {
	return 2
}
""")
    assert nodes == [([0], "outer(inner(t), t.Name(), 1+other())"), ([0, 0], "inner(t)"),
                     ([0, 0, 0], "return 1"), ([0, 1], "t.Name()"), ([0, 2], "println(x)")]


def test_method_helper_and_function_literals(spark):
    nodes = _expand(spark, """func TestM(t *testing.T) {
	s := suite{}
	s.check(t)
	t.Run("x", func(t *testing.T) { helper(t) })
}

type suite struct{}

func (s suite) check(t *testing.T) {
	t.Log()
}

func helper(t *testing.T) {
	t.Log()
}
""")
    texts = [t for _, t in nodes]
    assert "t.Log()" in texts                      # the method body was entered
    assert texts.count("t.Log()") == 1             # the literal passed to t.Run was not entered


def test_labelled_and_direct_continue(spark):
    src = HEAD + """func TestC(t *testing.T) {
	tests := []struct{ name string }{{"a"}}
	for _, tt := range tests {
	inner:
		for i := 0; i < 2; i++ {
			continue inner
		}
		continue
	}
}

func TestL(t *testing.T) {
	tests := []struct{ name string }{{"a"}}
outer:
	for _, tt := range tests {
		continue outer
	}
}
"""
    f = an.Facts(corpus(spark, {"/x/a_test.go": src}), persist=False)
    a = an.analysis(f)
    # a labelled loop is a labelled statement, not a range statement: no runner
    assert not {r["name"]: r for r in a.collect()}["TestL"]["is_table_driven"]
    plan, rewritten = an.refactoring(f, a)
    text = rewritten.filter("name = 'TestC'").first()["refactored"]
    assert "continue inner" in text and text.count("return") == 1


def test_immediately_invoked_literal_is_entered(spark):
    nodes = _expand(spark, """func TestI(t *testing.T) {
	func() {
		helper(t)
		t.Log()
	}()
}

func helper(t *testing.T) {
	println()
}
""")
    paths = [p for p, _ in nodes]
    texts = [t for _, t in nodes]
    assert paths == [[0], [0, 0], [0, 0, 0], [0, 1]]
    assert texts[1] == "helper(t)" and texts[2] == "println()" and texts[3] == "t.Log()"
