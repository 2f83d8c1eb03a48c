"""Functions and tests without statements, or on one line, keep their row."""

from conftest import corpus
from testsieve.plans import analyze as an
from testsieve.plans import roundtrip as rt

SRC = """package p

import "testing"

func TestEmpty(t *testing.T) {
}

func (s *S) TestMethod(t *testing.T) {
}

func TestFull(t *testing.T) {
	t.Log()
}

func TestBlank(t *testing.T) {}

func TestLine(t *testing.T) { x := f(func() { a(); b() }); t.Log("; }", x) }

func value() interface{} { return nil }
"""


def facts(spark):
    return an.Facts(corpus(spark, {"/x/a_test.go": SRC}), persist=False)


def test_functions_without_statements_are_counted(spark, monkeypatch):
    monkeypatch.setattr(rt, "facts", lambda *_: facts(spark))
    got = {r["name"]: r["n_statements"] for r in rt.stmt_counts(spark, "").collect()}
    assert got == {"TestEmpty": 0, "TestMethod": 0, "TestFull": 1, "TestBlank": 0, "TestLine": 2, "value": 1}
    got = {r["name"]: r["n_selector_calls"] for r in rt.selector_calls(spark, "").collect()}
    assert got == {"TestEmpty": 0, "TestMethod": 0, "TestFull": 1, "TestBlank": 0, "TestLine": 1, "value": 0}


def test_tests_without_statements_have_an_empty_tree(spark, monkeypatch):
    monkeypatch.setattr(rt, "chain_facts", lambda *_: facts(spark))
    rows = lambda q: {r["name"]: tuple(r)[2:] for r in q(spark, "empty-bodies").collect()}
    got = rows(rt.expand_calls)
    assert got["TestEmpty"] == got["TestBlank"] == (0, 0) and got["TestFull"] == (1, 0) and got["TestLine"][0] > 2 and len(got) == 4
    got = rows(rt.expansion_preorder)
    assert got["TestEmpty"] == got["TestBlank"] == ("",) and got["TestFull"] == ("t.Log()",)
    got = rows(rt.expansion_json)
    assert got["TestEmpty"] == got["TestBlank"] == ("[]",) and got["TestFull"] == ('[{"stmt":"t.Log()"}]',)
