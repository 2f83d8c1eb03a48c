"""documents hold the texts of the function, its runner and its rewrite."""

from conftest import corpus
from testsieve.plans import analyze as an
from testsieve.plans import roundtrip as rt
from testsieve.sources import sinks as sk

TABLE = """func TestTable(t *testing.T) {
	tests := []struct {
		name string
		want int
	}{
		{"a }", 1}, // }
	}
	for _, tt := range tests {
		t.Log(tt.name, "}", tt.want)
	}
}"""
SRC = 'package p\n\nimport "testing"\n\n' + TABLE + "\n\n// gap\nfunc TestPlain(t *testing.T) {\n\tt.Skip()\n}\n"
RUNNER = 'for _, tt := range tests {\n\t\tt.Log(tt.name, "}", tt.want)\n\t}'


def documents(spark, docs):
    out = sk.scratch_dir(spark, "t-texts")
    sk.write_json_documents(docs, out)
    return {r["TestCase"]["name"]: r for r in sk.read_json_documents(spark, out).collect()}


def test_documents_hold_runner_function_and_refactoring(spark):
    f = an.Facts(corpus(spark, {"/r/a_test.go": SRC}), persist=False)
    a = an.analysis(f)
    plan, rewritten = an.refactoring(f, a)
    back = documents(spark, sk.json_documents(an.document_texts(f, a, rewritten), refactor=an.refactor_results(plan, None)))
    table, plain = back["TestTable"], back["TestPlain"]
    assert table["ScenarioSet"]["runner"] == RUNNER and table["TestCase"]["funcDecl"] == TABLE
    (new,) = table["RefactorResult"]["refactorings"]
    assert new["filePath"] == "/r/a_test.go" and "t.Run(tt.name, func(t *testing.T) {" in new["refactored"]
    assert table["RefactorResult"]["status"] == "success"
    assert (plain["ScenarioSet"]["runner"], plain["RefactorResult"]["refactorings"]) == ("", [])
    assert plain["TestCase"]["funcDecl"] == "func TestPlain(t *testing.T) {\n\tt.Skip()\n}"


def test_query_writes_the_texts(spark, monkeypatch):
    f = an.Facts(corpus(spark, {"/r/a_test.go": SRC}), persist=False)
    monkeypatch.setattr(rt, "facts", lambda *_: f)
    kept, write = [], sk.write_json_documents
    monkeypatch.setattr(sk, "write_json_documents", lambda docs, out: (kept.append(out), write(docs, out)))
    assert rt.json_roundtrip(spark, "document-texts").count() == 2
    back = {r["TestCase"]["name"]: r["ScenarioSet"]["runner"] for r in sk.read_json_documents(spark, kept[0]).collect()}
    assert back == {"TestTable": RUNNER, "TestPlain": ""}
