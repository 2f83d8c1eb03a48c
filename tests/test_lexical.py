"""Tokeniser, masking, line depth, declarations and test headers."""

from pyspark.sql import functions as F

from conftest import corpus
from testsieve.functions import lexical as lx
from testsieve.operators import decls as dc
from testsieve.operators import lines as ln


def _valid(spark, header_lines):
    src = "package p\n\nimport \"testing\"\n\n" + "\n\n".join(header_lines) + "\n"
    lines = ln.file_lines(corpus(spark, {"/x/a_test.go": src}))
    t = dc.with_test_flags(dc.func_decls(lines))
    return {r["name"]: (r["is_valid"], r["bad_format"]) for r in t.collect()}


def test_valid_headers(spark):
    got = _valid(spark, [
        "func TestA(t *testing.T) {\n}",
        "func Test(t *testing.T) {\n}",
        "func Testx(a, b *testing.T) {\n}",
        "func TestB(*testing.T) {\n}",
        "func TestWrapped(\n\tt *testing.T,\n) {\n}",
    ])
    assert got["TestA"] == (True, False)
    assert got["Test"] == (True, True)
    assert got["Testx"] == (True, True)
    assert got["TestB"] == (True, False)
    assert got["TestWrapped"] == (True, False)


def test_invalid_headers(spark):
    got = _valid(spark, [
        "func TestR(t *testing.T) () {\n}",
        "func TestG[X any](t *testing.T) {\n}",
        "func TestAlias(t *tst.T) {\n}",
        "func TestValue(t testing.T) {\n}",
        "func TestParen(t (*testing.T)) {\n}",
        "func TestNone() {\n}",
        "func (s *S) TestRecv(t *testing.T) {\n}",
        "func TestExtra(t *testing.T, x int) {\n}",
        "func testLower(t *testing.T) {\n}",
        "func TestTwo(a *testing.T, b *testing.T) {\n}",
    ])
    assert not any(v for v, _ in got.values()), got


def test_mask_keeps_length_and_lines(spark):
    big = "x" * 200_000
    comment = "/*" + "\n" * 100_000 + "}*/"
    src = f'package p\nvar s = "{big}"\nvar c = `a {{\n}} b`\n{comment}\nfunc f() {{\n}}\n'
    df = spark.createDataFrame([(src,)], "content string")
    m = df.select(lx.mask(F.col("content")).alias("m")).first()["m"]
    assert len(m) == len(src)
    assert m.count("\n") == src.count("\n")
    assert "{" not in m.split("func")[0]


def test_depth_file_lines_and_spans(spark):
    src = ("package p\n\nimport (\n\t\"testing\"\n)\n\n// doc comment {\n"
           "func TestA(t *testing.T) {\n\ts := \"}\"\n\tif true {\n\t\t_ = s\n\t}\n}\n\n// trailing }\n")
    lines = ln.file_lines(corpus(spark, {"/x/a_test.go": src}))
    facts = dc.file_facts(lines).first()
    assert facts["file_lines"] == 13
    assert facts["n_tests"] == 1 and facts["test_lines"] == 6
    assert lines.agg(F.max("depth_after")).first()[0] == 2
    im = [r["import_path"] for r in dc.imports(lines).collect()]
    assert im == ["testing"]


def test_backquoted_import_keeps_quotes(spark):
    src = 'package p\n\nimport (\n\tfoo "a/b"\n\t`c/d`\n)\n'
    im = [r["import_path"] for r in dc.imports(ln.file_lines(corpus(spark, {"/x/a.go": src}))).orderBy("line_no").collect()]
    assert im == ["a/b", "`c/d`"]


def test_file_without_declarations(spark):
    lines = ln.file_lines(corpus(spark, {"/x/a.go": "package p\n\n// only a comment\n"}))
    f = dc.file_facts(lines).first()
    assert f["file_lines"] == 1 and f["n_tests"] == 0
