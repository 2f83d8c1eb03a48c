"""J1 by owner and package, J4 through calls, W3 in helpers, F6/F16 on one line, positions,
JSON arrays, the fact store's bucket count."""

import pytest

from conftest import corpus
from testsieve.operators import expand as ex
from testsieve.operators import positions as ps
from testsieve.plans import analyze as an
from testsieve.session import cut_lineage
from testsieve.sources import factstore
from testsieve.sources import jsonarray as ja

HEAD = 'package p\n\nimport (\n\t"fmt"\n\t"testing"\n\tm "x/y/v2"\n)\n\n'

OWNERS = HEAD + """type Base struct {
	n int
}

func (b *Base) Deep() {
	_ = 1
}

type Mid struct {
	*Base
	subs []*Sub
	byName map[string]Sub
}

type Sub struct {
	Mid
}

func (s Sub) Do(n int) *Sub {
	return nil
}

func (s Sub) Println() {
	_ = 2
}

func (s Sub) Open() {
	_ = 3
}

var shared = make(map[string]*Sub)

func pair() (int, *Sub) {
	return 1, nil
}

func TestOwners(t *testing.T) {
	fmt.Println(1)
	m.Open()
	var s Sub
	s.Deep()
	s.subs[0].Do(1).Do(2).Open()
	for _, x := range s.byName { x.Println() }
	n, p := pair()
	p.Open()
	shared["a"].Open()
	fmt := Sub{}
	fmt.Println()
	Sub{}.Open()
	unknown.Open()
}
"""


@pytest.fixture(scope="module")
def owners(spark):
    return an.Facts(corpus(spark, {"/x/a_test.go": OWNERS}), store="checkpoint")


def test_owners_of_calls(owners):
    got = {(r.stmt_ord, r.owner, r.callee): r.def_line for r in owners.calls().collect()}
    line = {n: 1 + OWNERS.split("\n").index(t) for n, t in (("Deep", "func (b *Base) Deep() {"), ("Println", "func (s Sub) Println() {"),
                                                            ("Open", "func (s Sub) Open() {"), ("pair", "func pair() (int, *Sub) {"))}
    assert got == {(4, "s", "Deep"): line["Deep"], (5, "s.subs[0].Do(1).Do(2)", "Open"): line["Open"], (6, "x", "Println"): line["Println"],
                   (7, "", "pair"): line["pair"], (8, "p", "Open"): line["Open"], (9, 'shared["""]', "Open"): line["Open"],
                   (11, "fmt", "Println"): line["Println"], (12, "Sub{}", "Open"): line["Open"]}


def test_import_is_no_method(owners):
    texts = [(r.node_path, r.text.strip()) for r in owners.expand().collect()]
    assert ([0], "fmt.Println(1)") in texts and [0, 0] not in [p for p, _ in texts]
    assert ([10, 0], "_ = 2") in texts


def test_packages_of_one_folder(spark):
    one = 'package b\n\nimport "testing"\n\nfunc TestA(t *testing.T) {\n\th(t)\n}\n\nfunc h(t *testing.T) {\n\t_ = 1\n}\n'
    f = an.Facts(corpus(spark, {"/x/a_test.go": one, "/x/b_test.go": one.replace("package b", "package b_test").replace("TestA", "TestB").replace("_ = 1", "_ = 2")}), store="checkpoint")
    got = sorted((r.path, r.text.strip()) for r in f.expand().filter("level = 1").collect())
    assert got == [("/x/a_test.go", "_ = 1"), ("/x/b_test.go", "_ = 2")]


TABLES = HEAD + """type C struct {
	name string
	f    []int
}

type LL []C

type holder struct {
	list LL
}

func cases() []C {
	return nil
}

func both() (int, map[string]C) {
	return 0, nil
}

func fill() {
	a := []C{{"1", nil}}
	b := []C{{"2", nil}, {"3", nil}}
	_, _ = a, b
}

func outer() {
	fill()
}

func TestResult(t *testing.T) {
	for range cases() {
	}
}

func TestSecond(t *testing.T) {
	_, m := both()
	for _, c := range m {
		_ = c
	}
}

func TestField(t *testing.T) {
	h := holder{}
	rest := h.list[1:]
	for _, c := range rest {
		_ = c
	}
}

func TestHelper(t *testing.T) {
	tests := []C{{"0", nil}}
	outer()
	for _, c := range tests {
		_ = c
	}
}

func TestForeign(t *testing.T) {
	for _, c := range m.List() {
		_ = c
	}
}

func TestNamed(t *testing.T) {
	tests := LL{{"0", nil}, {"1", nil}}
	for _, c := range tests {
		_ = c
	}
}

func TestOne(t *testing.T) {
	a := 1; b := 2
	tests := []C{{"0", nil}}
	for _, c := range tests { t.Run(c.name, func(t *testing.T) {}) }
}
"""


def test_types_sources_and_lines(spark):
    f = an.Facts(corpus(spark, {"/x/t_test.go": TABLES}), store="checkpoint")
    a = {r["name"]: r for r in an.analysis(f).collect()}
    kind = {n: (r.range_resolution, r.data_structure, r.scenario_source, r.scenario_count) for n, r in a.items()}
    assert kind == {"TestResult": ("resolved", "structList", "", 0), "TestSecond": ("resolved", "map", "", 0), "TestField": ("resolved", "structList", "", 0),
                    "TestHelper": ("resolved", "structList", "helper", 1), "TestForeign": ("unresolved", "none", "", 0),
                    "TestNamed": ("resolved", "structList", "local", 2), "TestOne": ("resolved", "structList", "local", 1)}
    assert [(x["name"], x["type"]) for x in a["TestResult"].fields] == [("name", "string"), ("f", "[]int")]
    assert a["TestOne"].uses_subtest and a["TestOne"].name_field == "name"
    n = {r.func_line: r.n for r in f.stmts.groupBy("func_line").agg({"stmt_ord": "max"}).withColumnRenamed("max(stmt_ord)", "n").collect()}
    assert n[1 + TABLES.split("\n").index("func TestOne(t *testing.T) {")] == 4


def test_positions(spark):
    text = spark.createDataFrame([("p", "x.go:3:1: bad\n  y_test.go:70: worse, see x.go:200")], "project string, message string")
    found = ps.positions_in(text, "message", keep=("project",))
    assert [(r.nth, r.path, r.line) for r in found.orderBy("nth").collect()] == [(0, "x.go", 3), (1, "y_test.go", 70), (2, "x.go", 200)]
    spans = spark.createDataFrame([("p", "x.go", 1, 150, "Long"), ("p", "x.go", 2, 5, "inner"), ("p", "y_test.go", 71, 80, "Late")],
                                  "project string, path string, start_line int, end_line int, name string")
    got = {(r.path, r.line): r["name"] for r in ps.outermost(found.drop("nth"), spans).collect()}
    assert got == {("x.go", 3): "Long", ("y_test.go", 70): None, ("x.go", 200): None}
    plan = ps.enclosing(found, spans)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_json_array(spark, tmp_path):
    folder = f"{tmp_path}/array"
    frame = lambda *x: spark.createDataFrame([(i, f'"{t}"') for i, t in x], "i int, element string")
    assert ja.append_elements(frame((2, "b"), (1, "a")), folder, ["i"]) == 1 and not ja.is_bare(spark, folder)
    assert ja.append_elements(frame((1, "c"), (2, "d")), folder, ["i"], flatten=False) == 2
    # an append that fails before its manifest leaves the array as it was
    (tmp_path / "array" / "parts" / "lost").mkdir()
    (tmp_path / "array" / "manifest" / "v3").mkdir()
    rows = ja.read_elements(spark, folder).orderBy("part", "place").collect()
    assert [(r.part, r.nested, r.element) for r in rows] == [(0, False, '"a"'), (0, False, '"b"'), (1, True, '"c"'), (1, True, '"d"')]
    assert sum(r.elements for r in ja.manifest(spark, folder)) == 3
    assert ja.read_elements(spark, folder, version=1).count() == 2
    assert ja.append_elements(frame((1, "z")), f"{tmp_path}/one", ["i"]) == 1 and ja.is_bare(spark, f"{tmp_path}/one")


def test_trees_of_any_depth(spark):
    tree = '[{"stmt":"a","children":[{"stmt":"b","children":[{"stmt":"c"}]},{"stmt":"d"}]},{"stmt":"e"}]'
    df = spark.createDataFrame([(1, tree), (2, "[]")], "k int, j string").selectExpr("k", "parse_json(j) AS ParsedStatements")
    got = sorted((r.node_path, r.level, r.text) for r in ex.expansion_rows(df, ["k"]).collect())
    assert got == [([0], 0, "a"), ([0, 0], 1, "b"), ([0, 0, 0], 2, "c"), ([0, 1], 1, "d"), ([1], 0, "e")]


def test_bucket_count(spark):
    assert factstore.bucket_count(None, 200, 100_000, 512 << 20) == 200
    assert factstore.bucket_count(100 << 40, 200, 100_000, 512 << 20) == 100_000
    assert factstore.bucket_count(1 << 40, 200, 100_000, 512 << 20) == 2048
    frame = cut_lineage(corpus(spark, {"/x/a_test.go": OWNERS}))
    assert factstore.estimated_bytes(frame.union(frame)) is None or factstore.estimated_bytes(frame) < 1 << 60
    assert an.Facts(frame).tests().count() == 1  # the default store, from a frame without statistics


def test_stream_of_files(spark, tmp_path):
    """Changed, removed, repeated and older rows; a batch that is run twice changes nothing."""
    from testsieve.streaming import files as sf
    one = 'package p\n\nimport "testing"\n\nfunc TestA(t *testing.T) {\n\tt.Log(1)\n}\n'
    two = one + "\nfunc TestB(t *testing.T) {\n\tt.Log(1)\n\tt.Log(2)\n}\n"
    batches = [[("p", "/p/a_test.go", one, 1), ("p", "/p/b.go", "package p\n", 1), ("q", "/q/vendor/x_test.go", one, 1), ("q", "/q/c_test.go", two, 1)],
               [("p", "/p/a_test.go", two, 3), ("p", "/p/a_test.go", one, 2), ("q", "/q/c_test.go", None, 2)],
               [("p", "/p/a_test.go", one, 2), ("p", "/p/b.go", "package p\n\nvar x = 1\n", 2)]]
    folder = f"{tmp_path}/out"
    for i, rows in enumerate(batches):
        for _ in range(2):
            sf.replace_files(spark, spark.createDataFrame(rows, sf.SOURCE_SCHEMA), i, folder)
    stats = {r.projectDir: (r.testCases, r.testFiles, r.totalFiles, r.testLines, round(r.percentTestLines, 3)) for r in sf.statistics(spark, folder).collect()}
    assert stats == {"p": (2, 1, 2, 7, round(7 / 15 * 100, 3)), "q": (0, 0, 0, 0, 0.0)}
    assert sorted((r.path, r["name"], r.start_line) for r in sf.func_decls(spark, folder).collect()) == [("/p/a_test.go", "TestA", 5), ("/p/a_test.go", "TestB", 9)]
