"""Scenario analysis edge cases."""

from conftest import corpus
from testsieve.plans import analyze as an

HEAD = 'package p\n\nimport "testing"\n\n'


def _analyse(spark, body, extra=""):
    src = HEAD + extra + body + "\n"
    a = an.analysis(an.Facts(corpus(spark, {"/x/a_test.go": src}), persist=False))
    return {r["name"]: r for r in a.collect()}


def test_struct_list_with_subtest_name_field(spark):
    r = _analyse(spark, """func TestA(t *testing.T) {
	cases := []struct {
		desc     string
		input    int
		expected int
		check    func(int) bool
	}{
		{"a", 1, 2, nil},
		{"b", 2, 3, nil},
		{"c", 3, 4, nil},
	}
	for _, c := range cases {
		t.Run(c.input, func(t *testing.T) {})
	}
}""")["TestA"]
    assert r["data_structure"] == "structList" and r["scenario_count"] == 3
    assert r["uses_subtest"] and r["name_field"] == "input"   # any field named by the Run selector
    assert r["expected_fields"] == ["expected"] and r["has_function_fields"]


def test_map_with_non_string_key_and_named_type(spark):
    r = _analyse(spark, """func TestM(t *testing.T) {
	tests := map[int]tc{
		1: {name: "a"},
		2: {name: "b"},
	}
	for k, v := range tests {
		_ = k
		_ = v
	}
}""", extra="type tc struct {\n\tname string\n\twantErr bool\n}\n\n")["TestM"]
    assert r["data_structure"] == "map" and r["scenario_count"] == 2
    assert r["name_field"] == "name" and r["expected_fields"] == ["wantErr"]


def test_last_range_loop_wins_and_pointer_elements_do_not_match(spark):
    r = _analyse(spark, """func TestL(t *testing.T) {
	a := []struct{ name string }{{"x"}}
	for _, x := range a {
		_ = x
	}
	b := []*struct{ name string }{{"y"}}
	for _, y := range b {
		_ = y
	}
}""")["TestL"]
    # runner = the second loop; its own literal has pointer elements and does not
    # match, so the search goes on backwards and the earlier literal of the same
    # element type wins (match by type, not by variable)
    assert r["runner_ord"] == 4 and r["data_structure"] == "structList"
    assert r["scenario_count"] == 1 and r["scenarios"] == ['{"""}']


def test_package_level_table(spark):
    r = _analyse(spark, """func TestP(t *testing.T) {
	for _, tt := range table {
		t.Log(tt.name)
	}
}""", extra='var table = []struct{ name string }{\n\t{"a"},\n\t{"b"},\n}\n\n')["TestP"]
    assert r["data_structure"] == "structList" and r["scenario_count"] == 2 and r["name_field"] == "name"


def test_loop_over_helper_result_is_not_table_driven(spark):
    r = _analyse(spark, """func TestH(t *testing.T) {
	for _, tt := range makeCases() {
		t.Log(tt)
	}
}""")["TestH"]
    assert r["data_structure"] == "none" and not r["is_table_driven"]


def test_literal_in_range_clause(spark):
    r = _analyse(spark, """func TestC(t *testing.T) {
	for _, tt := range []struct{ name string }{{"a"}, {"b"}} {
		t.Log(tt.name)
	}
}""")["TestC"]
    assert r["data_structure"] == "structList" and r["scenario_count"] == 2


def test_nested_run_does_not_count_and_unnamed_tester(spark):
    rows = _analyse(spark, """func TestN(t *testing.T) {
	tests := []struct{ name string }{{"a"}}
	for _, tt := range tests {
		if true {
			t.Run(tt.name, func(t *testing.T) {})
		}
	}
}

func TestU(*testing.T) {
	tests := []struct{ name string }{{"a"}}
	for _, tt := range tests {
		_ = tt
	}
}""")
    assert not rows["TestN"]["uses_subtest"]
    assert rows["TestU"]["tester"] is None and rows["TestU"]["is_table_driven"]


def test_keyed_array_array_type_and_map_of_bool(spark):
    rows = _analyse(spark, """func TestKeyed(t *testing.T) {
	tests := []struct{ name string }{0: {"a"}, 1: {"b"}}
	for _, tt := range tests {
		_ = tt
	}
}

func TestArray(t *testing.T) {
	tests := [2]struct{ name string }{{"a"}, {"b"}}
	for _, tt := range tests {
		_ = tt
	}
}

func TestBool(t *testing.T) {
	tests := map[string]bool{"a": true, "b": false}
	for name, ok := range tests {
		_, _ = name, ok
	}
}

func TestNamedString(t *testing.T) {
	tests := []struct {
		name label
		desc string
	}{{"a", "x"}}
	for _, tt := range tests {
		_ = tt
	}
}""", extra="type label string\n\n")
    assert rows["TestKeyed"]["data_structure"] == "structList" and rows["TestKeyed"]["scenario_count"] == 0
    assert rows["TestArray"]["data_structure"] == "structList" and rows["TestArray"]["scenario_count"] == 2
    b = rows["TestBool"]
    assert b["data_structure"] == "map" and b["scenario_count"] == 2 and b["name_field"] == "map key"
    assert b["expected_fields"] == [] and b["is_table_driven"]
    # a named string type is not the basic `string`: the `desc` field is chosen
    assert rows["TestNamedString"]["name_field"] == "desc"


def test_named_function_field_type(spark):
    r = _analyse(spark, """func TestF(t *testing.T) {
	tests := []struct {
		name  string
		check checkFn
	}{{"a", nil}}
	for _, tt := range tests {
		_ = tt
	}
}""", extra="type checkFn func(int) bool\n\n")["TestF"]
    assert r["has_function_fields"] and r["name_field"] == "name"
