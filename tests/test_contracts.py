"""Sources, sinks and contracts."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import corpus
from testsieve.functions import classify as cl
from testsieve.sources import corpus as cp
from testsieve.sources import sinks as sk


def test_vendor_substring_and_strict(spark):
    df = corpus(spark, {"/p/vendor/a.go": "", "/p/inventory/vendors.go": "", "/p/x/a.go": ""})
    assert cp.skip_vendor(df).count() == 1
    assert cp.skip_vendor(df, strict=True).count() == 2


def test_error_positions(spark):
    files = corpus(spark, {"/p/a.go": "", "/p/b.go": "", "/p/c.go": ""})
    errs = spark.createDataFrame([("p", "/p/a.go:3:1", "x"), ("p", ":/p/b.go", "x"), ("p", "-", "x")],
                                 "project string, position string, message string")
    left = {r["path"] for r in cp.skip_error_files(files, errs).collect()}
    assert left == {"/p/b.go", "/p/c.go"}


def test_csv_append_header_contract(spark):
    out = sk.scratch_dir(spark, "t-csv")
    df = spark.createDataFrame([("a", 1, 0.25, True, ["x", "y"])],
                               "p string, n long, d double, b boolean, arr array<string>")
    sk.write_csv(df, out)
    sk.write_csv(df, out, append=True)
    with pytest.raises(sk.ContractError):
        sk.write_csv(df.select("n", "p", "d", "b", "arr"), out, append=True)
    back = spark.read.option("header", True).csv(out).collect()
    assert len(back) == 2 and back[0]["arr"] == "x, y" and back[0]["b"] == "true"


def test_schema_contract(spark):
    df = spark.createDataFrame([(1,)], "a long")
    sk.check_schema(df, T.StructType([T.StructField("a", T.LongType())]))
    with pytest.raises(sk.ContractError):
        sk.check_schema(df, T.StructType([T.StructField("a", T.StringType())]))


def test_format_detection_and_enum_decode(spark):
    assert sk.sink_format("out/REPORT.CSV") == "CSV"
    with pytest.raises(sk.ContractError):
        sk.sink_format("out/report.md")
    df = spark.createDataFrame([("a.TXT",), ("b.json",), ("c",), ("d.csv.bak",)], "p string")
    assert [r[0] for r in df.select(cl.detect_format(F.col("p"))).collect()] == ["Txt", "JSON", "Unknown", "Unknown"]
    e = spark.createDataFrame([("NotRun",), ("COMPILATIONERROR",), ("bogus",)], "x string")
    assert [r[0] for r in e.select(cl.decode_execution_result(F.col("x"))).collect()] == \
        ["notRun", "compilationError", "notRun"]


def test_run_classification_order(spark):
    rows = [(False, "x [build failed] --- FAIL"), (False, "--- FAIL"), (False, "?"),
            (True, "no tests to run --- PASS"), (True, "--- SKIP --- PASS"), (True, "--- PASS"), (True, "")]
    df = spark.createDataFrame(rows, "ok boolean, out string")
    got = [r[0] for r in df.select(cl.run_result(F.col("ok"), F.col("out"))).collect()]
    assert got == ["compilationError", "fail", "fail", "notRun", "skip", "pass", "fail"]


def test_scan_go_tree_and_text_sink(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "a_test.go").write_text('package pkg\n\nimport "testing"\n\nfunc TestA(t *testing.T) {\n}\n')
    (root / "pkg" / "b.go").write_text("package pkg\n")
    (root / "pkg" / "notes.txt").write_text("not go")
    files = cp.read_go_tree(spark, str(root))
    rows = {r["path"].split("/")[-1]: r for r in files.collect()}
    assert set(rows) == {"a_test.go", "b.go"} and rows["b.go"]["project"] == "proj"
    from testsieve.plans import statistics as st
    stats = st.statistics(files).first()
    assert (stats["testCases"], stats["testFiles"], stats["totalFiles"]) == (1, 1, 2)
    out = sk.scratch_dir(spark, "t-text")
    sk.write_text(st.statistics_report_text(st.statistics(files)).select("value"), out)
    text = "".join(r[0] + "\n" for r in spark.read.text(out).collect())
    assert "Total number of test cases: 1" in text
    with pytest.raises(sk.ContractError):
        sk.write_text(files, out)


def test_shorter_header_refused_and_same_named_packages(spark):
    out = sk.scratch_dir(spark, "t-csv2")
    df = spark.createDataFrame([("a", 1)], "p string, n long")
    sk.write_csv(df, out)
    with pytest.raises(sk.ContractError):
        sk.write_csv(df.select("p"), out, append=True)
    from testsieve.plans import analyze as an
    src = 'package util\n\nimport "testing"\n\nfunc TestX(t *testing.T) {\n}\n'
    files = corpus(spark, {"/r/a/util/x_test.go": src, "/r/b/util/x_test.go": src})
    docs = sk.json_documents(an.analysis(an.Facts(files, persist=False)))
    rows = docs.select("path", "doc_key").collect()
    assert len(rows) == 2 and len({r["doc_key"] for r in rows}) == 1 and len({r["path"] for r in rows}) == 2


def test_user_defined_task_by_top_dir(spark):
    from pyspark.sql import functions as F
    from testsieve.plans import task as tk
    src = ('package p\n\nimport "testing"\n\nfunc TestA(t *testing.T) {\n\tt.Fatal("x // t.Fatal(")\n'
           '\tt.Fatal()\n}\n')
    files = corpus(spark, {"/r/proj/a/x_test.go": src, "/r/proj/b/y_test.go": src, "/r/proj/z.go": src},
                   project="proj")

    def extract(lines):
        hit = F.col("masked").rlike(r"\bt\s*\.\s*Fatal\s*\(")
        return lines.groupBy("project", "path").agg(F.count_if(hit).alias("fatals"))

    def report(rows):
        return rows.filter(F.col("group").isNotNull()).groupBy("group").agg(F.sum("fatals").alias("fatals"))

    out = {r["group"]: r["fatals"] for r in tk.run_task(tk.CorpusTask("fatals", extract, report), files,
                                                         by="top_dir").collect()}
    # the call inside the string literal does not count; the file at the root is ignored
    assert out == {"proj/a": 2, "proj/b": 2}


def test_json_documents_append_and_read_back(spark):
    from testsieve.plans import analyze as an
    src = 'package util\n\nimport "testing"\n\nfunc TestX(t *testing.T) {\n}\n'
    docs = sk.json_documents(an.analysis(an.Facts(corpus(spark, {"/r/u/x_test.go": src}), persist=False)))
    out = sk.scratch_dir(spark, "t-json")
    sk.write_json_documents(docs, out)
    sk.write_json_documents(docs, out, append=True)
    back = sk.read_json_documents(spark, out).collect()
    assert len(back) == 2 and back[0]["RefactorResult"]["originalTestResult"] == "notRun"
    assert back[0]["TestCase"]["name"] == "TestX" and back[0]["ImportedPackages"] == ["testing"]
