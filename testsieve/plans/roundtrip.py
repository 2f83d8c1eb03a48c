"""Round-trip (RT) queries on the corpus generated from ``orders``.

Each query runs the engine on the generated source text; its oracle recomputes
the answer from the generating keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.operators import decls as dc
from testsieve.operators import lines as ln
from testsieve.plans import statistics as st
from testsieve.sources import corpus as cp
from testsieve.sources import fixtures as fx


def shapes(spark: SparkSession, sf_dir: str):
    return fx.shape_corpus(spark, sf_dir), fx.shape_load_errors(spark, sf_dir)


def visited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, errs = shapes(spark, sf_dir)
    return ln.file_lines(cp.prepare_files(files, errs))


def _per_project_files(files: DataFrame) -> DataFrame:
    return files.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("path").endswith("_test.go")).alias("n_test_files"))


def scan_sources(spark, sf_dir):
    """Files and test files per project, as scanned."""
    files, _ = shapes(spark, sf_dir)
    return _per_project_files(files.select("project", "path"))


def skip_vendor(spark, sf_dir):
    """Files per project once vendored paths are skipped."""
    files, _ = shapes(spark, sf_dir)
    return _per_project_files(cp.skip_vendor(files.select("project", "path")))


def skip_error_files(spark, sf_dir):
    """Files per project once files named by load errors are skipped."""
    files, errs = shapes(spark, sf_dir)
    return _per_project_files(cp.skip_error_files(cp.skip_vendor(files.select("project", "path")), errs))


def distinct_files(spark, sf_dir):
    """A file listed twice (package variants) is visited once."""
    files, errs = shapes(spark, sf_dir)
    f_no = F.regexp_extract(F.col("path"), r"/f(\d+)(?:_test)?\.go$", 1).cast("long")
    twice = files.unionByName(files.filter(f_no % 7 == 0))
    return _per_project_files(cp.prepare_files(twice.select("project", "path"), errs))


def statistics_by_dir(spark, sf_dir):
    """The statistics report per top-level directory."""
    files, errs = shapes(spark, sf_dir)
    return st.statistics(files, errs, by="top_dir")


def func_decls(spark, sf_dir):
    """every top-level function with its line span."""
    f = dc.func_decls(visited_lines(spark, sf_dir))
    return f.select("project", "path", "name", "start_line", "end_line", "is_method")


def valid_tests(spark, sf_dir):
    """valid tests and their bad-format flag."""
    t = dc.valid_tests(dc.func_decls(visited_lines(spark, sf_dir)))
    return t.select("project", "path", "name", "bad_format")


def bad_format(spark, sf_dir):
    """count of valid tests whose fifth letter is not upper case, per project."""
    t = dc.valid_tests(dc.func_decls(visited_lines(spark, sf_dir)))
    return t.groupBy("project").agg(F.count_if("bad_format").alias("n_bad_format"),
                                    F.count(F.lit(1)).alias("n_tests"))


def test_cases(spark, sf_dir):
    """test rows with the package *as declared* in the file."""
    lines = visited_lines(spark, sf_dir)
    t = dc.valid_tests(dc.func_decls(lines)).join(dc.file_packages(lines), ["project", "path"])
    return t.select("project", F.col("path").alias("filePath"), "package", "name")


def test_lines(spark, sf_dir):
    """lines per test."""
    t = dc.valid_tests(dc.func_decls(visited_lines(spark, sf_dir)))
    return t.select("path", "name", "test_lines")


def test_label(spark, sf_dir):
    """one-line label of each test."""
    return test_cases(spark, sf_dir).select(F.format_string(
        "TestCase{Name: %s, Package: %s, FilePath: %s, Project: %s}",
        "name", "package", "filePath", "project").alias("label"))


def line_depth(spark, sf_dir):
    """Physical lines and deepest brace level per file (code only)."""
    lines = visited_lines(spark, sf_dir)
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"),
                                     F.max("depth_after").cast("long").alias("max_depth"))


def imports(spark, sf_dir):
    """import paths per file in file order."""
    im = dc.imports(visited_lines(spark, sf_dir))
    from pyspark.sql import Window
    w = Window.partitionBy("project", "path").orderBy("line_no")
    return im.select("path", F.row_number().over(w).alias("import_ord"), "import_path")


# ---------------------------------------------------------------- analysis

# Fact store: the fact tables of one corpus are built once per session and read
# by every report on it (reports never touch the source text again).
_STORE: dict = {}


def _stored(spark, sf_dir, kind, build):
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _STORE:
        _STORE[key] = build()
    return _STORE[key]


def clear_store(spark: SparkSession | None = None) -> None:
    """Forget every stored result (new data under a known path is read again); with a session
    also drop the fact tables written for it."""
    _STORE.clear()
    if spark is not None:
        from testsieve.sources.factstore import release
        release(spark)


def facts(spark, sf_dir):
    from testsieve.plans.analyze import Facts

    from testsieve.session import cut_lineage

    def build():
        files, errs = shapes(spark, sf_dir)
        return Facts(cut_lineage(files), errs)  # the texts are made once: they are measured, then read
    return _stored(spark, sf_dir, "shapes", build)


def analyze_report(spark, sf_dir):
    """The analyze report (16 columns) of every valid test."""
    from testsieve.plans import analyze as an
    return an.analyze_report(_analysed(spark, sf_dir))


def _analysed(spark, sf_dir):
    from testsieve.plans import analyze as an
    from testsieve.session import cut_lineage
    return _stored(spark, sf_dir, "analysis", lambda: cut_lineage(an.analysis(facts(spark, sf_dir))))


def analyze_summary(spark, sf_dir):
    """Tests and table-driven tests per project."""
    from testsieve.plans import analyze as an
    return an.analyze_summary(_analysed(spark, sf_dir))


def table_driven(spark, sf_dir):
    """F17 per test."""
    return _analysed(spark, sf_dir).select("path", "name", F.col("is_table_driven"))


def container_kind(spark, sf_dir):
    """C1 per test."""
    return _analysed(spark, sf_dir).select("path", "name", "data_structure")


def scenario_counts(spark, sf_dir):
    """A8 per test."""
    return _analysed(spark, sf_dir).select("path", "name", "scenario_count")


def name_field(spark, sf_dir):
    """W4 per test."""
    return _analysed(spark, sf_dir).select("path", "name", "name_field")


def expected_fields(spark, sf_dir):
    """A9 per test, joined with ', '."""
    return _analysed(spark, sf_dir).select("path", "name",
                                           F.array_join("expected_fields", ", ").alias("expected_fields"))


def uses_subtest(spark, sf_dir):
    """A11 per test."""
    return _analysed(spark, sf_dir).select("path", "name", "uses_subtest")


def runner_loop(spark, sf_dir):
    """Statement ordinal and loop variables of each test's runner loop."""
    a = _analysed(spark, sf_dir).filter(F.col("runner_ord").isNotNull())
    return a.select("path", "name", F.col("runner_ord").cast("int").alias("runner_ord"),
                    "key_var", "value_var")


def stmt_counts(spark, sf_dir):
    """top-level statements per function; an empty body has 0."""
    from testsieve.operators import statements as sm
    fx_ = facts(spark, sf_dir)
    n = sm.count_statements(fx_.stmts)
    return (fx_.funcs.join(n, ["project", "path", "func_line"], "left")
            .select("path", "name", F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements")))


def tester_param(spark, sf_dir):
    """name of the `*testing.T` parameter of every function."""
    from testsieve.operators import statements as sm
    return facts(spark, sf_dir).funcs.select("path", "name", sm.tester_param(F.col("header")).alias("tester"))


def scenario_source(spark, sf_dir):
    """The matched scenario literal: count and first element (masked)."""
    a = _analysed(spark, sf_dir).filter(F.col("scenario_count") > 0)
    return a.select("path", "name", F.col("scenario_count").alias("n_scenarios"),
                    F.try_element_at("scenarios", F.lit(1)).alias("first_scenario"))


# ---------------------------------------------------------------- call expansion (chains from part)

def chain_facts(spark, sf_dir):
    from testsieve.plans.analyze import Facts
    return _stored(spark, sf_dir, "chains", lambda: Facts(fx.chain_corpus(spark, sf_dir), None))


def _expansion(spark, sf_dir):
    f = chain_facts(spark, sf_dir)
    return f.tests(), _stored(spark, sf_dir, "expansion", f.expand)


def expand_calls(spark, sf_dir):
    """Expanded nodes and deepest level per test (0 and 0 without statements)."""
    from testsieve.operators import expand as ex
    tests, nodes = _expansion(spark, sf_dir)
    s = ex.expansion_summary(nodes)
    return (tests.select("project", "path", "func_line", "name").join(s, ["project", "path", "func_line"], "left")
            .select("path", "name", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_nodes", "max_level"))))


def expansion_preorder(spark, sf_dir):
    """Node texts of each expansion tree in pre-order (order by path)."""
    tests, nodes = _expansion(spark, sf_dir)
    seq = nodes.groupBy("project", "path", "func_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_path", F.regexp_replace("text", r"^\s+|\s+$", "").alias("t")))),
                                 lambda x: x["t"]), " > ").alias("preorder"))
    return (tests.select("project", "path", "func_line", "name").join(seq, ["project", "path", "func_line"], "left")
            .select("path", "name", F.coalesce("preorder", F.lit("")).alias("preorder")))


# ---------------------------------------------------------------- refactoring

def _refactor(spark, sf_dir):
    from testsieve.plans import analyze as an
    f = facts(spark, sf_dir)
    a = _analysed(spark, sf_dir)
    plan, rewritten = an.refactoring(f, a, "subtest")
    return f, a, plan, rewritten


def refactor_candidates(spark, sf_dir):
    """Table-driven tests without subtests."""
    _, _, plan, _ = _refactor(spark, sf_dir)
    return plan.filter(F.col("generation_status") != "none").select("path", "name")


def refactor_status(spark, sf_dir):
    """Generation status of every valid test under strategy `subtest`."""
    _, _, plan, _ = _refactor(spark, sf_dir)
    return plan.select("path", "name", "generation_status")


def refactor_names(spark, sf_dir):
    """Subtest name expression of each successful rewrite."""
    _, _, plan, _ = _refactor(spark, sf_dir)
    return plan.filter(F.col("generation_status") == "success").select("path", "name", "name_expr")


def subtest_rewrite(spark, sf_dir):
    """Rewritten functions, compared modulo layout."""
    _, _, _, rewritten = _refactor(spark, sf_dir)
    return rewritten.select("path", "name", F.trim(F.regexp_replace("refactored", r"\s+", " "))
                            .alias("refactored_ws"))


def affected_files(spark, sf_dir):
    """Distinct files touched by successful rewrites, per project."""
    _, _, _, rewritten = _refactor(spark, sf_dir)
    return rewritten.select("project", "path").dropDuplicates(["project", "path"]) \
        .groupBy("project").agg(F.count(F.lit(1)).alias("n_files"))


def apply_patches(spark, sf_dir):
    """Functions replaced by their rewrite (new table), counted per file."""
    from testsieve.operators import refactor as rf
    f, _, _, rewritten = _refactor(spark, sf_dir)
    funcs = f.funcs.select("project", "path", "func_line", F.col("header_text").alias("text"))
    patched = rf.apply_patches(funcs, rewritten)
    return (patched.groupBy("path").agg(F.count_if("patched").alias("n_patched"))
            .filter(F.col("n_patched") > 0))


def runner_location(spark, sf_dir):
    """The runner loop lies inside the test's own body."""
    a = _analysed(spark, sf_dir).filter(F.col("runner_ord").isNotNull())
    f = facts(spark, sf_dir)
    st_ = f.stmts.select("project", "path", "func_line", F.col("stmt_ord").alias("runner_ord"), "stmt_line")
    j = a.join(st_, ["project", "path", "func_line", "runner_ord"])
    inside = (F.col("stmt_line") > F.col("func_line")) & (F.col("stmt_line") < F.col("end_line"))
    return j.select("path", "name", inside.alias("runner_in_test"))


def refactor_summary(spark, sf_dir):
    """Attempts, generation successes, successes (both runs pass), per project."""
    from testsieve.operators import refactor as rf
    from testsieve.operators import runs as rn
    _, _, plan, _ = _refactor(spark, sf_dir)
    o = rn.outcomes_per_test(fx.run_log(spark, sf_dir)).select(
        "project", "path", "name", F.col("originalExecutionResult").alias("original_result"),
        F.col("refactoredExecutionResult").alias("refactored_result"))
    return rf.refactor_summary(plan, o)


def analyze_refactor_report(spark, sf_dir):
    """The analyze report with strategy `subtest` and run outcomes."""
    from testsieve.plans import analyze as an
    f, a, plan, _ = _refactor(spark, sf_dir)
    res = an.refactor_results(plan, fx.run_log(spark, sf_dir))
    return an.analyze_report(a, res)


# ---------------------------------------------------------------- sinks and contracts

def report_text(spark, sf_dir):
    """The statistics text report per project."""
    return st.statistics_report_text(q_stats(spark, sf_dir))


def q_stats(spark, sf_dir):
    files, errs = shapes(spark, sf_dir)
    return st.statistics(files, errs, by="project")


def json_roundtrip(spark, sf_dir):
    """Analysis documents written as JSON, read back with the
    declared schema; the flat view must equal the analysis. No refactoring is asked for
    (strategy ``none``), so the documents hold none."""
    from testsieve.plans import analyze as an
    from testsieve.sources import sinks as sk
    a = an.document_texts(facts(spark, sf_dir), _analysed(spark, sf_dir))
    out = sk.scratch_dir(spark, "json")
    sk.write_json_documents(sk.json_documents(a), out)
    d = sk.read_json_documents(spark, out)
    return d.select(
        F.col("TestCase.filePath").alias("path"), F.col("TestCase.name").alias("name"),
        F.col("TestCase.package").alias("package"), "doc_key",
        F.col("ScenarioSet.dataStructure").alias("data_structure"),
        F.size("ScenarioSet.scenarios").cast("long").alias("scenario_count"),
        F.col("ScenarioSet.isTableDriven").alias("is_table_driven"),
        F.array_join("ImportedPackages", ", ").alias("imports"),
        F.col("RefactorResult.strategy").alias("strategy"))


def append_contract(spark, sf_dir):
    """Two appends with the same header are kept, an append with a
    reordered header is refused; the CSV read back holds both batches."""
    from testsieve.session import cut_lineage
    from testsieve.sources import sinks as sk
    stats = cut_lineage(q_stats(spark, sf_dir))  # both appends write the same rows
    out = sk.scratch_dir(spark, "csv")
    sk.write_csv(stats, out)
    sk.write_csv(stats, out, append=True)
    try:
        sk.write_csv(stats.select(*reversed(stats.columns)), out, append=True)
        refused = False
    except sk.ContractError:
        refused = True
    back = spark.read.option("header", True).csv(out)
    return back.withColumn("reordered_refused", F.lit(refused))


def json_flatten(spark, sf_dir):
    """Appending each test's import list flattened one level gives one
    element per import; counted per import path."""
    from testsieve.sources import sinks as sk
    a = _analysed(spark, sf_dir).select("path", "name", "imports")
    flat = sk.flatten_one_level(a, "imports")
    return flat.groupBy(F.col("imports").alias("import_path")).agg(F.count(F.lit(1)).alias("n_elements"))


# ---------------------------------------------------------------- extension and incremental

def custom_task(spark, sf_dir):
    """An example user task (``t.Helper()`` calls per project)."""
    from testsieve.plans import task as tk
    files, errs = shapes(spark, sf_dir)
    return tk.run_task(tk.HELPER_CALLS, files, errs).withColumnRenamed("group", "project")


def stream_append(spark, sf_dir):
    """Run logs written as several Parquet batches, classified by an
    availableNow stream and appended; the result equals the batch job."""
    from testsieve.sources import sinks as sk
    from testsieve.streaming import append as sa
    base = sk.scratch_dir(spark, "stream")
    runs = fx.run_log(spark, sf_dir)
    runs.write.mode("overwrite").parquet(f"{base}/in")
    sa.classified_runs_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    return sa.read_appended(spark, f"{base}/out").select("run_id", "result", "message")


def _streamed(spark, sf_dir):
    """The shape corpus as a stream in two steps: every file in a first revision (a third of them
    with another text, some that are taken away again), then the changed files."""
    from testsieve.sources import sinks as sk
    from testsieve.streaming import files as sf

    def build():
        base = sk.scratch_dir(spark, "files")
        files, errs = shapes(spark, sf_dir)
        f_no = F.regexp_extract(F.col("path"), r"/f(\d+)(?:_test)?\.go$", 1).cast("long")
        older = F.when(f_no % 3 == 1, F.concat(F.col("content"), F.lit("\nfunc TestOld(t *testing.T) {\n\tt.Log(1)\n}\n"))).otherwise(F.col("content"))
        gone = files.filter(f_no % 7 == 2).withColumn("path", F.concat(F.substring_index("path", "/f", 1), F.lit("/gone"), f_no.cast("string"), F.lit("_test.go")))
        first = files.withColumn("content", older).unionByName(gone).withColumn("revision", F.lit(1).cast("long"))
        second = files.filter(f_no % 3 == 1).unionByName(gone.withColumn("content", F.lit(None).cast("string"))).withColumn("revision", F.lit(2).cast("long"))
        for rows in (first, second):
            rows.select("project", "path", "content", "revision").write.mode("append").parquet(f"{base}/in")
            sf.file_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", errs)
        return f"{base}/out"
    return _stored(spark, sf_dir, "streamed", build)


def stream_statistics(spark, sf_dir):
    """Statistics of a stream of source files after changes and removals."""
    from testsieve.streaming import files as sf
    return sf.statistics(spark, _streamed(spark, sf_dir)).filter("totalFiles > 0")


def stream_func_decls(spark, sf_dir):
    """Functions of a stream of source files after changes and removals."""
    from testsieve.streaming import files as sf
    return sf.func_decls(spark, _streamed(spark, sf_dir))


# ---------------------------------------------------------------- more fact queries

def selector_calls(spark, sf_dir):
    """top-level statements that are calls ``<tester>.<name>(...)``, per function."""
    from testsieve.operators import expand as ex
    from testsieve.operators import statements as sm
    f = facts(spark, sf_dir)
    fn = f.funcs.select("project", "path", "func_line", "name", sm.tester_param(F.col("header")).alias("tv"))
    s = fn.join(f.stmts, ["project", "path", "func_line"], "left")
    pat = F.concat(F.lit(r"^\s*"), F.col("tv"), F.lit(r"\s*\.\s*\w+\s*\("))
    hit = F.coalesce(F.rlike(F.col("flat"), pat) & ex.is_expr_stmt(F.col("flat"), f.levels()), F.lit(False))
    return s.groupBy("path", "name").agg(F.count_if(hit).alias("n_selector_calls"))


def struct_fields(spark, sf_dir):
    """fields of each test's scenario struct, declaration order."""
    a = _analysed(spark, sf_dir).filter(F.size("fields") > 0)
    return a.select("path", "name", F.array_join(F.transform(
        "fields", lambda x: F.concat(x["name"], F.lit(" "), x["type"])), ", ").alias("fields"))


def func_text(spark, sf_dir):
    """source text of each valid test (lines from `func` to the closing
    brace), compared modulo layout."""
    f = facts(spark, sf_dir)
    t = f.tests().select("project", "path", "func_line", "end_line", "name")
    ls = f.lines.select("project", "path", F.col("decl_line").alias("func_line"), "line_no", "text")
    j = ls.join(t, ["project", "path", "func_line"]).filter(F.col("line_no") <= F.col("end_line"))
    g = j.groupBy("path", "name").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    return g.select("path", "name", F.trim(F.regexp_replace(
        F.array_join(F.transform("ls", lambda x: x["text"]), "\n"), r"\s+", " ")).alias("text_ws"))


def _call_resolutions(f):
    """Every call that an expansion can meet, of every function, with its resolution and
    the function that it names (empty if there is none or more than one)."""
    key = ["project", "path", "func_line"]
    of = f.funcs.select("project", F.col("path").alias("def_path"), F.col("func_line").cast("int").alias("def_line"), F.col("name").alias("target"), F.col("path").alias("target_path"))
    named = f.calls().join(of, ["project", "def_path", "def_line"], "left")
    calls = f.all_calls().join(f.funcs.select(*key, "name"), key)
    r = calls.join(named, [*key, "stmt_ord", "owner", "callee"], "left")
    only = F.col("resolution") == "resolved"
    return r.select("path", "name", F.col("stmt_ord").cast("int").alias("stmt_ord"), "owner", "callee", F.coalesce("resolution", F.lit("unresolved")).alias("resolution"),
                    F.when(only, F.col("target_path")).otherwise(F.lit("")).alias("def_path"),
                    F.when(only, F.col("def_line")).otherwise(F.lit(0)).cast("int").alias("def_line"))


def resolve_calls(spark, sf_dir):
    """The calls of all functions of the chain corpus, resolved inside their packages."""
    return _call_resolutions(chain_facts(spark, sf_dir))


def owner_facts(spark, sf_dir):
    from testsieve.plans.analyze import Facts
    return _stored(spark, sf_dir, "owners", lambda: Facts(fx.owner_corpus(spark, sf_dir), None))


def call_owners(spark, sf_dir):
    """Calls on imports, receivers, fields, results and embedded types, names hidden by
    local ones, declared twice or in the other package of a folder."""
    return _call_resolutions(owner_facts(spark, sf_dir))


def owner_expansion(spark, sf_dir):
    """R1 with J1: nodes and deepest level of the tests of the owner corpus."""
    from testsieve.operators import expand as ex
    f = owner_facts(spark, sf_dir)
    s = ex.expansion_summary(_stored(spark, sf_dir, "owner expansion", f.expand))
    return (f.tests().select("project", "path", "func_line", "name").join(s, ["project", "path", "func_line"], "left")
            .select("path", "name", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_nodes", "max_level"))))


def table_facts(spark, sf_dir):
    from testsieve.plans.analyze import Facts
    return _stored(spark, sf_dir, "tables", lambda: Facts(fx.table_corpus(spark, sf_dir), None))


def _tables_analysed(spark, sf_dir):
    from testsieve.plans import analyze as an
    from testsieve.session import cut_lineage
    return _stored(spark, sf_dir, "tables analysis", lambda: cut_lineage(an.analysis(table_facts(spark, sf_dir))))


def scenario_origin(spark, sf_dir):
    """Where the scenarios of each test stand (clause, local, helper, file), how many
    they are and the first of them (masked)."""
    return _tables_analysed(spark, sf_dir).select(
        "path", "name", "scenario_source", F.col("scenario_count").alias("n_scenarios"),
        F.coalesce(F.try_element_at("scenarios", F.lit(1)), F.lit("")).alias("first_scenario"))


def range_resolution(spark, sf_dir):
    """Is the type of the ranged expression found, through results, assignments, fields
    and parts of lists, and which container is it."""
    return _tables_analysed(spark, sf_dir).select(
        "path", "name", "range_resolution", F.col("data_structure").alias("container"), F.coalesce("scenario_type", F.lit("")).alias("scenario_type"))


def enclosing_function(spark, sf_dir):
    """Every line of every file attributed to the function that holds it; how many of a
    function's lines call ``t.Log``."""
    from testsieve.operators import positions as ps
    f = facts(spark, sf_dir)
    log = F.col("masked").rlike(r"\bt\s*\.\s*Log\s*\(")
    ls = f.lines.select("project", "path", F.col("line_no").alias("line"), log.alias("log"))
    spans = f.funcs.select("project", "path", F.col("func_line").alias("start_line"), "end_line", "name")
    j = ps.outermost(ls, spans).filter("name is not null")
    return j.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("log").alias("n_log_lines"))


def position_owner(spark, sf_dir):
    """Positions that messages name, attributed to the outermost function around them;
    those outside of functions and in files that are not visited have none."""
    from testsieve.operators import positions as ps
    f = facts(spark, sf_dir)
    p = ps.positions_in(fx.messages(spark, sf_dir), "message", keep=("project",))
    p = p.groupBy("project", "path", "line").agg(F.count(F.lit(1)).alias("m"))
    spans = f.funcs.select("project", "path", F.col("func_line").alias("start_line"), "end_line", "name")
    return (ps.outermost(p, spans).groupBy("path", F.coalesce("name", F.lit("")).alias("name"))
            .agg(F.sum("m").alias("n_positions")))


def parsed_statements(spark, sf_dir):
    """Documents with the expansion trees written as JSON, read back, and the trees taken
    apart into nodes again."""
    from testsieve.operators import expand as ex
    from testsieve.sources import sinks as sk
    tests, nodes = _expansion(spark, sf_dir)
    out = sk.scratch_dir(spark, "trees")
    sk.write_json_documents(sk.json_documents(tests, nodes), out)
    docs = sk.read_json_documents(spark, out).select(F.col("TestCase.filePath").alias("path"), F.col("TestCase.name").alias("name"), "ParsedStatements")
    rows = ex.expansion_rows(docs, ["path", "name"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("node_path", "text"))), lambda x: x["text"])
    return rows.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("level").cast("long").alias("max_level"),
                                            F.array_join(texts, " > ").alias("preorder"))


def array_append(spark, sf_dir):
    """Three appends to one JSON array, the second as one nested element, read in order."""
    from testsieve.sources import jsonarray as ja
    from testsieve.sources import sinks as sk
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("p"))
    parts = parts.withColumn("element", F.to_json(F.struct("p")))
    out = sk.scratch_dir(spark, "array")
    for i in range(3):
        ja.append_elements(parts.filter(F.col("p") % 3 == i), out, ["p"], flatten=i != 1)
    rows = ja.read_elements(spark, out)
    return rows.groupBy("part", "nested").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min_by("element", "place").alias("first_element"), F.max_by("element", "place").alias("last_element"))


def packed_statements(spark, sf_dir):
    """Statements that share a line, blocks on one line and clauses with `;`."""
    from testsieve.operators import statements as sm
    from testsieve.plans import analyze as an
    from testsieve.session import cut_lineage
    f = _stored(spark, sf_dir, "packed", lambda: an.Facts(fx.packed_corpus(spark, sf_dir), None))
    a = _stored(spark, sf_dir, "packed analysis", lambda: cut_lineage(an.analysis(f)))
    n = sm.count_statements(f.stmts)
    return a.join(n, ["project", "path", "func_line"], "left").select(
        "path", "name", F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements"), "uses_subtest",
        F.col("scenario_count").alias("n_scenarios"), "name_field")


def range_types(spark, sf_dir):
    """Normalised type of the runner loop's ranged expression."""
    a = _analysed(spark, sf_dir).filter(F.col("runner_ord").isNotNull())
    return a.select("path", "name", "scenario_type")


def function_fields(spark, sf_dir):
    """A10: does the scenario struct have a function-typed field."""
    return _analysed(spark, sf_dir).select("path", "name", "has_function_fields")


def expansion_json(spark, sf_dir):
    """Nested JSON text of each chain test's expansion tree."""
    from testsieve.operators import expand as ex
    tests, nodes = _expansion(spark, sf_dir)
    j = ex.expansion_json(nodes)
    return (tests.select("project", "path", "func_line", "name").join(j, ["project", "path", "func_line"], "left")
            .select("path", "name", F.coalesce("json", F.lit("[]")).alias("json")))


def rewrite_reanalysis(spark, sf_dir):
    """The corpus with rewritten functions patched in is analysed
    again; every rewritten test now uses subtests, and the statement found by
    content at the runner's position in the original body is a loop in the new
    body too."""
    from testsieve.operators import refactor as rf
    from testsieve.plans import analyze as an
    from testsieve.session import cut_lineage
    from testsieve.sources.factstore import collected_in_memory
    f, _, _, rewritten = _refactor(spark, sf_dir)
    # both are read several times: the functions are rewritten once, the files patched once
    with collected_in_memory(spark):
        rewritten = cut_lineage(rewritten)
        files = cut_lineage(rf.patched_files(f.lines, rewritten))
    f2 = an.Facts(files, None)
    # Functions after a rewritten one move down, so the patched corpus is
    # joined back by name (unique per file for functions without receiver).
    fk = ["project", "path", "func_line"]
    nk = ["project", "path", "name"]
    a2 = an.analysis(f2).select(*nk, F.col("uses_subtest").alias("uses_subtest_after"))
    names = rewritten.select(*nk).distinct()
    named_a, named_b = (x.stmts.join(x.funcs.join(names, nk, "left_semi").select(*fk, "name"), fk) for x in (f, f2))
    keys = rewritten.select(*nk, F.col("runner_masked").alias("stmt_masked"))
    pos = rf.stmt_at_same_position(named_a, keys, named_b)
    out = rewritten.select(*nk).join(a2, nk, "left").join(pos, nk, "left")
    return out.select("path", "name", F.coalesce("uses_subtest_after", F.lit(False)).alias("uses_subtest_after"),
                      F.col("stmt_ord").cast("int").alias("runner_index"),
                      F.coalesce(F.col("other_flat").rlike(r"^\s*for\b.*\.Run\("), F.lit(False))
                      .alias("same_index_is_wrapped_loop"))
