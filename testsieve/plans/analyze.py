"""P2 ``analyze``: one analysis row per valid test.

    visited files -> lines (one exchange) -> declarations, statements,
    imports, packages (same partitioning) -> scenario analysis (joins on the
    test key) -> report columns
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testsieve.operators import decls as dc
from testsieve.operators import expand as ex
from testsieve.operators import lines as ln
from testsieve.operators import scenarios as sc
from testsieve.operators import statements as sm
from testsieve.session import cut_lineage
from testsieve.sources.factstore import store_bucketed
from testsieve.sources import corpus as cp

TEST_KEY = ["project", "path", "func_line"]

ANALYZE_COLUMNS = ["project", "filePath", "package", "name", "isTableDriven", "scenarioDataStructure",
                   "scenarioCount", "scenarioNameField", "scenarioExpectedFields",
                   "scenarioHasFunctionFields", "scenarioUsesSubtest", "refactorStrategy",
                   "refactorGenerationStatus", "originalExecutionResult", "refactoredExecutionResult",
                   "importedPackages"]


class Facts:
    """Fact tables of one corpus.

    Masking runs behind the single file exchange; the line, function and
    statement facts, read by several joins of the analysis, are materialised
    once as bucketed tables (or reliable checkpoints) in the shared checkpoint
    folder: later plans start from them (short lineage, small plans), read the
    columns they use only and survive lost executors.
    """

    def __init__(self, files: DataFrame, load_errors: DataFrame | None = None, strict_vendor: bool = False,
                 persist: bool = True, store: str = "bucketed"):
        # masked behind the exchange: it carries one text of each file, not two
        files = files.select("project", "path", "content")
        parts = cp.file_partitions(cp.skip_vendor(files, strict_vendor))
        self.visited = cp.prepare_files(files, load_errors, strict_vendor, parts)
        self.lines = ln.file_lines(self.visited, counted=True)
        most = int(files.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        bucketed = persist and store == "bucketed"

        def kept(df, name, *order):
            # buckets are the partitions, so each task writes one file and what reads it is as small
            if not bucketed:
                return cut_lineage(df) if persist else df
            return store_bucketed(df, name, sort=("project", "path", *order), buckets=min(parts, most))
        self.lines = kept(self.lines, "lines", "line_no")
        self.funcs = (dc.func_decls(self.lines).withColumnRenamed("start_line", "func_line")
                      .join(dc.import_names(self.lines), ["project", "path"], "left")
                      .withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))))
        self.funcs = kept(self.funcs, "funcs", "func_line")
        self.stmts = kept(sm.statements(self.lines), "stmts", "func_line", "stmt_ord")
        self._kept: dict = {}
        self._lazy = not persist

    def _once(self, name: str, build):
        if self._lazy:  # what follows reads these several times
            self._lazy, self.lines = False, cut_lineage(self.lines)
            self.funcs, self.stmts = cut_lineage(self.funcs), cut_lineage(self.stmts)
        if name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    def levels(self) -> int:
        """Deepest nesting of brackets in any statement: what patterns have to match."""
        return self._once("levels", lambda: sm.deepest(self.stmts))

    def types(self) -> DataFrame:
        return self._once("types", lambda: sc.type_decls(self.lines))

    def file_vars(self) -> DataFrame:
        """Package-level variables with their literals."""
        return self._once("file_vars", lambda: cut_lineage(sc.file_var_literals(self.lines, self.types())))

    def all_calls(self) -> DataFrame:
        """Every call that an expansion can meet, of every function."""
        return self._once("all_calls", lambda: ex.all_calls(self.stmts, self.levels()))

    def calls(self) -> DataFrame:
        """The calls that resolve inside their package (test files only)."""
        return self._once("calls", lambda: ex.resolved_calls(
            self.all_calls(), self.stmts, self.funcs, self.levels(), self.types(), sc.variables(self.file_vars())))

    def expand(self, roots: DataFrame | None = None) -> DataFrame:
        """The expansion trees of all tests (or of some of their statements)."""
        return ex.expand(self.tests(), self.stmts, self.funcs, self.stmts.sparkSession, resolved=self.calls(),
                         levels_deep=self.levels(), roots=roots)

    def tests(self) -> DataFrame:
        t = dc.valid_tests(self.funcs.withColumnRenamed("func_line", "start_line"))
        return t.withColumnRenamed("start_line", "func_line")


def analysis(facts: Facts) -> DataFrame:
    """Per valid test: test case columns + scenario set + imports."""
    facts.levels()  # facts that are not kept yet are materialised here, once
    tests = facts.tests()
    ss = sc.scenario_sets(tests, facts.stmts, facts.lines, facts)
    info = dc.file_info(facts.lines)
    return (tests.select(*TEST_KEY, "name", "end_line", "header", "header_text", "bad_format", "test_lines")
            .join(ss, TEST_KEY, "left")
            .join(info, ["project", "path"], "left")
            .withColumn("imports", F.coalesce("imports", F.array().cast("array<string>"))))


def analyze_report(analysed: DataFrame, refactor: DataFrame | None = None) -> DataFrame:
    """the 16 report columns; booleans and counts stay typed here and are
    turned into text only by the CSV sink."""
    a = analysed
    if refactor is not None:
        a = a.join(refactor, TEST_KEY, "left")
    def col_or(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in a.columns else F.lit(default)
    return a.select(
        "project", F.col("path").alias("filePath"), F.coalesce("package", F.lit("")).alias("package"), "name",
        F.coalesce("is_table_driven", F.lit(False)).alias("isTableDriven"),
        F.coalesce("data_structure", F.lit("none")).alias("scenarioDataStructure"),
        F.coalesce("scenario_count", F.lit(0)).cast("long").alias("scenarioCount"),
        F.coalesce("name_field", F.lit("")).alias("scenarioNameField"),
        F.array_join(F.coalesce("expected_fields", F.array().cast("array<string>")), ", ")
        .alias("scenarioExpectedFields"),
        F.coalesce("has_function_fields", F.lit(False)).alias("scenarioHasFunctionFields"),
        F.coalesce("uses_subtest", F.lit(False)).alias("scenarioUsesSubtest"),
        col_or("strategy", "none").alias("refactorStrategy"),
        col_or("generation_status", "none").alias("refactorGenerationStatus"),
        col_or("original_result", "notRun").alias("originalExecutionResult"),
        col_or("refactored_result", "notRun").alias("refactoredExecutionResult"),
        F.array_join(F.coalesce("imports", F.array().cast("array<string>")), ", ").alias("importedPackages"),
    )


def analyze_summary(analysed: DataFrame) -> DataFrame:
    """Tests and table-driven tests per project."""
    return analysed.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_tests"),
        F.count_if(F.coalesce("is_table_driven", F.lit(False))).alias("n_table_driven"))


def refactoring(facts: Facts, analysed: DataFrame, strategy: str = "subtest"):
    """P3 plan: per-test refactor plan and the rewritten functions."""
    from testsieve.operators import refactor as rf
    plan = rf.plan_refactoring(analysed, strategy)
    rewritten = rf.rewrite_tests(plan, facts.stmts, facts.lines)
    return plan, rewritten


def document_texts(facts: Facts, analysed: DataFrame, rewritten: DataFrame | None = None) -> DataFrame:
    """the analysis with the source texts of its documents: ``func_text``, ``runner`` and,
    with the rewritten functions, ``refactored``."""
    runner = facts.stmts.select(*TEST_KEY, F.col("stmt_ord").alias("runner_ord"),
                                F.regexp_replace("text", r"^\s+|\s+$", "").alias("runner"))
    spans = analysed.select(*TEST_KEY, "end_line")
    text = (facts.lines.select("project", "path", F.col("decl_line").alias("func_line"), "line_no", "text")
            .join(spans, TEST_KEY).filter(F.col("line_no") <= F.col("end_line")).groupBy(*TEST_KEY)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))),
                                          lambda x: x["text"]), "\n").alias("func_text")))
    a = analysed.join(runner, TEST_KEY + ["runner_ord"], "left").join(text, TEST_KEY, "left")
    if rewritten is not None:
        a = a.join(rewritten.select(*TEST_KEY, "refactored"), TEST_KEY, "left")
    return a


def refactor_results(plan: DataFrame, run_log: DataFrame | None) -> DataFrame:
    """Refactor columns of the report: outcomes only for generated rewrites
    (the reference runs a test only after a successful generation)."""
    from testsieve.operators import runs as rn
    r = plan.select(*TEST_KEY, "name", "strategy", "generation_status")
    if run_log is not None:
        o = rn.outcomes_per_test(run_log).select(
            "project", "path", "name", F.col("originalExecutionResult").alias("o"),
            F.col("refactoredExecutionResult").alias("r"))
        r = r.join(o, ["project", "path", "name"], "left")
    else:
        r = r.withColumn("o", F.lit(None).cast("string")).withColumn("r", F.lit(None).cast("string"))
    ok = F.col("generation_status") == "success"
    return r.select(*TEST_KEY, "strategy", "generation_status",
                    F.when(ok, F.coalesce("o", F.lit("notRun"))).otherwise(F.lit("notRun")).alias("original_result"),
                    F.when(ok, F.coalesce("r", F.lit("notRun"))).otherwise(F.lit("notRun")).alias("refactored_result"))
