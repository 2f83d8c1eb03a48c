"""Scalar classifiers as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Enum texts, in declaration order.
EXECUTION_RESULTS = ["notRun", "compilationError", "skip", "fail", "pass"]
GENERATION_STATUSES = ["none", "error", "badFields", "noTester", "fail", "success"]
REFACTOR_STRATEGIES = ["none", "subtest"]
DATA_STRUCTURES = ["none", "structList", "map"]
FILE_FORMATS = ["Unknown", "Txt", "CSV", "JSON"]

# Markers searched in captured `go test -v` output.
BUILD_FAILED = "[build failed]"
FAIL_MARK = "--- FAIL"
NO_TESTS = "no tests to run"
SKIP_MARK = "--- SKIP"
PASS_MARK = "--- PASS"
NO_STDERR = "[no stderr output]"


def run_result(exit_ok: Column, output: Column, path: Column | None = None,
               test: Column | None = None) -> Column:
    """Outcome of one run from its exit status and captured output."""
    out = F.coalesce(output, F.lit(""))
    failed = (F.when(out.contains(BUILD_FAILED), F.lit("compilationError"))
              .otherwise(F.lit("fail")))
    passed = (F.when(out.contains(NO_TESTS), F.lit("notRun"))
              .when(out.contains(SKIP_MARK), F.lit("skip"))
              .when(out.contains(PASS_MARK), F.lit("pass"))
              .otherwise(F.lit("fail")))
    res = F.when(~F.coalesce(exit_ok, F.lit(False)), failed).otherwise(passed)
    if path is not None and test is not None:
        missing = F.coalesce(path, F.lit("")).eqNullSafe("") | F.coalesce(test, F.lit("")).eqNullSafe("")
        res = F.when(missing, F.lit("notRun")).otherwise(res)
    return res


def run_message(exit_ok: Column, output: Column, stderr: Column, path: Column, test: Column) -> Column:
    """C4: the error message of a run (NULL for skip and pass)."""
    out = F.coalesce(output, F.lit(""))
    err = F.when(F.coalesce(F.length(stderr), F.lit(0)) > 0, stderr).otherwise(F.lit(NO_STDERR))
    failed = (F.when(out.contains(BUILD_FAILED), F.concat(F.lit("compilation error: "), err))
              .when(out.contains(FAIL_MARK), F.concat(F.lit("test failed: "), err))
              .otherwise(F.concat(F.lit("unknown error: "), err)))
    pattern = F.concat(F.lit("^"), test, F.lit("$"))
    passed = (F.when(out.contains(NO_TESTS),
                     F.format_string('no tests to run for pattern "%s" in file "%s"', pattern, path))
              .when(out.contains(SKIP_MARK) | out.contains(PASS_MARK), F.lit(None).cast("string"))
              .otherwise(F.concat(F.lit("unknown test result: "), out)))
    return F.when(~F.coalesce(exit_ok, F.lit(False)), failed).otherwise(passed)


def _decode(raw: Column, values: list[str], default: str) -> Column:
    """Case-insensitive enum decode with a default for unknown text.

    Keys are lower-cased so that mixed-case names such as ``notRun`` decode
    (the reference compared lower-cased text with mixed-case keys)."""
    m = F.create_map(*[x for v in values for x in (F.lit(v.lower()), F.lit(v))])
    return F.coalesce(F.element_at(m, F.lower(raw)), F.lit(default))


def decode_execution_result(raw: Column) -> Column:
    """S16 for TestExecutionResult; unknown -> ``notRun``."""
    return _decode(raw, EXECUTION_RESULTS, "notRun")


def decode_generation_status(raw: Column) -> Column:
    """S16 for RefactorGenerationStatus; unknown -> ``none``."""
    return _decode(raw, GENERATION_STATUSES, "none")


def parse_strategy(raw: Column) -> Column:
    """Case-insensitive; unknown -> ``none``."""
    return _decode(raw, REFACTOR_STRATEGIES, "none")


def strategy_named(text: str | None) -> str:
    """:func:`parse_strategy` of one text, without a job."""
    return {v.lower(): v for v in REFACTOR_STRATEGIES}.get((text or "").lower(), "none")


def file_extension(path: Column) -> Column:
    """Extension of the last path element from its final dot (``""`` if none)."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_extract(base, r"(\.[^.]*)$", 1)


def detect_format(path: Column) -> Column:
    """Output format from the extension, case-insensitive; else Unknown."""
    ext = F.lower(file_extension(path))
    return (F.when(ext == ".txt", F.lit("Txt"))
            .when(ext == ".csv", F.lit("CSV"))
            .when(ext == ".json", F.lit("JSON"))
            .otherwise(F.lit("Unknown")))


def import_path_root(p: Column) -> Column:
    """F8: text before the third ``/``; the whole text if it has fewer."""
    return F.substring_index(p, "/", 3)
