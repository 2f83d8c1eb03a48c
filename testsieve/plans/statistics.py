"""P1 ``statistics``: per project (or per top-level directory) test statistics.

Plan shape (one Spark job):

    scan -> vendor filter (pushed to the scan) -> anti join load errors
         -> dropDuplicates(project, path)          [the one exchange of file rows]
         -> line facts + running depth windows     [no exchange]
         -> per-file counts, per-test spans        [no exchange]
         -> partial agg by group -> final agg     [exchange of partial aggregates only]
    groups (all scanned files) LEFT JOIN file aggregates LEFT JOIN test aggregates

A project whose files are all skipped still yields a row of zeros, like the
reference (every loaded package reaches ``ReportResults``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testsieve.operators import decls as dc
from testsieve.operators import lines as ln
from testsieve.sources import corpus as cp

STATISTICS_COLUMNS = ["projectDir", "testCases", "testFiles", "totalFiles", "testLines",
                      "avgLinesPerTest", "percentTestLines"]


def group_column(by: str):
    """Report group: ``project`` or ``project/top_dir``."""
    if by == "project":
        return F.col("project")
    if by == "top_dir":
        rel = cp.relative_path(F.col("path"), F.col("project"))
        top = F.when(F.instr(rel, "/") > 0, F.substring_index(rel, "/", 1))
        return F.concat(F.col("project"), F.lit("/"), top)
    raise ValueError(f"unknown grouping {by!r}")


def statistics_facts(files: DataFrame, load_errors: DataFrame | None = None,
                     strict_vendor: bool = False) -> DataFrame:
    """Per visited file: ``file_lines``, ``n_tests``, ``test_lines``, ``is_test_file``."""
    # masked behind the exchange: it carries one text of each file, not two
    visited = cp.prepare_files(files.select("project", "path", "content"), load_errors, strict_vendor)
    return dc.file_facts(ln.file_lines(visited)).withColumn(
        "is_test_file", F.col("path").endswith("_test.go"))


def statistics(files: DataFrame, load_errors: DataFrame | None = None, by: str = "project",
               strict_vendor: bool = False) -> DataFrame:
    """The statistics report: columns :data:`STATISTICS_COLUMNS`."""
    g = group_column(by)
    groups = files.select(g.alias("projectDir")).filter(F.col("projectDir").isNotNull()).distinct()
    per_file = statistics_facts(files, load_errors, strict_vendor)
    agg = (per_file.select(g.alias("projectDir"), "is_test_file", "file_lines", "n_tests", "test_lines")
           .filter(F.col("projectDir").isNotNull())
           .groupBy("projectDir")
           .agg(F.count(F.lit(1)).alias("totalFiles"),
                F.count_if("is_test_file").alias("testFiles"),
                F.sum("file_lines").alias("totalLines"),
                F.sum("n_tests").alias("testCases"),
                F.sum("test_lines").alias("testLines")))
    j = groups.join(agg, "projectDir", "left")
    n = F.coalesce(F.col("testCases"), F.lit(0)).cast("long")
    tl = F.coalesce(F.col("testLines"), F.lit(0)).cast("long")
    total = F.coalesce(F.col("totalLines"), F.lit(0)).cast("long")
    return j.select(
        "projectDir",
        n.alias("testCases"),
        F.coalesce(F.col("testFiles"), F.lit(0)).cast("long").alias("testFiles"),
        F.coalesce(F.col("totalFiles"), F.lit(0)).cast("long").alias("totalFiles"),
        tl.alias("testLines"),
        F.when(n > 0, tl.cast("double") / n).otherwise(F.lit(0.0)).alias("avgLinesPerTest"),
        F.when(n > 0, tl.cast("double") / total * 100).otherwise(F.lit(0.0)).alias("percentTestLines"),
    )


def statistics_report_text(stats: DataFrame, title_col: str = "projectDir") -> DataFrame:
    """The text report, one ``value`` row per group (for ``write.text``).

    Numbers use ``%.1f`` like the reference; Spark rounds half up on the decimal
    text where Go rounds the binary value half-even, so a value such as 0.25
    prints 0.3 here and 0.2 there.
    """
    body = F.when(
        F.col("testCases") == 0,
        F.lit("No test cases found in the specified project.\n"),
    ).otherwise(F.format_string(
        "Total number of test cases: %d\n\nNumber of '_test.go' files: %d\n"
        "Total number of Go files: %d\n\nTotal lines of test code: %d\n"
        "Average lines per test case: %.1f\nPercentage of total lines for test cases: %.1f%%\n",
        "testCases", "testFiles", "totalFiles", "testLines",
        F.round("avgLinesPerTest", 1), F.round("percentTestLines", 1)))
    head = F.format_string("=============  Statistics Report for \"%s\":  =============\n\n", F.col(title_col))
    return stats.select(title_col, F.concat(head, body).alias("value"))
