"""User-defined corpus tasks.

A task is a pair of DataFrame functions: ``extract`` maps the visited files
(or their line facts) to per-file rows, ``report`` reduces those rows per group
(project or top-level directory). Both are plain DataFrame transformations,
so they compose with ``DataFrame.transform`` and run wherever the engine runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testsieve.operators import lines as ln
from testsieve.plans.statistics import group_column
from testsieve.sources import corpus as cp

Extract = Callable[[DataFrame], DataFrame]
Report = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CorpusTask:
    """``extract`` receives line facts (``project, path, line_no, text, masked,
    depth_*, decl_*``) when ``on_lines`` is set, else the visited files."""
    name: str
    extract: Extract
    report: Report
    on_lines: bool = True


def run_task(task: CorpusTask, files: DataFrame, load_errors: DataFrame | None = None,
             by: str = "project") -> DataFrame:
    """Visit the corpus like the built-in jobs (vendor / error filters, one row
    per file), extract per file, reduce per group."""
    visited = ln.masked_files(cp.prepare_files(files.select("project", "path", "content"), load_errors))
    src = ln.file_lines(visited) if task.on_lines else visited
    rows = src.transform(task.extract).withColumn("group", group_column(by))
    return rows.transform(task.report)


# Example task: number of `t.Helper()` calls and of files calling it, per group.
def _helper_calls(lines: DataFrame) -> DataFrame:
    hit = F.col("masked").rlike(r"\b\w+\s*\.\s*Helper\s*\(\s*\)")
    return lines.groupBy("project", "path").agg(F.count_if(hit).alias("helper_calls"))


def _helper_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("group").agg(F.sum("helper_calls").cast("long").alias("helper_calls"),
                                     F.count_if(F.col("helper_calls") > 0).alias("files_with_helpers"))


HELPER_CALLS = CorpusTask("helper_calls", _helper_calls, _helper_report)
