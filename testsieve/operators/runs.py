"""Run-log operators: classify runs, pair original with refactored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testsieve.functions import classify as cl

PHASES = ["original", "refactored"]


def classify_runs(run_log: DataFrame) -> DataFrame:
    """C3 per run: ``run_id, test_id, phase, result``."""
    return run_log.select(
        "run_id", "test_id", "phase",
        cl.run_result(F.col("exit_ok"), F.col("output"), F.col("path"), F.col("test")).alias("result"))


def run_messages(run_log: DataFrame) -> DataFrame:
    """C4 per run: ``run_id, result, message``."""
    return run_log.select(
        "run_id",
        cl.run_result(F.col("exit_ok"), F.col("output"), F.col("path"), F.col("test")).alias("result"),
        cl.run_message(F.col("exit_ok"), F.col("output"), F.col("stderr"), F.col("path"),
                       F.col("test")).alias("message"))


def outcomes_per_test(run_log: DataFrame) -> DataFrame:
    """One row per test with both outcomes (pivot on the known phases:
    one aggregation, no extra job to discover pivot values). A phase without a
    run stays ``notRun``; ``changed`` is C12's warning condition."""
    c = run_log.select("run_id", "test_id", "project", "path", "test", "phase",
                       cl.run_result(F.col("exit_ok"), F.col("output"), F.col("path"), F.col("test"))
                       .alias("result"))
    p = (c.groupBy("test_id", "project", "path", "test").pivot("phase", PHASES)
         .agg(F.max_by("result", "run_id")))
    orig = F.coalesce(F.col("original"), F.lit("notRun"))
    ref = F.coalesce(F.col("refactored"), F.lit("notRun"))
    return p.select("test_id", "project", "path", F.col("test").alias("name"),
                    orig.alias("originalExecutionResult"),
                    ref.alias("refactoredExecutionResult"), (orig != ref).alias("changed"))


def outcome_compare(run_log: DataFrame) -> DataFrame:
    """Outcome pairs and how many tests show each pair."""
    return (outcomes_per_test(run_log)
            .groupBy("originalExecutionResult", "refactoredExecutionResult", "changed")
            .agg(F.count(F.lit(1)).alias("n_tests")))
