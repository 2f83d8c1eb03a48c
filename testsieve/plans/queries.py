"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or a corpus Spark derives from them) in
full, so its work grows with the scale factor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from testsieve.plans import direct as dt
from testsieve.plans import roundtrip as rt
from testsieve.plans import statistics as st
from testsieve.session import apply_defaults
from testsieve.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]


def _shapes(spark: SparkSession, sf_dir: str):
    return fx.shape_corpus(spark, sf_dir), fx.shape_load_errors(spark, sf_dir)


def q_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, errs = _shapes(spark, sf_dir)
    return st.statistics(files, errs, by="project")


_QUERIES: dict[str, Query] = {
    "statistics": q_statistics,
    "scan_sources": rt.scan_sources,
    "skip_vendor": rt.skip_vendor,
    "skip_error_files": rt.skip_error_files,
    "distinct_files": rt.distinct_files,
    "statistics_by_dir": rt.statistics_by_dir,
    "func_decls": rt.func_decls,
    "valid_tests": rt.valid_tests,
    "bad_format": rt.bad_format,
    "test_cases": rt.test_cases,
    "test_lines": rt.test_lines,
    "test_label": rt.test_label,
    "line_depth": rt.line_depth,
    "imports": rt.imports,
    "analyze_report": rt.analyze_report,
    "analyze_summary": rt.analyze_summary,
    "table_driven": rt.table_driven,
    "container_kind": rt.container_kind,
    "scenario_counts": rt.scenario_counts,
    "name_field": rt.name_field,
    "expected_fields": rt.expected_fields,
    "uses_subtest": rt.uses_subtest,
    "runner_loop": rt.runner_loop,
    "stmt_counts": rt.stmt_counts,
    "tester_param": rt.tester_param,
    "scenario_source": rt.scenario_source,
    "expand_calls": rt.expand_calls,
    "expansion_json": rt.expansion_json,
    "rewrite_reanalysis": rt.rewrite_reanalysis,
    "selector_calls": rt.selector_calls,
    "struct_fields": rt.struct_fields,
    "func_text": rt.func_text,
    "resolve_calls": rt.resolve_calls,
    "call_owners": rt.call_owners,
    "owner_expansion": rt.owner_expansion,
    "scenario_origin": rt.scenario_origin,
    "range_resolution": rt.range_resolution,
    "enclosing_function": rt.enclosing_function,
    "position_owner": rt.position_owner,
    "parsed_statements": rt.parsed_statements,
    "array_append": rt.array_append,
    "packed_statements": rt.packed_statements,
    "range_types": rt.range_types,
    "function_fields": rt.function_fields,
    "custom_task": rt.custom_task,
    "stream_append": rt.stream_append,
    "stream_statistics": rt.stream_statistics,
    "stream_func_decls": rt.stream_func_decls,
    "report_text": rt.report_text,
    "json_roundtrip": rt.json_roundtrip,
    "append_contract": rt.append_contract,
    "json_flatten": rt.json_flatten,
    "refactor_candidates": rt.refactor_candidates,
    "refactor_status": rt.refactor_status,
    "refactor_names": rt.refactor_names,
    "subtest_rewrite": rt.subtest_rewrite,
    "affected_files": rt.affected_files,
    "apply_patches": rt.apply_patches,
    "runner_location": rt.runner_location,
    "refactor_summary": rt.refactor_summary,
    "analyze_refactor_report": rt.analyze_refactor_report,
    "expansion_preorder": rt.expansion_preorder,
    "path_root": dt.path_root,
    "unit_share": dt.unit_share,
    "classify_runs": dt.classify_runs,
    "run_messages": dt.run_messages,
    "outcome_compare": dt.outcome_compare,
    "detect_format": dt.detect_format,
    "enum_decode": dt.enum_decode,
}


def _with_defaults(q: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_defaults(spark)
        return q(spark, sf_dir)
    run.__name__ = getattr(q, "__name__", "query")
    run.__doc__ = q.__doc__
    return run


QUERIES: dict[str, Query] = {name: _with_defaults(q) for name, q in _QUERIES.items()}
