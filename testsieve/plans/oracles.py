"""DuckDB oracle SQL for the registered queries.

Round-trip (RT) oracles compute the expected answer from the generating keys of
``orders`` / ``part`` only, never from generated text; direct (DT) oracles map
driver tables with plain SQL.
"""

from __future__ import annotations

# Shape facts from orders, shared by the RT oracles (fixed values of the corpus
# definition: 25 projects, 5 functions per file, vendored f % 17 = 16, load
# error f % 19 = 18, test files f % 3 <> 0, project 24 without valid tests).
SHAPES_CTE = """
shp AS (
  SELECT o_orderkey AS k, o_orderkey // 5 AS f, (o_orderkey // 5) % 25 AS pn,
         CASE WHEN (o_orderkey // 5) % 25 = 24 THEN 5 + ((o_orderkey + o_orderkey // 5) % 10) % 5
              ELSE (o_orderkey + o_orderkey // 5) % 10 END AS v,
         (o_orderkey // 10) % 7 AS n
  FROM orders
),
fn AS (
  SELECT *,
         'proj' || lpad(CAST(pn AS VARCHAR), 2, '0') AS project,
         'pkg' || CAST((f // 25) % 4 AS VARCHAR) AS package,
         '/src/proj' || lpad(CAST(pn AS VARCHAR), 2, '0') || '/'
           || CASE WHEN f % 17 = 16 THEN 'vendor/' ELSE '' END
           || 'pkg' || CAST((f // 25) % 4 AS VARCHAR) || '/f' || CAST(f AS VARCHAR)
           || CASE WHEN f % 3 = 0 THEN '.go' ELSE '_test.go' END AS path,
         CASE v WHEN 0 THEN 10 + n WHEN 1 THEN 12 + n WHEN 2 THEN 9 + n
                WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 3 WHEN 6 THEN 2 WHEN 7 THEN 2
                WHEN 8 THEN 3 ELSE 2 END AS lines,
         v <= 4 AS valid,
         f % 17 <> 16 AND f % 19 <> 18 AS visited,
         CASE WHEN v = 4 THEN 'Test_' || CAST(k AS VARCHAR) WHEN v = 5 THEN 'helper' || CAST(k AS VARCHAR)
              ELSE 'TestK' || CAST(k AS VARCHAR) END AS name
  FROM shp
),
fl AS (
  SELECT f, pn, project, package, path, visited, f % 3 <> 0 AS is_test_file,
         7 + sum(lines) + count(*) - 1 AS file_lines, min(k) AS first_k,
         count(*) AS n_funcs
  FROM fn GROUP BY f, pn, project, package, path, visited
)
"""

STATISTICS = f"""
WITH {SHAPES_CTE},
agg AS (
  SELECT pn, count(*) AS nf, sum(CASE WHEN is_test_file THEN 1 ELSE 0 END) AS ntf,
         sum(file_lines) AS tl
  FROM fl WHERE visited GROUP BY pn
),
tagg AS (
  SELECT pn, count(*) AS nt, sum(lines) AS ntl FROM fn WHERE visited AND valid GROUP BY pn
),
projects AS (SELECT DISTINCT pn, project FROM fl)
SELECT p.project AS projectDir,
       CAST(coalesce(t.nt, 0) AS BIGINT) AS testCases,
       CAST(coalesce(a.ntf, 0) AS BIGINT) AS testFiles,
       CAST(coalesce(a.nf, 0) AS BIGINT) AS totalFiles,
       CAST(coalesce(t.ntl, 0) AS BIGINT) AS testLines,
       CASE WHEN coalesce(t.nt, 0) > 0 THEN CAST(t.ntl AS DOUBLE) / t.nt ELSE 0.0 END AS avgLinesPerTest,
       CASE WHEN coalesce(t.nt, 0) > 0 THEN CAST(t.ntl AS DOUBLE) / a.tl * 100 ELSE 0.0 END AS percentTestLines
FROM projects p LEFT JOIN agg a ON a.pn = p.pn LEFT JOIN tagg t ON t.pn = p.pn
"""

# ---------------------------------------------------------------- round trip, file level

def _files_per_project(where: str) -> str:
    return f"""
WITH {SHAPES_CTE}
SELECT project, count(*) AS n_files, CAST(sum(CASE WHEN is_test_file THEN 1 ELSE 0 END) AS BIGINT) AS n_test_files
FROM fl WHERE {where} GROUP BY project
"""


SCAN_SOURCES = _files_per_project("TRUE")
SKIP_VENDOR = _files_per_project("f % 17 <> 16")
SKIP_ERROR_FILES = _files_per_project("visited")

STATISTICS_BY_DIR = f"""
WITH {SHAPES_CTE},
fd AS (SELECT *, project || '/' || CASE WHEN f % 17 = 16 THEN 'vendor' ELSE package END AS dir FROM fl),
fnd AS (SELECT fn.*, project || '/' || CASE WHEN f % 17 = 16 THEN 'vendor' ELSE package END AS dir FROM fn),
agg AS (
  SELECT dir, count(*) AS nf, sum(CASE WHEN is_test_file THEN 1 ELSE 0 END) AS ntf, sum(file_lines) AS tl
  FROM fd WHERE visited GROUP BY dir
),
tagg AS (SELECT dir, count(*) AS nt, sum(lines) AS ntl FROM fnd WHERE visited AND valid GROUP BY dir),
dirs AS (SELECT DISTINCT dir FROM fd)
SELECT d.dir AS projectDir,
       CAST(coalesce(t.nt, 0) AS BIGINT) AS testCases,
       CAST(coalesce(a.ntf, 0) AS BIGINT) AS testFiles,
       CAST(coalesce(a.nf, 0) AS BIGINT) AS totalFiles,
       CAST(coalesce(t.ntl, 0) AS BIGINT) AS testLines,
       CASE WHEN coalesce(t.nt, 0) > 0 THEN CAST(t.ntl AS DOUBLE) / t.nt ELSE 0.0 END AS avgLinesPerTest,
       CASE WHEN coalesce(t.nt, 0) > 0 THEN CAST(t.ntl AS DOUBLE) / a.tl * 100 ELSE 0.0 END AS percentTestLines
FROM dirs d LEFT JOIN agg a ON a.dir = d.dir LEFT JOIN tagg t ON t.dir = d.dir
"""

# Function spans: functions follow the 7 header lines in key order, one blank line apart.
SPANS_CTE = SHAPES_CTE + """,
sp AS (
  SELECT fn.*,
         8 + coalesce(sum(lines) OVER (PARTITION BY f ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + (row_number() OVER (PARTITION BY f ORDER BY k) - 1) AS start_line
  FROM fn
)
"""

FUNC_DECLS = f"""
WITH {SPANS_CTE}
SELECT project, path, name, CAST(start_line AS INTEGER) AS start_line,
       CAST(start_line + lines - 1 AS INTEGER) AS end_line, v = 6 AS is_method
FROM sp WHERE visited
"""

VALID_TESTS = f"""
WITH {SHAPES_CTE}
SELECT project, path, name, v = 4 AS bad_format FROM fn WHERE visited AND valid
"""

BAD_FORMAT = f"""
WITH {SHAPES_CTE}
SELECT project, CAST(sum(CASE WHEN v = 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad_format, count(*) AS n_tests
FROM fn WHERE visited AND valid GROUP BY project
"""

TEST_CASES = f"""
WITH {SHAPES_CTE}
SELECT project, path AS filePath, package, name FROM fn WHERE visited AND valid
"""

TEST_LINES = f"""
WITH {SHAPES_CTE}
SELECT path, name, CAST(lines AS BIGINT) AS test_lines FROM fn WHERE visited AND valid
"""

TEST_LABEL = f"""
WITH {SHAPES_CTE}
SELECT 'TestCase{{Name: ' || name || ', Package: ' || package || ', FilePath: ' || path
       || ', Project: ' || project || '}}' AS label
FROM fn WHERE visited AND valid
"""

LINE_DEPTH = f"""
WITH {SHAPES_CTE}
SELECT fl.path, CAST(fl.file_lines + 3 AS BIGINT) AS n_lines,
       CAST(CASE WHEN max(CASE WHEN fn.v = 1 THEN 1 ELSE 0 END) = 1 THEN 3
                 WHEN max(CASE WHEN fn.v IN (0, 2) THEN 1 ELSE 0 END) = 1 THEN 2 ELSE 1 END AS BIGINT) AS max_depth
FROM fl JOIN fn ON fn.f = fl.f
WHERE fl.visited GROUP BY fl.path, fl.file_lines
"""

IMPORTS = f"""
WITH {SHAPES_CTE}
SELECT path, 1 AS import_ord, 'testing' AS import_path FROM fl WHERE visited
UNION ALL
SELECT path, 2 AS import_ord, 'strings' AS import_path FROM fl WHERE visited
"""

# ---------------------------------------------------------------- round trip, analysis

# Expected scenario facts per shape v (FIXTURES B.1): 0/1 struct list, 2 map.
ANALYSIS_CTE = SHAPES_CTE + """,
an AS (
  SELECT fn.*,
         CASE WHEN v IN (0, 1) THEN 'structList' WHEN v = 2 THEN 'map' ELSE 'none' END AS ds,
         CASE WHEN v IN (0, 1, 2) THEN n ELSE 0 END AS cnt,
         v IN (0, 1, 2) AND n > 0 AS table_driven,
         CASE WHEN v IN (0, 1) THEN 'name' WHEN v = 2 THEN 'map key' ELSE '' END AS name_field,
         CASE WHEN v IN (0, 1, 2) THEN 'want' ELSE '' END AS expected,
         v = 1 AS subtest
  FROM fn WHERE visited AND valid
)
"""

ANALYZE_REPORT = f"""
WITH {ANALYSIS_CTE}
SELECT project, path AS filePath, package, name, table_driven AS isTableDriven,
       ds AS scenarioDataStructure, CAST(cnt AS BIGINT) AS scenarioCount, name_field AS scenarioNameField,
       expected AS scenarioExpectedFields, false AS scenarioHasFunctionFields, subtest AS scenarioUsesSubtest,
       'none' AS refactorStrategy, 'none' AS refactorGenerationStatus,
       'notRun' AS originalExecutionResult, 'notRun' AS refactoredExecutionResult,
       'testing, strings' AS importedPackages
FROM an
"""

ANALYZE_SUMMARY = f"""
WITH {ANALYSIS_CTE}
SELECT project, count(*) AS n_tests, CAST(sum(CASE WHEN table_driven THEN 1 ELSE 0 END) AS BIGINT) AS n_table_driven
FROM an GROUP BY project
"""

TABLE_DRIVEN = f"""
WITH {ANALYSIS_CTE}
SELECT path, name, table_driven AS is_table_driven FROM an
"""

CONTAINER_KIND = f"""
WITH {ANALYSIS_CTE}
SELECT path, name, ds AS data_structure FROM an
"""

SCENARIO_COUNTS = f"""
WITH {ANALYSIS_CTE}
SELECT path, name, CAST(cnt AS BIGINT) AS scenario_count FROM an
"""

NAME_FIELD = f"""
WITH {ANALYSIS_CTE}
SELECT path, name, name_field FROM an
"""

EXPECTED_FIELDS = f"""
WITH {ANALYSIS_CTE}
SELECT path, name, expected AS expected_fields FROM an
"""

USES_SUBTEST = f"""
WITH {ANALYSIS_CTE}
SELECT path, name, subtest AS uses_subtest FROM an
"""

# Runner loop: the range statement is the 2nd top-level statement of shapes 0-2.
RUNNER_LOOP = f"""
WITH {ANALYSIS_CTE}
SELECT path, name, 2 AS runner_ord, CASE WHEN v = 2 THEN 'name' ELSE '_' END AS key_var, 'tt' AS value_var
FROM an WHERE v IN (0, 1, 2)
"""

STMT_COUNTS = f"""
WITH {SHAPES_CTE}
SELECT path, name, CAST(CASE WHEN v IN (0, 1, 2) THEN 2 WHEN v IN (3, 4, 5, 8) THEN 1 ELSE 0 END AS BIGINT) AS n_statements
FROM fn WHERE visited
"""

TESTER_PARAM = f"""
WITH {SHAPES_CTE}
SELECT path, name, CASE WHEN v = 9 THEN NULL ELSE 't' END AS tester FROM fn WHERE visited
"""

SCENARIO_SOURCE = f"""
WITH {ANALYSIS_CTE}
SELECT path, name, CAST(cnt AS BIGINT) AS n_scenarios,
       CASE WHEN v IN (0, 1) THEN '{{' || repeat(chr(34), 5) || ', 1}}'
            ELSE repeat(chr(34), 5) || ': {{1}}' END AS first_scenario
FROM an WHERE v IN (0, 1, 2) AND n > 0
"""

# ---------------------------------------------------------------- round trip, refactoring

_RUNS = """
runs AS (
  SELECT event_id // 2 AS k,
         max(CASE WHEN event_id % 2 = 0 THEN event_type END) AS o_type,
         max(CASE WHEN event_id % 2 = 1 THEN event_type END) AS r_type
  FROM events GROUP BY 1
)"""

_TYPE_RESULT = """CASE {c} WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'compilationError'
  WHEN 'click' THEN 'skip' WHEN 'view' THEN 'notRun' WHEN 'purchase' THEN 'pass' ELSE 'notRun' END"""

REFACTOR_CTE = ANALYSIS_CTE + """,
rf AS (SELECT an.*, v IN (0, 2) AND n > 0 AS ok FROM an)
"""

REFACTOR_CANDIDATES = f"""
WITH {REFACTOR_CTE}
SELECT path, name FROM rf WHERE ok
"""

REFACTOR_STATUS = f"""
WITH {REFACTOR_CTE}
SELECT path, name, CASE WHEN ok THEN 'success' ELSE 'none' END AS generation_status FROM rf
"""

REFACTOR_NAMES = f"""
WITH {REFACTOR_CTE}
SELECT path, name, CASE WHEN v = 0 THEN 'tt.name' ELSE 'name' END AS name_expr FROM rf WHERE ok
"""

SUBTEST_REWRITE = f"""
WITH {REFACTOR_CTE}
SELECT path, name,
  CASE WHEN v = 0 THEN
    'func TestK' || CAST(k AS VARCHAR) || '(t *testing.T) {{ tests := []struct {{ name string want int }}{{ '
    || array_to_string(list_transform(range(0, n), lambda i: '{{"s{{' || CAST(i AS VARCHAR) || '", 1}}, // }}'), ' ')
    || ' }} for _, tt := range tests {{ t.Run(tt.name, func(t *testing.T) {{ t.Log(tt.name, tt.want) }}) }} }}'
  ELSE
    'func TestK' || CAST(k AS VARCHAR) || '(t *testing.T) {{ tests := map[string]struct {{ want int }}{{ '
    || array_to_string(list_transform(range(0, n), lambda i: '"s{{' || CAST(i AS VARCHAR) || '": {{1}},'), ' ')
    || ' }} for name, tt := range tests {{ t.Run(name, func(t *testing.T) {{ t.Log(name, tt.want) }}) }} }}'
  END AS refactored_ws
FROM rf WHERE ok
"""

AFFECTED_FILES = f"""
WITH {REFACTOR_CTE}
SELECT project, count(DISTINCT path) AS n_files FROM rf WHERE ok GROUP BY project
"""

APPLY_PATCHES = f"""
WITH {REFACTOR_CTE}
SELECT path, count(*) AS n_patched FROM rf WHERE ok GROUP BY path
"""

RUNNER_LOCATION = f"""
WITH {ANALYSIS_CTE}
SELECT path, name, true AS runner_in_test FROM an WHERE v IN (0, 1, 2)
"""

REFACTOR_SUMMARY = f"""
WITH {REFACTOR_CTE}, {_RUNS}
SELECT project, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS refactor_attempts,
       CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS generation_successes,
       CAST(sum(CASE WHEN ok AND o_type = 'purchase' AND r_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT)
         AS refactor_successes
FROM rf LEFT JOIN runs ON runs.k = rf.k GROUP BY project
"""

ANALYZE_REFACTOR_REPORT = f"""
WITH {REFACTOR_CTE}, {_RUNS}
SELECT project, path AS filePath, package, name, table_driven AS isTableDriven,
       ds AS scenarioDataStructure, CAST(cnt AS BIGINT) AS scenarioCount, name_field AS scenarioNameField,
       expected AS scenarioExpectedFields, false AS scenarioHasFunctionFields, subtest AS scenarioUsesSubtest,
       'subtest' AS refactorStrategy, CASE WHEN ok THEN 'success' ELSE 'none' END AS refactorGenerationStatus,
       CASE WHEN ok THEN {_TYPE_RESULT.format(c='o_type')} ELSE 'notRun' END AS originalExecutionResult,
       CASE WHEN ok THEN {_TYPE_RESULT.format(c='r_type')} ELSE 'notRun' END AS refactoredExecutionResult,
       'testing, strings' AS importedPackages
FROM rf LEFT JOIN runs ON runs.k = rf.k
"""

REWRITE_REANALYSIS = f"""
WITH {REFACTOR_CTE}
SELECT path, name, true AS uses_subtest_after, 2 AS runner_index, true AS same_index_is_wrapped_loop
FROM rf WHERE ok
"""

# ---------------------------------------------------------------- sinks

REPORT_TEXT = f"""
SELECT projectDir,
  '=============  Statistics Report for "' || projectDir || '":  =============' || chr(10) || chr(10) ||
  CASE WHEN testCases = 0 THEN 'No test cases found in the specified project.' || chr(10)
  ELSE 'Total number of test cases: ' || CAST(testCases AS VARCHAR) || chr(10) || chr(10)
    || 'Number of ''_test.go'' files: ' || CAST(testFiles AS VARCHAR) || chr(10)
    || 'Total number of Go files: ' || CAST(totalFiles AS VARCHAR) || chr(10) || chr(10)
    || 'Total lines of test code: ' || CAST(testLines AS VARCHAR) || chr(10)
    || 'Average lines per test case: ' || printf('%.1f', round(avgLinesPerTest, 1)) || chr(10)
    || 'Percentage of total lines for test cases: ' || printf('%.1f', round(percentTestLines, 1)) || '%' || chr(10)
  END AS value
FROM ({STATISTICS}) s
"""

JSON_ROUNDTRIP = f"""
WITH {ANALYSIS_CTE}
SELECT path, name, package, project || '/' || project || '_' || package || '_' || name || '.json' AS doc_key,
       ds AS data_structure, CAST(cnt AS BIGINT) AS scenario_count, table_driven AS is_table_driven,
       'testing, strings' AS imports, 'none' AS strategy
FROM an
"""

JSON_FLATTEN = f"""
WITH {ANALYSIS_CTE}
SELECT 'testing' AS import_path, count(*) AS n_elements FROM an
UNION ALL
SELECT 'strings' AS import_path, count(*) AS n_elements FROM an
"""

CUSTOM_TASK = f"""
WITH {SHAPES_CTE},
h AS (SELECT f, pn, max(CASE WHEN v = 5 THEN 1 ELSE 0 END) AS has_h, sum(CASE WHEN v = 5 THEN 1 ELSE 0 END) AS n_h
      FROM fn GROUP BY f, pn),
vis AS (SELECT fl.project, h.has_h, h.n_h FROM fl JOIN h ON h.f = fl.f WHERE fl.visited)
SELECT project, CAST(sum(n_h) AS BIGINT) AS helper_calls, CAST(sum(has_h) AS BIGINT) AS files_with_helpers
FROM vis GROUP BY project
"""

# ---------------------------------------------------------------- round trip, call chains from part

CHAINS_CTE = """
ch AS (
  SELECT p_partkey AS p, p_partkey % 6 AS l, p_partkey % 4 = 0 AS cyc,
         '/src/chain/pkg' || CAST(p_partkey % 50 AS VARCHAR) || '/c' || CAST(p_partkey AS VARCHAR) || '_test.go' AS path,
         'TestC' || CAST(p_partkey AS VARCHAR) AS name
  FROM part
)
"""

EXPANSION_JSON = f"""
WITH {CHAINS_CTE}
SELECT path, name,
  CASE WHEN l = 0 THEN '[{{"stmt":"t.Log()"}}]'
  ELSE '[' || array_to_string(list_transform(range(0, l), lambda i:
              '{{"stmt":"h' || CAST(p AS VARCHAR) || '_' || CAST(i AS VARCHAR) || '(t)","children":['), '')
       || '{{"stmt":"' || CASE WHEN cyc THEN 'h' || CAST(p AS VARCHAR) || '_0(t)' ELSE 't.Log()' END || '"}}'
       || repeat(']}}', CAST(l AS INTEGER)) || ']'
  END AS json
FROM ch
"""

SELECTOR_CALLS = f"""
WITH {SHAPES_CTE}
SELECT path, name, CAST(CASE WHEN v IN (3, 4, 5) THEN 1 ELSE 0 END AS BIGINT) AS n_selector_calls
FROM fn WHERE visited
"""

STRUCT_FIELDS = f"""
WITH {ANALYSIS_CTE}
SELECT path, name, CASE WHEN v = 2 THEN 'want int' ELSE 'name string, want int' END AS fields
FROM an WHERE v IN (0, 1, 2)
"""

_STRUCT_ROWS = "CASE WHEN n > 0 THEN ' ' || array_to_string(list_transform(range(0, n), lambda i: '{\"s{' || CAST(i AS VARCHAR) || '\", 1}, // }'), ' ') ELSE '' END"
_MAP_ROWS = "CASE WHEN n > 0 THEN ' ' || array_to_string(list_transform(range(0, n), lambda i: '\"s{' || CAST(i AS VARCHAR) || '\": {1},'), ' ') ELSE '' END"

FUNC_TEXT = f"""
WITH {SHAPES_CTE}
SELECT path, name,
  CASE v
    WHEN 0 THEN name || '(t *testing.T) {{ tests := []struct {{ name string want int }}{{' || {_STRUCT_ROWS}
                || ' }} for _, tt := range tests {{ t.Log(tt.name, tt.want) }} }}'
    WHEN 1 THEN name || '(t *testing.T) {{ tests := []struct {{ name string want int }}{{' || {_STRUCT_ROWS}
                || ' }} for _, tt := range tests {{ t.Run(tt.name, func(t *testing.T) {{ t.Log(tt.want) }}) }} }}'
    WHEN 2 THEN name || '(t *testing.T) {{ tests := map[string]struct {{ want int }}{{' || {_MAP_ROWS}
                || ' }} for name, tt := range tests {{ t.Log(name, tt.want) }} }}'
    WHEN 3 THEN name || '(t *testing.T) {{ t.Log("}}") }}'
    ELSE name || '(t *testing.T) {{ t.Skip() }}'
  END AS text_ws0
FROM fn WHERE visited AND valid
"""
FUNC_TEXT = "SELECT path, name, 'func ' || text_ws0 AS text_ws FROM (" + FUNC_TEXT + ")"

# Every function of a chain has one call; helper i begins in line 9 + 4 i.
RESOLVE_CALLS = f"""
WITH {CHAINS_CTE},
fns AS (SELECT ch.*, i FROM ch, LATERAL (SELECT unnest(range(-1, l)) AS i)),
calls AS (
  SELECT path, CASE WHEN i < 0 THEN 'TestC' || CAST(p AS VARCHAR) ELSE 'h' || CAST(p AS VARCHAR) || '_' || CAST(i AS VARCHAR) END AS name,
         p, CASE WHEN i < l - 1 THEN i + 1 WHEN l > 0 AND cyc THEN 0 END AS callee_no
  FROM fns)
SELECT path, name, 1 AS stmt_ord, CASE WHEN callee_no IS NULL THEN 't' ELSE '' END AS owner,
       CASE WHEN callee_no IS NULL THEN 'Log' ELSE 'h' || CAST(p AS VARCHAR) || '_' || CAST(callee_no AS VARCHAR) END AS callee,
       CASE WHEN callee_no IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution,
       CASE WHEN callee_no IS NULL THEN '' ELSE path END AS def_path,
       CAST(CASE WHEN callee_no IS NULL THEN 0 ELSE 9 + 4 * callee_no END AS INTEGER) AS def_line
FROM calls
"""

# The owner corpus: one file for each customer, shape c % 8 (FIXTURES B.3).
OWNERS_CTE = """
ow AS (
  SELECT c_custkey AS c, c_custkey // 8 AS g, c_custkey % 8 AS v, CAST(c_custkey AS VARCHAR) AS cs, CAST(c_custkey // 8 AS VARCHAR) AS gs,
         '/src/own/pkg' || CAST((c_custkey // 8) % 40 AS VARCHAR) || '/o' || CAST(c_custkey AS VARCHAR) || '_test.go' AS path
  FROM customer
)
"""

CALL_OWNERS = f"""
WITH {OWNERS_CTE},
calls AS (
  SELECT path, 'TestO' || cs AS name, 1 AS stmt_ord, 'fmt' AS owner, 'Println' AS callee, 'unresolved' AS resolution, 0 AS def_line FROM ow WHERE v = 0
  UNION ALL SELECT path, 'dup' || gs, 1, 't', 'Log', 'unresolved', 0 FROM ow WHERE v = 0
  UNION ALL SELECT path, 'TestO' || cs, 1, '', 'twin' || gs, 'resolved', 12 FROM ow WHERE v IN (1, 2)
  UNION ALL SELECT path, 'twin' || gs, 1, 't', 'Helper', 'unresolved', 0 FROM ow WHERE v IN (1, 2)
  UNION ALL SELECT path, 'twin' || gs, 2, 't', 'Log', 'unresolved', 0 FROM ow WHERE v = 2
  UNION ALL SELECT path, 'TestO' || cs, 2, 'x', 'Do' || cs, 'resolved', 20 FROM ow WHERE v = 3
  UNION ALL SELECT path, 'TestO' || cs, 2, 'o', 'Deep' || cs, 'resolved', 12 FROM ow WHERE v = 4
  UNION ALL SELECT path, 'TestO' || cs, 3, 'o.f', 'Deep' || cs, 'resolved', 12 FROM ow WHERE v = 4
  UNION ALL SELECT path, 'TestO' || cs, 1, 'New' || cs || '().With' || cs || '(1)', 'With' || cs, 'resolved', 16 FROM ow WHERE v = 5
  UNION ALL SELECT path, 'TestO' || cs, 2, '', 'hid' || cs, 'unresolved', 0 FROM ow WHERE v = 6
  UNION ALL SELECT path, 'hid' || cs, 1, 't', 'Helper', 'unresolved', 0 FROM ow WHERE v = 6
  UNION ALL SELECT path, 'TestO' || cs, 1, '', 'dup' || gs, 'ambiguous', 0 FROM ow WHERE v = 7
  UNION ALL SELECT path, 'dup' || gs, 1, 't', 'Helper', 'unresolved', 0 FROM ow WHERE v = 7)
SELECT path, name, stmt_ord, owner, callee, resolution, CASE WHEN resolution = 'resolved' THEN path ELSE '' END AS def_path, def_line
FROM calls
"""

OWNER_EXPANSION = f"""
WITH {OWNERS_CTE}
SELECT path, 'TestO' || cs AS name, CAST(CASE v WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 2 WHEN 6 THEN 2 ELSE 1 END AS BIGINT) AS n_nodes,
       CAST(CASE WHEN v IN (0, 6, 7) THEN 0 ELSE 1 END AS BIGINT) AS max_level
FROM ow
"""

# The table corpus: one file for each customer, shape c % 8, n scenarios (FIXTURES B.4).
TABLES_CTE = """
tb AS (
  SELECT c_custkey % 8 AS v, (c_custkey // 8) % 5 AS n, CAST(c_custkey AS VARCHAR) AS cs,
         '/src/tab/pkg' || CAST((c_custkey // 8) % 40 AS VARCHAR) || '/t' || CAST(c_custkey AS VARCHAR) || '_test.go' AS path
  FROM customer
),
ts AS (
  SELECT path, 'TestT' || cs AS name, v, n, CASE WHEN v = 6 THEN n + 1 WHEN v IN (4, 5) THEN 0 ELSE n END AS found FROM tb
  UNION ALL SELECT path, 'TestN' || cs, -1, 0, 0 FROM tb WHERE v = 0
)
"""

SCENARIO_ORIGIN = f"""
WITH {TABLES_CTE}
SELECT path, name, CASE WHEN found = 0 THEN '' WHEN v = 0 THEN 'clause' WHEN v = 1 THEN 'local' WHEN v = 3 THEN 'file' ELSE 'helper' END AS scenario_source,
       CAST(found AS BIGINT) AS n_scenarios,
       CASE WHEN found = 0 THEN '' ELSE '{{' || repeat(chr(34), CASE WHEN v = 6 THEN 7 ELSE 4 END) || ', 1}}' END AS first_scenario
FROM ts
"""

RANGE_RESOLUTION = f"""
WITH {TABLES_CTE}
SELECT path, name, CASE WHEN v = -1 THEN 'none' WHEN v = 5 THEN 'unresolved' ELSE 'resolved' END AS range_resolution,
       CASE WHEN v IN (-1, 5) THEN 'none' ELSE 'structList' END AS container,
       CASE WHEN v IN (-1, 5) THEN '' ELSE 'struct{{name string;want int}}' END AS scenario_type
FROM ts
"""

ENCLOSING_FUNCTION = f"""
WITH {SHAPES_CTE}
SELECT path, name, lines AS n_lines, CAST(CASE WHEN v IN (0, 1, 2, 3) THEN 1 ELSE 0 END AS BIGINT) AS n_log_lines
FROM fn WHERE visited
"""

# The first function of a file begins in line 8, an empty line follows each.
POSITION_OWNER = f"""
WITH {SHAPES_CTE},
spans AS (
  SELECT path, name, lines, 8 + coalesce(sum(lines + 1) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_line
  FROM fn WHERE visited),
pos AS (SELECT fn.path, 1 + (l_linenumber * 7 + l_orderkey) % 70 AS line, count(*) AS m FROM lineitem JOIN fn ON k = l_orderkey GROUP BY ALL)
SELECT p.path, coalesce(s.name, '') AS name, CAST(sum(m) AS BIGINT) AS n_positions
FROM pos p LEFT JOIN spans s ON s.path = p.path AND p.line BETWEEN s.start_line AND s.start_line + s.lines - 1
GROUP BY p.path, coalesce(s.name, '')
"""

ARRAY_APPEND = """
SELECT CAST(p_partkey % 3 AS INTEGER) AS part, p_partkey % 3 = 1 AS nested, count(*) AS n_rows,
       '{"p":' || CAST(min(p_partkey) AS VARCHAR) || '}' AS first_element, '{"p":' || CAST(max(p_partkey) AS VARCHAR) || '}' AS last_element
FROM part GROUP BY p_partkey % 3
"""

# Statements, subtests and scenarios of the five shapes of the packed corpus (FIXTURES B.5).
PACKED_STATEMENTS = """
SELECT '/src/packed/pkg' || CAST(c_custkey % 40 AS VARCHAR) || '/p' || CAST(c_custkey AS VARCHAR) || '_test.go' AS path,
       'TestP' || CAST(c_custkey AS VARCHAR) AS name,
       CAST(CASE c_custkey % 5 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 3 END AS BIGINT) AS n_statements, c_custkey % 5 IN (1, 3) AS uses_subtest,
       CAST(CASE c_custkey % 5 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS n_scenarios,
       CASE c_custkey % 5 WHEN 1 THEN 'name' WHEN 3 THEN 'map key' ELSE '' END AS name_field
FROM customer
"""

RANGE_TYPES = f"""
WITH {ANALYSIS_CTE}
SELECT path, name, CASE WHEN v = 2 THEN 'struct{{want int}}' ELSE 'struct{{name string;want int}}' END AS scenario_type
FROM an WHERE v IN (0, 1, 2)
"""

FUNCTION_FIELDS = f"""
WITH {ANALYSIS_CTE}
SELECT path, name, false AS has_function_fields FROM an
"""

EXPAND_CALLS = f"""
WITH {CHAINS_CTE}
SELECT path, name, CAST(1 + l AS BIGINT) AS n_nodes, CAST(l AS BIGINT) AS max_level FROM ch
"""

EXPANSION_PREORDER = f"""
WITH {CHAINS_CTE}
SELECT path, name,
       CASE WHEN l = 0 THEN 't.Log()'
            ELSE array_to_string(list_transform(range(0, l), lambda i: 'h' || CAST(p AS VARCHAR) || '_' || CAST(i AS VARCHAR) || '(t)'), ' > ')
                 || ' > ' || CASE WHEN cyc THEN 'h' || CAST(p AS VARCHAR) || '_0(t)' ELSE 't.Log()' END
       END AS preorder
FROM ch
"""

PARSED_STATEMENTS = f"""
SELECT path, name, n_nodes, max_level, preorder FROM ({EXPAND_CALLS}) JOIN ({EXPANSION_PREORDER}) USING (path, name)
"""

# ---------------------------------------------------------------- direct (DT)

PATH_ROOT = """
SELECT CASE WHEN length(url) - length(replace(url, '/', '')) >= 3
            THEN array_to_string(string_split(url, '/')[1:3], '/') ELSE url END AS root_path,
       count(*) AS n_pages
FROM pages GROUP BY 1
"""

UNIT_SHARE = """
WITH t AS (
  SELECT conv_id, role = 'assistant' AS is_unit,
         length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS lines
  FROM conversations
), g AS (
  SELECT conv_id, CAST(sum(CASE WHEN is_unit THEN 1 ELSE 0 END) AS BIGINT) AS units,
         CAST(coalesce(sum(CASE WHEN is_unit THEN lines END), 0) AS BIGINT) AS unit_lines,
         CAST(sum(lines) AS BIGINT) AS total_lines
  FROM t GROUP BY conv_id
)
SELECT conv_id, units, unit_lines, total_lines,
       CASE WHEN units > 0 THEN CAST(unit_lines AS DOUBLE) / units ELSE 0.0 END AS avg_unit_lines,
       CASE WHEN units > 0 THEN CAST(unit_lines AS DOUBLE) / total_lines * 100 ELSE 0.0 END
         AS percent_unit_lines
FROM g
"""

# Expected outcome per event type of the generated run log (fixed mapping).
_RESULT_BY_TYPE = """CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'compilationError'
  WHEN 'click' THEN 'skip' WHEN 'view' THEN 'notRun' WHEN 'purchase' THEN 'pass' END"""

CLASSIFY_RUNS = f"""
SELECT event_id AS run_id, event_id // 2 AS test_id,
       CASE WHEN event_id % 2 = 0 THEN 'original' ELSE 'refactored' END AS phase,
       {_RESULT_BY_TYPE} AS result
FROM events
"""

RUN_MESSAGES = f"""
WITH {SHAPES_CTE}
SELECT event_id AS run_id, {_RESULT_BY_TYPE} AS result,
  CASE event_type
    WHEN 'error' THEN 'test failed: ' || CASE WHEN event_id % 3 = 0 THEN '[no stderr output]'
                                              ELSE 'exit status 1: error' END
    WHEN 'signup' THEN 'compilation error: ' || CASE WHEN event_id % 3 = 0 THEN '[no stderr output]'
                                                     ELSE 'exit status 1: signup' END
    WHEN 'view' THEN 'no tests to run for pattern "^' || fn.name || '$" in file "' || fn.path || '"'
  END AS message
FROM events JOIN fn ON fn.k = events.event_id // 2
"""

OUTCOME_COMPARE = f"""
WITH r AS (SELECT event_id // 2 AS test_id, event_id % 2 AS ph, {_RESULT_BY_TYPE} AS result FROM events),
t AS (
  SELECT test_id, coalesce(max(CASE WHEN ph = 0 THEN result END), 'notRun') AS o,
         coalesce(max(CASE WHEN ph = 1 THEN result END), 'notRun') AS f
  FROM r GROUP BY test_id
)
SELECT o AS originalExecutionResult, f AS refactoredExecutionResult, o <> f AS changed,
       count(*) AS n_tests
FROM t GROUP BY 1, 2, 3
"""

DETECT_FORMAT = """
SELECT doc_id,
       source || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.CSV' WHEN 2 THEN '.json'
                                 WHEN 3 THEN '.md' ELSE '' END AS file_name,
       CASE doc_id % 5 WHEN 0 THEN 'Txt' WHEN 1 THEN 'CSV' WHEN 2 THEN 'JSON' ELSE 'Unknown' END AS format
FROM documents
"""

ENUM_DECODE = """
SELECT event_id,
  CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'compilationError' WHEN 'click' THEN 'skip'
                  ELSE 'notRun' END AS execution_result,
  CASE event_type WHEN 'error' THEN 'badFields' WHEN 'signup' THEN 'noTester' WHEN 'click' THEN 'success'
                  WHEN 'view' THEN 'error' ELSE 'none' END AS generation_status,
  CASE event_type WHEN 'error' THEN 'subtest' WHEN 'click' THEN 'subtest' ELSE 'none' END AS strategy
FROM events
"""

ORACLES: dict[str, str] = {
    "statistics": STATISTICS,
    "scan_sources": SCAN_SOURCES,
    "skip_vendor": SKIP_VENDOR,
    "skip_error_files": SKIP_ERROR_FILES,
    "distinct_files": SKIP_ERROR_FILES,
    "statistics_by_dir": STATISTICS_BY_DIR,
    "func_decls": FUNC_DECLS,
    "valid_tests": VALID_TESTS,
    "bad_format": BAD_FORMAT,
    "test_cases": TEST_CASES,
    "test_lines": TEST_LINES,
    "test_label": TEST_LABEL,
    "line_depth": LINE_DEPTH,
    "imports": IMPORTS,
    "analyze_report": ANALYZE_REPORT,
    "analyze_summary": ANALYZE_SUMMARY,
    "table_driven": TABLE_DRIVEN,
    "container_kind": CONTAINER_KIND,
    "scenario_counts": SCENARIO_COUNTS,
    "name_field": NAME_FIELD,
    "expected_fields": EXPECTED_FIELDS,
    "uses_subtest": USES_SUBTEST,
    "runner_loop": RUNNER_LOOP,
    "stmt_counts": STMT_COUNTS,
    "tester_param": TESTER_PARAM,
    "scenario_source": SCENARIO_SOURCE,
    "expand_calls": EXPAND_CALLS,
    "expansion_json": EXPANSION_JSON,
    "rewrite_reanalysis": REWRITE_REANALYSIS,
    "selector_calls": SELECTOR_CALLS,
    "struct_fields": STRUCT_FIELDS,
    "func_text": FUNC_TEXT,
    "resolve_calls": RESOLVE_CALLS,
    "call_owners": CALL_OWNERS,
    "owner_expansion": OWNER_EXPANSION,
    "scenario_origin": SCENARIO_ORIGIN,
    "range_resolution": RANGE_RESOLUTION,
    "enclosing_function": ENCLOSING_FUNCTION,
    "position_owner": POSITION_OWNER,
    "parsed_statements": PARSED_STATEMENTS,
    "array_append": ARRAY_APPEND,
    "packed_statements": PACKED_STATEMENTS,
    "range_types": RANGE_TYPES,
    "function_fields": FUNCTION_FIELDS,
    "custom_task": CUSTOM_TASK,
    "stream_append": "SELECT run_id, result, message FROM (" + RUN_MESSAGES + ")",
    "stream_statistics": "SELECT * FROM (" + STATISTICS + ") WHERE totalFiles > 0",
    "stream_func_decls": FUNC_DECLS,
    "report_text": REPORT_TEXT,
    "json_roundtrip": JSON_ROUNDTRIP,
    "json_flatten": JSON_FLATTEN,
    "refactor_candidates": REFACTOR_CANDIDATES,
    "refactor_status": REFACTOR_STATUS,
    "refactor_names": REFACTOR_NAMES,
    "subtest_rewrite": SUBTEST_REWRITE,
    "affected_files": AFFECTED_FILES,
    "apply_patches": APPLY_PATCHES,
    "runner_location": RUNNER_LOCATION,
    "refactor_summary": REFACTOR_SUMMARY,
    "analyze_refactor_report": ANALYZE_REFACTOR_REPORT,
    "expansion_preorder": EXPANSION_PREORDER,
    "path_root": PATH_ROOT,
    "unit_share": UNIT_SHARE,
    "classify_runs": CLASSIFY_RUNS,
    "run_messages": RUN_MESSAGES,
    "outcome_compare": OUTCOME_COMPARE,
    "detect_format": DETECT_FORMAT,
    "enum_decode": ENUM_DECODE,
}
