"""Scenario analysis of table-driven tests.

All steps are joins, windows and aggregates keyed by the test key
``(project, path, func_line)``; types are compared as normalised text, named
types resolved through the package's ``type`` declarations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testsieve.operators import decls as dc
from testsieve.operators import expand as ex
from testsieve.operators import exprtypes as et
from testsieve.operators import statements as sm
from testsieve.operators.exprtypes import LIST_PREFIX, element as _elem, normalize_type
from testsieve.session import cut_lineage

TEST_KEY = ["project", "path", "func_line"]

MAP_PREFIX = r"^map\[([^\]]*)\]"
# Words in any case; `lower` would have each process build Spark's tables of cases first (some 7 s).
EXPECTED_WORDS = r"(?i)expect|want|result"
NAME_WORDS = r"(?i)name|desc"


def _container(t):
    return (F.when(t.rlike(LIST_PREFIX), F.lit("structList"))
            .when(t.rlike(MAP_PREFIX), F.lit("map")))


def specs(flat, keyword: str, levels: int):
    """The specifications of a ``type`` or ``var`` declaration, grouped in parentheses or not."""
    group = rf"^\s*{keyword}\s*\((.*)\)\s*$"
    many = F.regexp_extract_all(F.regexp_extract(flat, group, 1), F.lit(sm.item_pattern(levels, ";")), 0)
    one = F.array(F.regexp_replace(flat, rf"^\s*{keyword}\s+", ""))
    return F.filter(F.transform(F.when(flat.rlike(group), many).otherwise(one), lambda x: F.trim(x)), lambda x: x != "")


def type_decls(lines: DataFrame, levels: int | None = None) -> DataFrame:
    """Package-level named types: ``(project, pkg, type_name, underlying)``. A name of a
    named type is followed to the end; a name declared twice with different types is left out."""
    d = dc.decl_texts(lines, ("type",)).filter(F.col("kind") == "type").withColumn("flat", sm.flatten(F.col("masked")))
    levels = sm.deepest(d) if levels is None else levels
    d = d.select("project", "pkg", F.explode(specs(F.col("flat"), "type", levels)).alias("spec"))
    pattern = r"^(\w+)\s*(?:=\s*)?(.*)$"
    t = (d.select("project", "pkg", F.regexp_extract("spec", pattern, 1).alias("type_name"),
                  normalize_type(F.regexp_extract("spec", pattern, 2)).alias("underlying"))
         .filter(F.col("type_name") != "").groupBy("project", "pkg", "type_name")
         .agg(F.min("underlying").alias("underlying"), F.max("underlying").alias("other"))
         .filter(F.col("underlying") == F.col("other")).drop("other"))
    t, open_ = cut_lineage(t), None
    while True:  # each step halves what is left of every chain of names
        u = t.select("project", "pkg", F.col("type_name").alias("underlying"), F.col("underlying").alias("next"))
        stepped = t.join(u, ["project", "pkg", "underlying"], "left")
        left = stepped.filter(F.col("next").isNotNull()).count()
        if not left or left == open_:  # what is left then names itself, which is no Go
            return t
        t, open_ = cut_lineage(stepped.select("project", "pkg", "type_name", F.coalesce("next", "underlying").alias("underlying"))), left


def _resolve(df: DataFrame, col: str, types: DataFrame, out: str) -> DataFrame:
    """Replace a named type in ``col`` by its package-level underlying type, followed to the
    end (left equi-join on project, package and type name)."""
    t = types.select(F.col("project").alias("__p"), F.col("pkg").alias("__d"),
                     F.col("type_name").alias("__tn"), F.col("underlying").alias("__u"))
    j = df.join(
        t, (F.col("project") == F.col("__p")) & (F.col("pkg") == F.col("__d"))
        & (F.regexp_replace(F.col(col), r"^\*", "") == F.col("__tn")), "left")
    return (j.withColumn(out, F.when(F.col("__u").isNotNull() & ~F.col(col).startswith("*"), F.col("__u"))
                         .otherwise(F.col(col)))
            .drop("__p", "__d", "__tn", "__u"))


def literal_parts(expr_col, levels: int):
    """(type, elements text) of an expression that is one composite literal."""
    pattern = sm.literal_pattern(levels)
    return F.regexp_extract(expr_col, pattern, 1), F.regexp_extract(expr_col, pattern, 2)


def top_level_items(elems, levels: int):
    """Top-level comma-separated items of a literal body (nested groups hidden)."""
    items = F.regexp_extract_all(elems, F.lit(sm.item_pattern(levels)), 0)
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def _literal_facts(df: DataFrame, expr_col: str, levels: int, types: DataFrame, keep_all: bool = False) -> DataFrame:
    """Add literal facts: ``lit_type, lit_container, lit_elem, n_elems, lit_items,
    first_ok``; rows whose expression is not a literal are dropped unless
    ``keep_all``. A named list or map type is followed to what it names."""
    ltype, elems = literal_parts(F.col(expr_col), levels)
    df = df.withColumn("lit_type", normalize_type(ltype)).withColumn("lit_elems", elems)
    if not keep_all:
        df = df.filter(F.col("lit_type") != "")
    df = _resolve(df, "lit_type", types, "lit_under")
    items = top_level_items(F.col("lit_elems"), levels)
    first = F.trim(F.try_element_at(items, F.lit(1)))
    keyed = first.rlike(r"^[^{]*:")
    container = _container(F.col("lit_under"))
    first_ok = (F.size(items) > 0) & ~first.startswith("&") & F.when(
        container == "map", keyed).otherwise(~keyed)
    return (df.withColumn("lit_container", container)
            .withColumn("lit_elem", _elem(F.col("lit_under")))
            .withColumn("n_elems", F.size(items).cast("long"))
            .withColumn("lit_items", F.transform(items, lambda x: F.trim(x)))
            .withColumn("first_ok", first_ok).drop("lit_under"))


def local_literals(stmts: DataFrame, levels: int, types: DataFrame) -> DataFrame:
    """Assignments / ``var`` statements whose single right-hand side is a
    composite literal: ``(test key, stmt_ord, var_name, lit_*)``."""
    flat = F.col("flat")
    a_lhs = F.regexp_extract(flat, sm.ASSIGN_PATTERN, 1)
    a_rhs = F.regexp_extract(flat, sm.ASSIGN_PATTERN, 2)
    v_lhs = F.regexp_extract(flat, sm.VAR_PATTERN, 1)
    v_rhs = F.regexp_extract(flat, sm.VAR_PATTERN, 3)
    is_var = flat.rlike(r"^\s*var\s")
    s = stmts.filter(flat.contains("="))  # else nothing is set
    s = s.select(*TEST_KEY, "pkg", "stmt_ord",
                 F.when(is_var, v_lhs).otherwise(a_lhs).alias("var_name"),
                 F.when(is_var, v_rhs).otherwise(a_rhs).alias("rhs"))
    s = s.filter((F.col("rhs") != "") & ~F.col("var_name").contains(","))
    return _literal_facts(s, "rhs", levels, types)


def file_var_literals(lines: DataFrame, types: DataFrame, levels: int | None = None) -> DataFrame:
    """Package-level ``var x = T{...}`` of each file, in file order."""
    d = dc.decl_texts(lines, ("var",)).filter(F.col("kind") == "var").withColumn("flat", sm.flatten(F.col("masked")))
    levels = sm.deepest(d) if levels is None else levels
    d = d.select("project", "path", "pkg", "start_line", F.posexplode(specs(F.col("flat"), "var", levels)).alias("nth", "spec"))
    spec = F.concat(F.lit("var "), F.col("spec"))
    s = d.select("project", "path", "pkg", F.struct("start_line", "nth").alias("decl_ord"),
                 F.regexp_extract(spec, sm.VAR_PATTERN, 1).alias("var_name"),
                 normalize_type(F.regexp_extract(spec, sm.VAR_PATTERN, 2)).alias("declared"),
                 F.regexp_extract(spec, sm.VAR_PATTERN, 3).alias("rhs"))
    return _literal_facts(s.filter((F.col("rhs") != "") | (F.col("declared") != "")), "rhs", levels, types, keep_all=True)


def local_declarations(stmts: DataFrame) -> DataFrame:
    """``var x T`` statements of a body: ``(test key, stmt_ord, var_name, declared)``."""
    flat = F.col("flat")
    d = stmts.filter(flat.rlike(r"^\s*var\s+\w")).select(
        *TEST_KEY, "stmt_ord", F.explode(F.split(F.regexp_extract(flat, sm.VAR_PATTERN, 1), r"\s*,\s*")).alias("var_name"),
        normalize_type(F.regexp_extract(flat, sm.VAR_PATTERN, 2)).alias("declared"))
    return d.filter((F.col("declared") != "") & (F.col("var_name") != ""))


def range_loops(stmts: DataFrame, levels: int) -> DataFrame:
    """Top-level ``for ... range`` statements of each function."""
    flat = F.col("flat")
    simple = flat.rlike(sm.SIMPLE_RANGE_PATTERN)
    whole = sm.range_pattern(levels)
    key = F.when(simple, F.regexp_extract(flat, sm.SIMPLE_RANGE_PATTERN, 1)).otherwise(
        F.regexp_extract(flat, whole, 1))
    val = F.when(simple, F.regexp_extract(flat, sm.SIMPLE_RANGE_PATTERN, 2)).otherwise(
        F.regexp_extract(flat, whole, 2))
    expr = F.when(simple, F.regexp_extract(flat, sm.SIMPLE_RANGE_PATTERN, 3)).otherwise(
        F.regexp_extract(flat, whole, 3))
    r = stmts.filter(flat.rlike(r"^\s*for\s.*\brange\b")).select(
        *TEST_KEY, "pkg", "stmt_ord", "stmt_line", "end_line", "children", "text",
        F.when(key != "", key).alias("key_var"), F.when(val != "", val).alias("value_var"),
        F.trim(expr).alias("range_expr"))
    return r.filter(F.col("range_expr") != "")


def _keep(df: DataFrame) -> DataFrame:
    """Materialise an intermediate table that several joins of one plan read
    (its size is proportional to the number of statements, not to the text)
    as a reliable checkpoint, so the plans that read it stay small."""
    return cut_lineage(df)


def _match(container_col, elem_col, elem_id_col, n_col, first_ok_col, lit_container_col):
    """A literal holds the scenarios when its kind agrees with the runner's
    container, it is not empty, its first element is neither a pointer nor
    keyed (list) / is keyed (map), and its element type is identical."""
    return ((lit_container_col == container_col) & first_ok_col & (n_col > 0)
            & ~elem_col.startswith("*") & (elem_id_col == F.col("scenario_type")))


def variables(fvars: DataFrame) -> DataFrame:
    """Package-level variables as :func:`exprtypes.types_of` reads them: ``(project, pkg, path,
    name, type, expr)``."""
    t = F.when(F.col("declared") != "", F.col("declared")).when(F.col("lit_type") != "", F.col("lit_type"))
    return fvars.filter(F.col("var_name").rlike(r"^\w+$")).select(
        "project", "pkg", "path", F.col("var_name").alias("name"), t.alias("type"), F.when(F.col("rhs") != "", F.col("rhs")).alias("expr"))


def range_expression_types(loops: DataFrame, facts) -> DataFrame | None:
    """J4 of ranged expressions that are neither a literal nor a name set to one: results of
    calls, fields, parts of lists, names set to any of these, to any length of such a chain.
    ``(test key, stmt_ord, expr_type)``, or None if there are none."""
    if loops.isEmpty():
        return None
    index = cut_lineage(et.function_index(facts.funcs, facts.levels()))
    exprs = cut_lineage(loops.join(index.select(*TEST_KEY, "aliases"), TEST_KEY).select(
        F.concat_ws("|", "path", "func_line", "stmt_ord").alias("eid"), *TEST_KEY, "pkg", "aliases", F.col("stmt_ord").alias("at"),
        F.lit(False).alias("within"), F.col("range_expr").alias("expr"), F.lit(0).alias("nth")))
    if exprs.isEmpty():
        return None
    keys = exprs.select(*TEST_KEY).distinct()
    defs = et.local_defs(facts.stmts.join(keys, TEST_KEY, "left_semi"), index.join(keys, TEST_KEY, "left_semi"), facts.levels())
    types = facts.types()
    found = et.types_of(exprs, cut_lineage(defs), variables(facts.file_vars()), index, types, et.members(types, index, facts.levels()), facts.levels())
    return exprs.select("eid", *TEST_KEY, F.col("at").alias("stmt_ord")).join(found, "eid").select(*TEST_KEY, "stmt_ord", F.col("type").alias("expr_type"))


def helper_literals(runner: DataFrame, facts, types: DataFrame, levels: int) -> DataFrame | None:
    """W3 over helpers: literals that statements of entered helpers assign, with their place
    (``node_path``) in the expansion of the test's statements before the runner. ``runner``:
    test key and ``stmt_ord`` of runners that look for scenarios; None if no such statement
    calls anything."""
    before = facts.stmts.filter(F.col("flat").contains("(")).select(*TEST_KEY, "stmt_ord").join(
        runner.select(*TEST_KEY, F.col("stmt_ord").alias("runner_ord")), TEST_KEY).filter(F.col("stmt_ord") < F.col("runner_ord"))
    before = cut_lineage(before.select(*TEST_KEY, "stmt_ord"))
    if before.isEmpty():
        return None
    roots = cut_lineage(before.join(facts.calls().select(*TEST_KEY, "stmt_ord"), TEST_KEY + ["stmt_ord"], "left_semi"))
    if roots.isEmpty():
        return None
    nodes = facts.expand(roots).filter("kind = 'stmt' and level > 0").join(facts.tests().select(*TEST_KEY, "pkg"), TEST_KEY)
    lits = local_literals(nodes.select(*TEST_KEY, "pkg", F.col("node_path").alias("stmt_ord"), "flat"), levels, types)
    return _resolve(lits, "lit_elem", types, "lit_elem_id").withColumnRenamed("stmt_ord", "node_path")


def scenario_sets(tests: DataFrame, stmts: DataFrame, lines: DataFrame, facts=None) -> DataFrame:
    """One row per test with the scenario-set facts of the reference analysis.

    ``tests`` needs ``project, path, func_line, header, pkg``. Plan: range loops,
    local literals and file-level literals are each typed once; the runner is
    picked by a window; scenario literals are found by equi-joins on
    ``(test key, container, element type)`` and ranked by source. With ``facts``
    (:class:`testsieve.plans.analyze.Facts`) types are followed through calls and
    literals are looked for in helpers.

    ``scenario_source``: ``clause``, ``local``, ``helper``, ``file`` or empty;
    ``range_resolution``: ``resolved``, ``none`` (no loop over a known container) or
    ``unresolved`` (the type of a loop that could be the runner was not found).
    """
    types = type_decls(lines) if facts is None else facts.types()
    levels = sm.deepest(stmts) if facts is None else facts.levels()
    keys = tests.select(*TEST_KEY)
    loops = range_loops(stmts, levels).join(keys, TEST_KEY, "left_semi")
    loops = _literal_facts(loops.withColumn("rhs", F.col("range_expr")), "rhs", levels, types, keep_all=True)
    loops = _keep(_resolve(loops, "lit_elem", types, "lit_elem_id"))

    lits = local_literals(stmts, levels, types).join(keys, TEST_KEY, "left_semi")
    lits = _keep(_resolve(lits, "lit_elem", types, "lit_elem_id"))
    file_level = file_var_literals(lines, types) if facts is None else facts.file_vars()
    fvars = _keep(_resolve(file_level, "lit_elem", types, "lit_elem_id"))

    # Type of the ranged expression: literal in the clause, else the
    # closest earlier local declaration, else a package-level var.
    local = (loops.filter(F.col("range_expr").rlike(r"^\w+$"))
             .select(*TEST_KEY, "stmt_ord", "range_expr")
             .join(lits.select(*TEST_KEY, F.col("stmt_ord").alias("decl_ord"),
                               F.col("var_name").alias("range_expr"), F.col("lit_type").alias("local_type"))
                   .unionByName(local_declarations(stmts).join(keys, TEST_KEY, "left_semi").select(
                       *TEST_KEY, F.col("stmt_ord").alias("decl_ord"), F.col("var_name").alias("range_expr"),
                       F.col("declared").alias("local_type"))),
                   TEST_KEY + ["range_expr"])
             .filter(F.col("decl_ord") < F.col("stmt_ord"))
             .groupBy(*TEST_KEY, "stmt_ord")
             .agg(F.max_by("local_type", "decl_ord").alias("local_type")))
    # a name that the folder declares with different types stays unresolved
    var_type = F.when(F.col("declared") != "", F.col("declared")).when(F.col("lit_type") != "", F.col("lit_type"))
    pkg_vars = (fvars.select("project", "pkg",
                             F.col("var_name").alias("range_expr"), var_type.alias("pkg_type"))
                .groupBy("project", "pkg", "range_expr").agg(F.min("pkg_type").alias("pkg_type"), F.max("pkg_type").alias("other"))
                .filter(F.col("pkg_type") == F.col("other")).drop("other"))
    typed = (loops.join(local, TEST_KEY + ["stmt_ord"], "left")
             .join(pkg_vars, ["project", "pkg", "range_expr"], "left")
             .withColumn("range_type", F.coalesce(F.when(F.col("lit_type") != "", F.col("lit_type")),
                                                  "local_type", "pkg_type")))
    if facts is not None:
        typed = _keep(typed)  # read below and by what looks for the loops that are left
        followed = range_expression_types(typed.filter("range_type is null"), facts)
        if followed is not None:
            typed = (typed.join(followed, TEST_KEY + ["stmt_ord"], "left")
                     .withColumn("range_type", F.coalesce("range_type", F.when(F.col("expr_type") != et.EXTERNAL, F.col("expr_type")))))
    typed = _resolve(typed, "range_type", types, "range_type")

    # Container kind and scenario type ----------------------------------
    rt = F.col("range_type")
    typed = (typed.withColumn("container", _container(rt))
             .withColumn("elem_raw", F.regexp_replace(_elem(rt), r"^\*", ""))
             .withColumn("map_key", F.regexp_extract(rt, MAP_PREFIX, 1)))
    typed = _resolve(typed, "elem_raw", types, "scenario_type")
    is_struct = F.col("scenario_type").startswith("struct{")
    typed = typed.withColumn(
        "container", F.when((F.col("container") == "structList") & ~is_struct, F.lit(None))
        .otherwise(F.col("container")))

    # runner = last top-level range loop with a known container ----------
    typed = _keep(typed)
    unknown = typed.groupBy(*TEST_KEY).agg(F.max(F.when(F.col("range_type").isNull(), F.col("stmt_ord"))).alias("unknown_ord"))
    w = Window.partitionBy(*TEST_KEY).orderBy(F.col("stmt_ord").desc())
    runner = (typed.filter(F.col("container").isNotNull())
              .withColumn("rk", F.row_number().over(w)).filter("rk = 1").drop("rk"))
    clause_ok = _match(F.col("container"), F.col("lit_elem"), F.col("lit_elem_id"), F.col("n_elems"),
                       F.col("first_ok"), F.col("lit_container"))
    runner = _keep(runner.withColumn("clause_sc", F.when(F.coalesce(clause_ok, F.lit(False)),
                                                         F.struct("n_elems", "lit_items"))))
    r = runner.select(*TEST_KEY, F.col("stmt_ord").alias("runner_ord"), "container", "scenario_type")

    # The closest earlier statement that assigns a literal of the scenario type, itself
    # or in a helper that it enters; in one statement the first in pre-order ---
    near = lits.select(*TEST_KEY, F.array((F.col("stmt_ord") - 1).cast("int")).alias("node_path"), "lit_container", "lit_elem", "lit_elem_id", "n_elems", "first_ok", "lit_items")
    in_helpers = None if facts is None else helper_literals(runner.filter("clause_sc is null"), facts, types, levels)
    if in_helpers is not None:
        near = near.unionByName(in_helpers.select(*TEST_KEY, F.col("node_path").cast("array<int>"), "lit_container", "lit_elem", "lit_elem_id", "n_elems", "first_ok", "lit_items"))
    closest = Window.partitionBy(*TEST_KEY).orderBy(F.get("node_path", F.lit(0)).desc(), "node_path")
    near_sc = (near.join(r, TEST_KEY)
               .filter((F.get("node_path", F.lit(0)) + 1 < F.col("runner_ord"))
                       & _match(F.col("container"), F.col("lit_elem"), F.col("lit_elem_id"),
                                F.col("n_elems"), F.col("first_ok"), F.col("lit_container")))
               .withColumn("rk", F.row_number().over(closest)).filter("rk = 1")
               .select(*TEST_KEY, F.struct("n_elems", "lit_items").alias("near_sc"),
                       F.when(F.size("node_path") == 1, F.lit("local")).otherwise(F.lit("helper")).alias("near_source")))
    # First file-level var literal of the scenario type (equi-join on type); one literal
    # for each file and type goes into the join.
    first_vars = (fvars.filter((F.col("lit_type") != "") & F.col("first_ok") & (F.col("n_elems") > 0) & ~F.col("lit_elem").startswith("*"))
                  .groupBy("project", "path", "lit_container", "lit_elem_id")
                  .agg(F.min_by(F.struct("n_elems", "lit_items"), "decl_ord").alias("file_sc"), F.min("decl_ord").alias("decl_ord")))
    file_sc = (first_vars
               .join(r.withColumnRenamed("container", "lit_container")
                     .withColumn("lit_elem_id", F.col("scenario_type")),
                     ["project", "path", "lit_container", "lit_elem_id"])
               .groupBy(*TEST_KEY)
               .agg(F.min_by("file_sc", "decl_ord").alias("file_sc")))
    chosen = (runner.select(*TEST_KEY, "stmt_ord", "container", "scenario_type", "map_key",
                            "key_var", "value_var", "children", "clause_sc")
              .join(near_sc, TEST_KEY, "left")
              .join(file_sc, TEST_KEY, "left")
              .withColumn("sc", F.coalesce("clause_sc", "near_sc", "file_sc"))
              .withColumn("source", F.when(F.col("clause_sc").isNotNull(), F.lit("clause")).when(F.col("near_sc").isNotNull(), F.col("near_source"))
                          .when(F.col("file_sc").isNotNull(), F.lit("file")))
              .drop("clause_sc", "near_sc", "near_source", "file_sc"))

    # Fields of the scenario struct (F15) --------------------------------------
    base = tests.select(*TEST_KEY, "pkg", "header").join(chosen, TEST_KEY, "left").join(unknown, TEST_KEY, "left")
    fields = struct_fields(F.col("scenario_type"), levels)
    base = base.withColumn("fields", fields)
    # A10 looks at the underlying type: named field types are resolved through
    # the package's type declarations before testing for a function type.
    ft = base.select(*TEST_KEY, "pkg", F.explode("fields").alias("f")).select(
        *TEST_KEY, "pkg", F.col("f.type").alias("ftype"))
    ft = _resolve(ft, "ftype", types, "ftype_u")
    func_fields = ft.groupBy(*TEST_KEY).agg(F.bool_or(F.col("ftype_u").startswith("func")).alias("func_field"))
    base = base.join(func_fields, TEST_KEY, "left")

    # A11 uses subtest, J6 first Run argument ------------------------------------
    tvar = sm.tester_param(F.col("header"))
    run_pat = F.concat(F.lit(r"^\s*"), tvar, F.lit(r"\s*\.\s*Run\s*\("))
    runs = F.filter(F.coalesce(F.col("children"), F.array()),
                    lambda c: F.coalesce(F.rlike(c["masked"], run_pat), F.lit(False)))
    first_run = F.try_element_at(runs, F.lit(1))
    uses_subtest = tvar.isNotNull() & (F.size(runs) > 0)
    run_arg_field = F.regexp_extract(first_run["masked"], r"\.\s*Run\s*\(\s*\w+(?:\s*\[[^\]]*\])?\s*\.\s*(\w+)\s*,", 1)
    field_names = F.transform("fields", lambda f: f["name"])
    is_struct = F.coalesce(F.col("scenario_type").startswith("struct{"), F.lit(False))
    name_by_words = F.try_element_at(F.transform(F.filter(
        "fields", lambda f: (f["type"] == "string") & f["name"].rlike(NAME_WORDS)), lambda f: f["name"]), F.lit(1))
    name_field = (F.when((F.col("container") == "map") & (F.col("map_key") == "string"), F.lit("map key"))
                  .when(~is_struct, F.lit(""))
                  .when(uses_subtest, F.when(F.array_contains(field_names, run_arg_field), run_arg_field)
                        .otherwise(F.lit("")))
                  .otherwise(F.coalesce(name_by_words, F.lit(""))))
    expected = F.when(is_struct, F.transform(F.filter(
        "fields", lambda f: f["name"].rlike(EXPECTED_WORDS)), lambda f: f["name"])).otherwise(F.array().cast("array<string>"))
    has_func = is_struct & F.coalesce(F.col("func_field"), F.lit(False))
    count = F.coalesce(F.col("sc.n_elems"), F.lit(0)).cast("long")
    ds = F.coalesce(F.col("container"), F.lit("none"))
    return base.select(
        *TEST_KEY,
        ds.alias("data_structure"),
        count.alias("scenario_count"),
        ((ds != "none") & (count > 0)).alias("is_table_driven"),
        F.coalesce(name_field, F.lit("")).alias("name_field"),
        F.coalesce(expected, F.array().cast("array<string>")).alias("expected_fields"),
        F.coalesce(has_func, F.lit(False)).alias("has_function_fields"),
        F.coalesce(uses_subtest & F.col("container").isNotNull(), F.lit(False)).alias("uses_subtest"),
        F.col("stmt_ord").alias("runner_ord"), "key_var", "value_var", "scenario_type",
        F.coalesce(F.col("sc.lit_items"), F.array().cast("array<string>")).alias("scenarios"),
        "fields", tvar.alias("tester"),
        F.coalesce("source", F.lit("")).alias("scenario_source"),
        F.when(F.col("unknown_ord") > F.coalesce("stmt_ord", F.lit(0)), F.lit("unresolved"))
        .when(F.col("stmt_ord").isNotNull(), F.lit("resolved")).otherwise(F.lit("none")).alias("range_resolution"),
    )


def struct_fields(struct_text, levels: int):
    """``ARRAY<STRUCT<name, type>>`` of a normalised ``struct{...}`` text,
    declaration order; ``a, b int`` gives one entry per name."""
    body = F.regexp_extract(struct_text, r"^struct\{(.*)\}$", 1)
    decls = F.filter(F.regexp_extract_all(body, F.lit(sm.item_pattern(levels, ";")), 0), lambda x: F.trim(x) != "")

    def one(d):
        d = F.regexp_replace(F.trim(d), r"\s*\"+$", "")  # masked tag
        names = F.regexp_extract(d, r"^(\w+(?:,\w+)*) (.+)$", 1)
        typ = F.regexp_extract(d, r"^(\w+(?:,\w+)*) (.+)$", 2)
        embedded = F.regexp_extract(d, r"(\w+)$", 1)
        return F.when(names != "", F.transform(F.split(names, ","), lambda n: F.struct(
            n.alias("name"), typ.alias("type")))).otherwise(
            F.array(F.struct(embedded.alias("name"), d.alias("type"))))
    return F.when(struct_text.startswith("struct{"), F.flatten(F.transform(decls, one))).otherwise(
        F.array().cast("array<struct<name:string,type:string>>"))
