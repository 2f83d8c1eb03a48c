"""Helper-call expansion (J1, R1-R6, W6) as an iterated join.

A node is a statement of the expansion tree, addressed by ``path ARRAY<INT>``
below its test (pre-order = order by ``path``). The calls of all statements are
resolved once (J1, :func:`resolved_calls`). Level ``d`` nodes are joined with
the resolved calls of the statement that their text stands in, and the entered
callees with their body statements, which become level ``d + 1``. The loop ends
when a level is empty; every level is checkpointed in the session's checkpoint
folder so the lineage stays short and lost executors recompute nothing older
than one level.

Semantics kept from the reference:

* every call found in a statement becomes a node below it, except when the
  statement *is* that call (R5);
* a call resolves inside the package of its file (F9: folder and package clause):
  a plain name to a function, unless a local name hides it; ``x.m()`` to a method
  of the type of ``x``, not when ``x`` is an import or a type of another package;
* a callee is entered when it resolves (and, with
  ``test_only``, in a ``_test.go`` file) and its name is not on the call stack
  (R2); callees entered by earlier calls of the same statement stay on the
  stack for the later ones (sibling rule, evaluated with ``aggregate``);
* arguments that are calls become nodes before the callee's body (R3); calls
  nested deeper inside an argument expression are not visited; function
  literals passed as arguments are not entered, an immediately invoked literal
  is (R4), with the statements of its own body as children.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.operators import exprtypes as et
from testsieve.operators import statements as sm
from testsieve.session import checkpoint_dir, cut_lineage

TEST_KEY = ["project", "path", "func_line"]
# Fixed list: Go keywords and forms that look like calls but are not.
NOT_CALLEES = ["func", "if", "for", "switch", "select", "go", "defer", "return", "range", "case",
               "else", "struct", "interface", "map", "chan", "type", "var"]


LITERAL_CALLEE = "funcLit"
FUNC_KEY = ["project", "path", "func_line"]


class CallPatterns:
    """Patterns for calls whose brackets nest up to ``levels`` deep (see
    :func:`testsieve.operators.statements.deepest`)."""

    def __init__(self, levels: int):
        group = r"\(" + sm.balanced(levels, "()") + r"\)"
        index, braces = r"\[" + sm.balanced(levels) + r"\]", r"\{" + sm.balanced(levels) + r"\}"
        callee = r"[A-Za-z_]\w*(?:\s*(?:(?:" + index + "|" + braces + r")\s*)*\.\s*[A-Za-z_]\w*)*"
        # A whole call: callee expression and its balanced argument list; of a chain
        # `a().b()` the last one is the call. Scanning left to right, non-overlapping
        # matches are exactly the outermost calls.
        self.call = r"(?<![\w.])" + callee + r"\s*" + group + r"(?:\s*(?:" + index + r"\s*)*\.\s*" + callee + r"\s*" + group + r")*+"
        # owner, name and arguments of the (last) call
        self.parts = r"^(?:(.*)\.)?\s*([A-Za-z_]\w*)\s*\((" + sm.balanced(levels, "()") + r")\)$"
        self.whole = r"^\s*" + self.call + r"\s*$"
        # An immediately invoked function literal `func(...) ... { body }(...)`.
        head = r"func\s*" + group + r"[^{}()]*(?:" + group + r"[^{}()]*)?"
        body = r"\{(" + sm.balanced(levels) + r")\}\s*" + group
        self.literal = r"(?<![\w.])" + head + body.replace("(" + sm.balanced(levels) + ")", sm.balanced(levels))
        self.literal_body = "^" + head + body + "$"
        self.whole_literal = r"^\s*" + self.literal + r"\s*$"
        self.item = sm.item_pattern(levels)
        # One statement of a literal body in the flat text (`;` separates statements).
        self.statement = sm.item_pattern(levels, ";")


def statement_calls(flat, levels: int):
    """``ARRAY<STRUCT<callee, owner, is_selector, arg_calls, literal_body>>`` of the calls of one
    statement in text order; ``arg_calls`` are the arguments that are themselves calls (R3), as
    text; ``owner`` is what stands before the last dot of a selector."""
    pt = CallPatterns(levels)
    spans = F.regexp_extract_all(flat, F.lit("(?:" + pt.literal + ")|(?:" + pt.call + ")"), 0)
    none = F.array().cast("array<string>")

    def one(span):
        # a literal that is not invoked has only its header here; the calls in its body follow
        iife = span.rlike(pt.literal_body)
        owner = F.regexp_replace(F.regexp_extract(span, pt.parts, 1), r"\s+", "")
        args = F.regexp_extract_all(F.regexp_extract(span, pt.parts, 3), F.lit(pt.item), 0)
        arg_calls = F.filter(F.transform(args, lambda a: F.trim(a)), lambda a: a.rlike(pt.whole))
        body = F.regexp_extract_all(F.regexp_extract(span, pt.literal_body, 1), F.lit(pt.statement), 0)
        body = F.filter(F.transform(body, lambda b: F.trim(b)), lambda b: b != "")
        return F.struct(F.when(iife, F.lit(LITERAL_CALLEE)).otherwise(
                            F.regexp_extract(span, pt.parts, 2)).alias("callee"),
                        F.when(iife, F.lit("")).otherwise(owner).alias("owner"),
                        (~iife & (owner != "")).alias("is_selector"),
                        F.when(iife, none).otherwise(F.filter(
                            arg_calls, lambda a: ~F.regexp_extract(a, r"^\s*(\w+)", 1).isin(NOT_CALLEES)))
                        .alias("arg_calls"),
                        F.when(iife, body).otherwise(none).alias("literal_body"))
    calls = F.transform(spans, one)
    return F.filter(calls, lambda c: ~c["callee"].isin(NOT_CALLEES) | c["is_selector"])


def is_expr_stmt(flat, levels: int):
    """The whole statement is a single call expression."""
    pt = CallPatterns(levels)
    return flat.rlike(pt.whole) | flat.rlike(pt.whole_literal)


def all_calls(stmts: DataFrame, levels: int) -> DataFrame:
    """``(project, path, func_line, pkg, stmt_ord, nested, callee, owner, is_selector)`` of the
    calls that an expansion can meet in a statement: its own, those that are arguments of calls
    (R3) and those in the body of an invoked literal (R4), to any depth (``nested``)."""
    at = FUNC_KEY + ["pkg", "stmt_ord"]
    texts, nested, found = stmts.filter(F.col("flat").contains("(")).select(*at, "flat"), 0, None
    while True:
        calls = cut_lineage(texts.select(*at, F.lit(nested).alias("nested"), F.explode(statement_calls(F.col("flat"), levels)).alias("c")).select(*at, "nested", "c.*"))
        own = calls.filter(F.col("callee") != LITERAL_CALLEE).drop("arg_calls", "literal_body")
        found = own if found is None else found.unionByName(own)
        texts = calls.select(*at, F.explode(F.concat("arg_calls", "literal_body")).alias("flat"))
        if texts.isEmpty():
            return found
        nested += 1


def _unique(defs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: a name that is declared more than once is ``ambiguous``."""
    return defs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_defs"), F.min(F.struct("def_path", "def_line")).alias("d")).select(
        *keys, F.when(F.col("n_defs") == 1, F.lit("resolved")).otherwise(F.lit("ambiguous")).alias("resolution"), "d.def_path", "d.def_line")


def resolved_calls(calls: DataFrame, stmts: DataFrame, funcs: DataFrame, levels: int, types: DataFrame | None = None,
                   file_vars: DataFrame | None = None, test_only: bool = True) -> DataFrame:
    """``(project, path, func_line, stmt_ord, owner, callee, resolution, def_path, def_line)``
    of the distinct calls that name something of their package; all others have no row.

    Calls that no function or method of the package can answer drop out in the first join, so
    ``t.Log`` or calls on imports never meet under one key. ``types`` and ``file_vars`` are the
    package's declarations; without them only what functions declare is known."""
    key = FUNC_KEY + ["pkg", "stmt_ord", "owner", "callee"]
    index = cut_lineage(et.function_index(funcs, levels))
    entered = index.filter(F.col("path").endswith("_test.go")) if test_only else index
    defs = entered.select("project", "pkg", F.col("name").alias("callee"), F.col("path").alias("def_path"), F.col("func_line").cast("int").alias("def_line"), "recv")
    calls = calls.select(*key).distinct()
    plain = calls.filter("owner = ''").join(_unique(defs.filter("recv = ''").drop("recv"), ["project", "pkg", "callee"]), ["project", "pkg", "callee"])
    methods = defs.filter("recv != ''").select("project", "pkg", "callee").distinct()
    selected = calls.filter("owner != ''").join(methods, ["project", "pkg", "callee"], "left_semi")
    plain, selected = cut_lineage(plain), cut_lineage(selected)
    used = plain.select(*FUNC_KEY).unionByName(selected.select(*FUNC_KEY)).distinct()
    locals_ = cut_lineage(et.local_defs(stmts.join(used, FUNC_KEY, "left_semi"), index.join(used, FUNC_KEY, "left_semi"), levels))
    hidden = locals_.select(*FUNC_KEY, F.col("name").alias("callee"), "at")
    hidden = plain.select(*key).join(hidden, FUNC_KEY + ["callee"]).filter("at <= stmt_ord").select(*key).distinct()
    columns = FUNC_KEY + ["stmt_ord", "owner", "callee", "resolution", "def_path", "def_line"]
    out = plain.join(hidden, key, "left_anti").select(*columns)
    if selected.isEmpty():
        return out
    if types is None:
        types = funcs.select("project", "pkg", F.col("name").alias("type_name"), F.col("name").alias("underlying")).limit(0)
    if file_vars is None:
        file_vars = funcs.select("project", "pkg", "path", "name", F.col("name").alias("type"), F.col("name").alias("expr")).limit(0)
    members = et.members(types, index, levels)
    owners = selected.select(*FUNC_KEY, "pkg", "stmt_ord", "owner").distinct().join(index.select(*FUNC_KEY, "aliases"), FUNC_KEY)
    owners = owners.select(F.concat_ws("|", "path", "func_line", "stmt_ord", "owner").alias("eid"), *FUNC_KEY, "pkg", "aliases", F.col("stmt_ord").alias("at"),
                           F.lit(True).alias("within"), F.col("owner").alias("expr"), F.lit(0).alias("nth"))
    typed = et.types_of(owners, locals_, file_vars, index, types, members, levels)
    callable_ = members.filter("call").filter(F.col("def_path").endswith("_test.go")) if test_only else members.filter("call")
    nearest = callable_.join(callable_.groupBy("project", "pkg", "type_name", "member").agg(F.min("depth").alias("depth")), ["project", "pkg", "type_name", "member", "depth"])
    named = _unique(nearest.withColumnRenamed("member", "callee"), ["project", "pkg", "type_name", "callee"])
    found = (selected.withColumn("eid", F.concat_ws("|", "path", "func_line", "stmt_ord", "owner")).join(typed, "eid")
             .withColumn("type_name", F.regexp_replace("type", r"^\*", "")).join(named, ["project", "pkg", "type_name", "callee"]))
    return cut_lineage(out.unionByName(found.select(*columns)))


def _fold_stack(calls):
    """R2 sibling rule over the ordered resolved calls of one node."""
    start = F.struct(F.col("stack").alias("stack"),
                     F.array().cast("array<struct<call_ord:int,callee:string,entered:boolean,"
                                    "outer_stack:array<string>,inner_stack:array<string>,def_path:string,"
                                    "def_line:int,arg_calls:array<string>,literal_body:array<string>>>")
                     .alias("out"))

    def step(acc, c):
        # A literal is entered under a name unique to its position (never on the stack).
        is_lit = c["callee"] == LITERAL_CALLEE
        name = F.when(is_lit, F.concat(F.lit(LITERAL_CALLEE + "@"), F.array_join(F.col("node_path").cast(
            "array<string>"), "."), F.lit(":"), c["call_ord"].cast("string"))).otherwise(c["callee"])
        enter = is_lit | ((F.coalesce(c["resolution"], F.lit("")) == "resolved")
                          & ~F.array_contains(acc["stack"], name))
        new_stack = F.when(enter, F.concat(acc["stack"], F.array(name))).otherwise(acc["stack"])
        rec = F.struct(c["call_ord"].cast("int").alias("call_ord"), c["callee"].alias("callee"),
                       enter.alias("entered"), acc["stack"].alias("outer_stack"), new_stack.alias("inner_stack"),
                       c["def_path"].alias("def_path"), c["def_line"].cast("int").alias("def_line"),
                       c["arg_calls"].alias("arg_calls"), c["literal_body"].alias("literal_body"))
        return F.struct(new_stack.alias("stack"), F.concat(acc["out"], F.array(rec)).alias("out"))

    return F.aggregate(calls, start, step)["out"]


def expand(tests: DataFrame, stmts: DataFrame, funcs: DataFrame, spark: SparkSession,
           test_only: bool = True, resolved: DataFrame | None = None, levels_deep: int | None = None,
           roots: DataFrame | None = None) -> DataFrame:
    """All nodes of the expansion trees of ``tests``:
    ``(project, path, func_line, node_path, level, kind, text, flat, callee)``.

    ``tests`` holds the test keys; ``stmts`` the statement facts of every
    function (``flat`` text); ``funcs`` the declarations (``func_line``);
    ``resolved`` their calls (:func:`resolved_calls`); ``roots`` (test key and
    ``stmt_ord``) the statements to expand, all if not given.
    """
    checkpoint_dir(spark)
    # every text of the tree is a piece of some statement, so this depth holds for all levels
    if resolved is None:
        stmts, funcs = cut_lineage(stmts), cut_lineage(funcs)
    levels_deep = sm.deepest(stmts) if levels_deep is None else levels_deep
    if resolved is None:
        resolved = resolved_calls(all_calls(stmts, levels_deep), stmts, funcs, levels_deep, test_only=test_only)
    # Both sides are read once per level: keep them for the whole loop.
    defs = resolved.select("project", F.col("path").alias("ctx_path"), F.col("func_line").alias("ctx_line"), F.col("stmt_ord").alias("ctx_ord"),
                           "owner", "callee", "resolution", "def_path", "def_line").persist(StorageLevel.MEMORY_AND_DISK)
    body = stmts.select(F.col("project").alias("b_project"), F.col("path").alias("def_path"),
                        F.col("func_line").alias("def_line"), F.col("stmt_ord").alias("b_ord"),
                        F.col("text").alias("b_text"), F.col("flat").alias("b_flat")
                        ).persist(StorageLevel.MEMORY_AND_DISK)
    first = stmts.join(tests.select(*TEST_KEY), TEST_KEY, "left_semi")
    first = first if roots is None else first.join(roots, TEST_KEY + ["stmt_ord"], "left_semi")
    level0 = first.select(*TEST_KEY, F.array(F.col("stmt_ord") - 1).alias("node_path"),
                          F.array().cast("array<string>").alias("stack"), F.lit("stmt").alias("kind"), "text", "flat",
                          F.lit(None).cast("string").alias("callee"), F.col("path").alias("ctx_path"),
                          F.col("func_line").alias("ctx_line"), F.col("stmt_ord").alias("ctx_ord"))
    inner = ["stack", "ctx_path", "ctx_line", "ctx_ord"]
    frontier = _cut(level0)
    levels = [frontier.drop(*inner)]
    while not frontier.isEmpty():
        nxt = _cut(_next_level(frontier, defs, body, levels_deep))
        levels.append(nxt.drop(*inner))
        frontier = nxt.filter(F.col("kind") == "stmt")
    defs.unpersist()
    body.unpersist()
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out.withColumn("level", (F.size("node_path") - 1).cast("int"))


def _cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of one level (see :func:`testsieve.session.cut_lineage`)."""
    return cut_lineage(df)


def _next_level(frontier: DataFrame, defs: DataFrame, body: DataFrame, deep: int) -> DataFrame:
    ctx = ["ctx_path", "ctx_line", "ctx_ord"]
    node_key = TEST_KEY + ["node_path", *ctx]
    nodes = frontier.withColumn("expr_stmt", is_expr_stmt(F.col("flat"), deep)) \
        .withColumn("calls", statement_calls(F.col("flat"), deep))
    calls = nodes.select(*node_key, "stack", "expr_stmt", F.posexplode("calls").alias("call_ord", "c"))
    calls = calls.select(*node_key, "stack", "expr_stmt", "call_ord", F.col("c.callee").alias("callee"),
                         F.col("c.owner").alias("owner"), F.col("c.arg_calls").alias("arg_calls"),
                         F.col("c.literal_body").alias("literal_body"))
    resolved = calls.join(defs, ["project", *ctx, "owner", "callee"], "left")
    per_node = resolved.groupBy(*node_key, "stack", "expr_stmt").agg(
        F.array_sort(F.collect_list(F.struct("call_ord", "callee", "resolution", "def_path", "def_line",
                                             "arg_calls", "literal_body"))).alias("rc"))
    folded = per_node.select(*node_key, "expr_stmt", F.explode(_fold_stack(F.col("rc"))).alias("c"))
    c = folded.select(*node_key, "expr_stmt", "c.*")
    # A non-call statement gets one node per call, below it.
    call_nodes = c.filter(~F.col("expr_stmt")).select(
        *TEST_KEY, F.concat("node_path", F.array(F.col("call_ord"))).alias("node_path"),
        F.col("inner_stack").alias("stack"), F.lit("call").alias("kind"),
        F.concat(F.col("callee"), F.lit("(...)")).alias("text"), F.lit("").alias("flat"), "callee", *ctx)
    base_path = F.when(F.col("expr_stmt"), F.col("node_path")).otherwise(
        F.concat("node_path", F.array(F.col("call_ord"))))
    # Argument calls come first below the call, as statements of their own,
    # with the stack as it was when the call was reached.
    arg_nodes = c.select(*TEST_KEY, *ctx, base_path.alias("base_path"), "outer_stack",
                         F.posexplode("arg_calls").alias("arg_ord", "arg"))
    arg_nodes = arg_nodes.select(
        *TEST_KEY, F.concat("base_path", F.array(F.col("arg_ord"))).alias("node_path"),
        F.col("outer_stack").alias("stack"), F.lit("stmt").alias("kind"), F.col("arg").alias("text"),
        F.col("arg").alias("flat"), F.lit(None).cast("string").alias("callee"), *ctx)
    # An entered literal's own body statements become its children.
    lit_children = (c.filter(F.col("entered") & (F.col("callee") == LITERAL_CALLEE))
                    .select(*TEST_KEY, *ctx, base_path.alias("base_path"), "inner_stack", "callee",
                            F.posexplode("literal_body").alias("b_ord", "b")))
    lit_children = lit_children.select(
        *TEST_KEY, F.concat("base_path", F.array(F.col("b_ord"))).alias("node_path"),
        F.col("inner_stack").alias("stack"), F.lit("stmt").alias("kind"), F.col("b").alias("text"),
        F.col("b").alias("flat"), "callee", *ctx)
    entered = c.filter(F.col("entered") & (F.col("callee") != LITERAL_CALLEE)).select(
        *TEST_KEY, base_path.alias("base_path"), "inner_stack", "callee", "def_path", "def_line",
        F.size("arg_calls").alias("n_args"))
    children = entered.join(body, (entered["project"] == body["b_project"])
                            & (entered["def_path"] == body["def_path"])
                            & (entered["def_line"] == body["def_line"]))
    children = children.select(
        *TEST_KEY, F.concat("base_path", F.array(F.col("b_ord") - 1 + F.col("n_args"))).alias("node_path"),
        F.col("inner_stack").alias("stack"), F.lit("stmt").alias("kind"),
        F.col("b_text").alias("text"), F.col("b_flat").alias("flat"), "callee",
        entered["def_path"].alias("ctx_path"), entered["def_line"].alias("ctx_line"), F.col("b_ord").alias("ctx_ord"))
    return call_nodes.unionByName(arg_nodes).unionByName(lit_children).unionByName(children)


def expansion_summary(nodes: DataFrame) -> DataFrame:
    """Per test: node count and deepest level."""
    return nodes.groupBy(*TEST_KEY).agg(F.count(F.lit(1)).alias("n_nodes"),
                                        F.max("level").alias("max_level"))


def expansion_json(nodes: DataFrame) -> DataFrame:
    """The nested ``[{"stmt": ..., "children": [...]}]`` text of each tree,
    assembled bottom-up one level at a time (children grouped by parent path);
    ``children`` is omitted when empty."""
    def node_json(text_col, children_col):
        base = F.to_json(F.struct(F.regexp_replace(text_col, r"^\s+|\s+$", "").alias("stmt")))
        with_children = F.concat(F.substring(base, F.lit(1), F.length(base) - 1),
                                 F.lit(',"children":['), F.array_join(children_col, ","), F.lit("]}"))
        return F.when(F.size(children_col) > 0, with_children).otherwise(base)

    max_level = nodes.agg(F.max("level")).first()[0]
    if max_level is None:
        return nodes.select(*TEST_KEY).limit(0).withColumn("json", F.lit(""))
    done = None
    for d in range(max_level, -1, -1):
        lv = nodes.filter(F.col("level") == d).select(*TEST_KEY, "node_path", "text")
        if done is None:
            lv = lv.withColumn("kids", F.array().cast("array<string>"))
        else:
            lv = lv.join(done, TEST_KEY + ["node_path"], "left").withColumn(
                "kids", F.coalesce("kids", F.array().cast("array<string>")))
        lv = lv.select(*TEST_KEY, "node_path", node_json(F.col("text"), F.col("kids")).alias("j"))
        if d == 0:
            return lv.groupBy(*TEST_KEY).agg(F.concat(F.lit("["), F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("node_path", "j"))), lambda x: x["j"]), ","),
                F.lit("]")).alias("json"))
        parent = F.slice("node_path", 1, F.size("node_path") - 1)
        done = (lv.groupBy(*TEST_KEY, parent.alias("node_path"))
                .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("node_path").alias("p"), "j"))),
                                 lambda x: x["j"]).alias("kids")))


def expansion_rows(trees: DataFrame, keys: list[str], tree: str = "ParsedStatements") -> DataFrame:
    """The nodes of trees read back from documents: ``(keys, node_path, level, text)``.
    ``tree`` is a VARIANT holding ``[{"stmt": ..., "children": [...]}]`` of any depth; each round
    takes apart the children of one level."""
    kids = trees.select(*keys, F.array().cast("array<int>").alias("node_path"), F.variant_get(tree, "$", "array<variant>").alias("kids"))
    out = None
    while True:
        nodes = kids.select(*keys, "node_path", F.posexplode("kids").alias("pos", "v"))
        nodes = cut_lineage(nodes.select(*keys, F.concat("node_path", F.array("pos")).alias("node_path"),
                                         F.variant_get("v", "$.stmt", "string").alias("text"), F.try_variant_get("v", "$.children", "array<variant>").alias("kids")))
        found = nodes.select(*keys, "node_path", (F.size("node_path") - 1).cast("int").alias("level"), "text")
        out = found if out is None else out.unionByName(found)
        kids = nodes.filter("kids is not null").select(*keys, "node_path", "kids")
        if kids.isEmpty():
            return out
