"""Types of Go expressions, followed through assignments, results, fields and methods.

An expression is a base and steps: ``a.b().c[0]`` is the variable ``a``, the field or method
``b``, and so on. Types are the text that declarations write. Facts:

* ``function_index``: every function with its receiver, parameters and results;
* ``local_defs``: every name that a function declares (receiver, parameters, results, ``:=``,
  ``var``, range clauses) with a declared type or the expression it is set to;
* ``members``: fields and method results of the named types of a package, those of embedded
  types among them.

``types_of`` is a semi-naive fixpoint: an expression waits on the declaration that its base
names; each round takes one step of the expressions whose type is known and wakes those that
wait on one that has just been finished. Nothing is computed twice, and the rounds end when
one wakes and moves nothing.

Limits: a name declared in an inner block counts for the rest of its top-level statement and
those behind it; generics and values of function type are not followed. What is not found has
no row; a type of another package is ``EXTERNAL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testsieve.operators import statements as sm
from testsieve.session import cut_lineage

FUNC_KEY = ["project", "path", "func_line"]
EXTERNAL = "~"
#: Brackets of a header nest at least this deep in the patterns, whatever the statements hold.
HEADER_LEVELS = 6


def normalize_type(t: Column) -> Column:
    """Type text without layout: no blanks around punctuation, fields ``;``-separated; the
    blank between a field's name and its type stays."""
    s = F.regexp_replace(t, r"\s+", " ")
    s = F.regexp_replace(s, r"\s*([\]{});,.])\s*", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"([\[(*])\s+", "$1"), r"(?<!\w)\s+([\[(*])", "$1")
    s = F.regexp_replace(s, r";+\}", "}")
    s = F.regexp_replace(s, r"\{;+", "{")
    return F.trim(s)


def _items(text: Column, levels: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(sm.item_pattern(levels)), 0)
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def _named_types(items: Column) -> Column:
    """``ARRAY<STRUCT<name, type>>`` of the fields of a parameter or result list; a name
    without a type has that of the next field."""
    pattern = r"^(\w+)\s+((?!\s).+)$"
    words = r"^(?:func|chan|struct|interface|map)\b"
    typed = lambda x: x.rlike(pattern) & ~x.rlike(words)
    named = F.exists(items, typed)

    def one(x, i):
        own = F.filter(F.slice(items, i + 1, F.size(items)), typed)
        t = F.regexp_extract(F.try_element_at(own, F.lit(1)), pattern, 2)
        return F.struct(F.when(named, F.regexp_extract(x, r"^(\w+)", 1)).otherwise(F.lit("")).alias("name"),
                        F.regexp_replace(normalize_type(F.when(named, t).otherwise(x)), r"^\.{3}", "[]").alias("type"))
    return F.transform(items, one)


def function_index(funcs: DataFrame, levels: int) -> DataFrame:
    """``(project, pkg, path, func_line, aliases, name, recv_name, recv, params, results)``;
    ``recv`` is the base type of a method's receiver, empty for functions."""
    levels = max(levels, HEADER_LEVELS)
    group = r"\(" + sm.balanced(levels, "()") + r"\)"
    head = r"^\s*func\s*(" + group + r")?\s*\w+\s*(?:\[[^\]]*\])?\s*(" + group + r")"
    h = F.col("header")
    inner = lambda c: F.regexp_extract(c, r"^\((.*)\)$", 1)
    recv = F.regexp_extract(h, head, 1)
    after = F.regexp_replace(h, head, "")
    # the header of a function on one line holds its body
    results = F.trim(F.when(after.rlike(r"\{\s*$"), F.regexp_extract(after, r"^\s*(.*?)\s*\{\s*$", 1))
                     .otherwise(F.regexp_extract(after, r"^\s*(.*?)\s*\{" + sm.balanced(levels, "{}") + r"\}\s*$", 1)))
    whole = F.when(results.rlike("^" + group + "$"), inner(results)).otherwise(results)
    f = funcs.select(*FUNC_KEY, "pkg", "aliases", "name", recv.alias("r"), F.regexp_extract(h, head, 2).alias("p"), whole.alias("w"))
    return f.select(
        *FUNC_KEY, "pkg", "aliases", "name", F.regexp_extract("r", r"^\(\s*(\w+)\s+\S", 1).alias("recv_name"),
        F.regexp_extract("r", r"(\w+)\s*(?:\[[^\]]*\])?\s*\)$", 1).alias("recv"),
        _named_types(_items(inner(F.col("p")), levels)).alias("params"), _named_types(_items(F.col("w"), levels)).alias("results"))


def local_defs(stmts: DataFrame, index: DataFrame, levels: int) -> DataFrame:
    """Names that functions declare: ``(project, path, func_line, pkg, aliases, at, name, type,
    expr, nth, def_id)``. ``type`` is declared, or null and ``expr`` holds the value: the
    ``nth`` result, or key and element of a range (-1, -2); ``at`` is the statement (0: header)."""
    own = index.select(*FUNC_KEY, "pkg", "aliases", F.explode(F.concat(
        F.when(F.col("recv_name") != "", F.array(F.struct(F.col("recv_name").alias("name"), F.col("recv").alias("type")))).otherwise(
            F.array().cast("array<struct<name:string,type:string>>")), "params", "results")).alias("d")).filter("d.name not in ('', '_')")
    own = own.select(*FUNC_KEY, "pkg", "aliases", F.lit(0).alias("at"), F.col("d.name").alias("name"), F.col("d.type").alias("type"),
                     F.lit(None).cast("string").alias("expr"), F.lit(0).alias("nth"), F.lit(0).alias("part"))
    keys = index.select(*FUNC_KEY, "pkg", "aliases")
    s = stmts.select(*FUNC_KEY, F.col("stmt_ord").alias("at"), "flat").join(keys, FUNC_KEY)
    piece = sm.item_pattern(levels, ";")
    short = r"(?<![\w.\])}])(?:\w+(?:\s*,\s*\w+)*)\s*:=\s*" + piece
    spec = r"(?:(?<=^)|(?<=[;{]\s)|(?<=[;{]))var\s+\w" + piece
    found = s.select(*FUNC_KEY, "pkg", "aliases", "at", F.posexplode(F.concat(
        F.regexp_extract_all("flat", F.lit(short), 0), F.regexp_extract_all("flat", F.lit(spec), 0))).alias("part", "d"))
    is_var = F.col("d").rlike(r"^var\b")
    names = F.when(is_var, F.regexp_extract("d", sm.VAR_PATTERN, 1)).otherwise(F.regexp_extract("d", r"^(\w+(?:\s*,\s*\w+)*)\s*:=", 1))
    declared = F.when(is_var, normalize_type(F.regexp_extract("d", sm.VAR_PATTERN, 2))).otherwise(F.lit(""))
    value = F.when(is_var, F.regexp_extract("d", sm.VAR_PATTERN, 3)).otherwise(F.regexp_extract("d", r"^\w+(?:\s*,\s*\w+)*\s*:=\s*(.*)$", 1))
    ranged = F.regexp_extract("value", r"^range\s+(.*?)\s*\{" + sm.balanced(levels, "{}") + r"\}\s*$", 1)
    found = found.select(*FUNC_KEY, "pkg", "aliases", "at", "part", F.split(names, r"\s*,\s*").alias("names"), declared.alias("declared"), F.trim(value).alias("value"))
    found = found.withColumn("ranged", F.when(F.col("value").startswith("range "), ranged).otherwise(F.lit(""))).withColumn("values", _items(F.col("value"), levels))
    found = found.select(*FUNC_KEY, "pkg", "aliases", "at", "part", "declared", "value", "ranged", "values", F.size("names").alias("m"), F.posexplode("names").alias("i", "name"))
    many = F.size("values") == F.col("m")
    found = found.filter("name not in ('', '_')").select(
        *FUNC_KEY, "pkg", "aliases", "at", "name", F.when(F.col("declared") != "", F.col("declared")).alias("type"),
        F.when(F.col("declared") == "", F.when(F.col("ranged") != "", F.col("ranged")).when(many, F.get("values", F.col("i"))).otherwise(F.col("value"))).alias("expr"),
        F.when(F.col("ranged") != "", -1 - F.col("i")).when(many, F.lit(0)).otherwise(F.col("i")).cast("int").alias("nth"), "part")
    both = own.unionByName(found.select(*own.columns))
    return both.withColumn("def_id", F.concat_ws("|", "path", "func_line", "at", "part", "name")).drop("part")


def members(types: DataFrame, index: DataFrame, levels: int) -> DataFrame:
    """``(project, pkg, type_name, member, call, member_type, def_path, def_line, depth)``: fields
    and methods of named types; those of embedded types at a greater ``depth`` where the type
    itself has none of that name."""
    from testsieve.operators.scenarios import struct_fields
    fields = types.filter(F.col("underlying").startswith("struct{")).select(
        "project", "pkg", "type_name", F.explode(struct_fields(F.col("underlying"), levels)).alias("f")).select(
        "project", "pkg", "type_name", F.col("f.name").alias("member"), F.lit(False).alias("call"), F.col("f.type").alias("member_type"),
        F.lit(None).cast("string").alias("def_path"), F.lit(None).cast("int").alias("def_line"), F.lit(0).alias("depth"))
    methods = index.filter("recv != ''").select(
        "project", "pkg", F.col("recv").alias("type_name"), F.col("name").alias("member"), F.lit(True).alias("call"),
        F.get("results", F.lit(0))["type"].alias("member_type"), F.col("path").alias("def_path"), F.col("func_line").cast("int").alias("def_line"), F.lit(0).alias("depth"))
    all_ = cut_lineage(fields.unionByName(methods))
    embedded = all_.filter(~F.col("call") & (F.regexp_replace("member_type", r"^\*", "") == F.col("member"))).select(
        "project", "pkg", F.col("type_name").alias("outer"), F.col("member").alias("type_name")).distinct()
    new = all_
    while not embedded.isEmpty():
        up = (new.join(embedded, ["project", "pkg", "type_name"])
              .select("project", "pkg", F.col("outer").alias("type_name"), "member", "call", "member_type", "def_path", "def_line", (F.col("depth") + 1).alias("depth"))
              .join(all_.select("project", "pkg", "type_name", "member"), ["project", "pkg", "type_name", "member"], "left_anti"))
        new = cut_lineage(up.dropDuplicates(["project", "pkg", "type_name", "member", "def_path", "def_line"]))
        if new.isEmpty():
            break
        all_ = cut_lineage(all_.unionByName(new))
    return all_


def parsed(expr: Column, levels: int) -> tuple[Column, Column]:
    """Type of an expression that states it (literal, ``make``, ``new``, conversion to a list or
    map), and otherwise its steps: ``n:`` name, ``c:`` call, ``i`` element, ``s`` part of a list."""
    group, index = r"\(" + sm.balanced(levels) + r"\)", r"\[" + sm.balanced(levels) + r"\]"
    braces = r"\{" + sm.balanced(levels) + r"\}"
    first = r"^append\s*\(\s*(" + sm.item_pattern(levels) + r").*\)$"
    e = F.trim(F.regexp_replace(expr, r"^[&*\s]+", ""))
    for _ in range(2):
        e = F.trim(F.when(e.rlike(first), F.regexp_extract(e, first, 1)).otherwise(e))
    made = F.regexp_extract(e, r"^(?:make|new)\s*\(\s*(" + sm.item_pattern(levels) + r").*\)$", 1)
    literal = F.regexp_extract(e, sm.literal_pattern(levels), 1)
    converted = F.regexp_extract(e, r"^((?:\[\d*\]|map\[[^\]]+\])+\*?[\w.]+)\s*" + group + "$", 1)
    stated = F.when(literal != "", literal).when(made != "", made).when(converted != "", converted)
    whole = r"^[A-Za-z_]\w*(?:\s*" + braces + r")?(?:\s*\.\s*[A-Za-z_]\w*|\s*" + group + r"|\s*" + index + r")*$"
    tokens = F.regexp_extract_all(e, F.lit(r"[A-Za-z_]\w*|" + group + "|" + index + "|" + braces), 0)

    def one(t, i):
        follows = F.coalesce(F.get(tokens, i + 1), F.lit(""))
        return (F.when(t.startswith("("), F.lit("")).when(t.startswith("{"), F.lit(""))
                .when(t.startswith("["), F.when(t.rlike(r"^\[[^{}()\[\]]*:"), F.lit("s")).otherwise(F.lit("i")))
                .when(follows.startswith("("), F.concat(F.lit("c:"), t)).when(follows.startswith("{"), F.concat(F.lit("t:"), t))
                .otherwise(F.concat(F.lit("n:"), t)))
    steps = F.filter(F.transform(tokens, one), lambda x: x != "")
    return normalize_type(stated), F.when(stated.isNull() & e.rlike(whole), steps)


def types_of(exprs: DataFrame, defs: DataFrame, file_vars: DataFrame, index: DataFrame, types: DataFrame, members_: DataFrame, levels: int) -> DataFrame:
    """``(eid, type)`` of the expressions whose type is found.

    ``exprs``: eid, project, path, func_line, pkg, aliases, at, within (does a declaration in the
    same statement count), expr, nth. ``file_vars``: project, pkg, path, name, type, expr."""
    columns = ["eid", "project", "path", "func_line", "pkg", "aliases", "at", "within", "expr", "nth"]
    used = exprs.select(*FUNC_KEY).distinct()
    local = defs.join(used, FUNC_KEY, "left_semi")
    packages = exprs.select("project", "pkg").distinct()
    outer = file_vars.join(packages, ["project", "pkg"], "left_semi").withColumn("def_id", F.concat_ws("|", "path", F.lit("var"), "name"))
    of_defs = local.filter("expr is not null").select(F.col("def_id").alias("eid"), *FUNC_KEY, "pkg", "aliases", "at", F.lit(False).alias("within"), "expr", "nth")
    of_vars = outer.filter("type is null and expr is not null").select(
        F.col("def_id").alias("eid"), "project", "path", F.lit(-1).alias("func_line"), "pkg", F.array().cast("array<string>").alias("aliases"),
        F.lit(0).alias("at"), F.lit(False).alias("within"), "expr", F.lit(0).alias("nth"))
    rows = exprs.select(*columns).unionByName(of_defs.select(*columns)).unionByName(of_vars.select(*columns))
    stated, steps = parsed(F.col("expr"), levels)
    rows = rows.withColumn("stated", stated).withColumn("steps", F.when(F.col("stated").isNull(), steps))
    # the last step of a range: its key or element
    rows = rows.withColumn("steps", F.when(F.col("nth") < 0, F.concat(F.coalesce("steps", F.array().cast("array<string>")), F.array(
        F.when(F.col("nth") == -1, F.lit("k")).otherwise(F.lit("i"))))).otherwise(F.col("steps")))
    base = F.when(F.col("stated").isNull(), F.get("steps", F.lit(0)))
    rows = cut_lineage(rows.select("eid", *FUNC_KEY, "pkg", "aliases", "at", "within", "nth", "stated", "steps", F.substring(base, 1, 2).alias("kind"),
                                   F.when(base.contains(":"), F.expr("substring(get(steps, 0), 3)")).alias("name")).filter(
        F.col("stated").isNotNull() | F.col("name").isNotNull()))
    # what the base names: the nearest declaration before, a variable of the package, a function
    named = rows.filter("stated is null")
    near = (named.select("eid", *FUNC_KEY, "name", "at", "within").join(local.select(*FUNC_KEY, "name", F.col("at").alias("d_at"), "def_id", F.col("type").alias("d_type")), FUNC_KEY + ["name"])
            .filter((F.col("d_at") < F.col("at")) | (F.col("within") & (F.col("d_at") == F.col("at"))))
            .groupBy("eid").agg(F.max_by(F.struct("def_id", "d_type"), F.struct("d_at", "def_id")).alias("d")))
    one_var = outer.groupBy("project", "pkg", "name").agg(F.count("*").alias("m"), F.first(F.struct("def_id", "type")).alias("v")).filter("m = 1").drop("m")
    one_func = index.filter("recv = ''").groupBy("project", "pkg", "name").agg(F.count("*").alias("m"), F.first("results").alias("results")).filter("m = 1").drop("m")
    known = (rows.join(near, "eid", "left").join(one_var, ["project", "pkg", "name"], "left").join(one_func, ["project", "pkg", "name"], "left")
             .join(types.select("project", "pkg", F.col("type_name").alias("name"), F.lit(True).alias("is_type")), ["project", "pkg", "name"], "left"))
    call, rest = F.col("kind") == "c:", F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0)))
    last = F.size("steps") == 1
    result = F.get("results", F.when(last & (F.col("nth") > 0), F.col("nth")).otherwise(F.lit(0)))["type"]
    found = (F.when(F.col("stated").isNotNull(), F.col("stated")).when(F.col("d").isNotNull() & ~call, F.col("d.d_type"))
             .when(F.col("d").isNotNull(), F.lit(None))
             .when(F.array_contains("aliases", F.col("name")) & ~call, F.lit(EXTERNAL))
             .when(call & F.col("results").isNotNull(), result).when((call | (F.col("kind") == "t:")) & F.col("is_type"), F.col("name"))
             .when(~call, F.coalesce("v.type", F.when(F.col("is_type") & F.col("v.def_id").isNull(), F.col("name")))))
    waits = F.when(F.col("stated").isNull() & ~call, F.when(F.col("d").isNotNull(), F.when(F.col("d.d_type").isNull(), F.col("d.def_id")))
                   .when(~F.array_contains("aliases", F.col("name")) & F.col("v.type").isNull(), F.col("v.def_id")))
    left = F.when(F.col("stated").isNotNull(), F.when(F.col("nth") < 0, F.col("steps")).otherwise(F.array().cast("array<string>"))).otherwise(rest)
    state = cut_lineage(known.select("eid", "project", "pkg", "nth", found.alias("type"), waits.alias("waits"), left.alias("steps"))
                        .filter("type is not null or waits is not null"))
    ready, waiting, done = state.filter("type is not null").drop("waits"), state.filter("type is null").drop("type"), None
    looked = members_.select("project", "pkg", F.col("type_name").alias("m_type"), F.col("member").alias("m_name"), F.col("call").alias("m_call"), "member_type", "depth")
    looked = looked.groupBy("project", "pkg", "m_type", "m_name", "m_call").agg(F.min_by("member_type", "depth").alias("member_type"))
    under = types.select("project", "pkg", F.col("type_name").alias("m_type"), "underlying")
    while not ready.isEmpty():
        finished = ready.filter(F.size("steps") == 0).select("eid", "type")
        done = finished if done is None else done.unionByName(finished)
        woken = waiting.join(finished.withColumnRenamed("eid", "waits"), "waits").select("eid", "project", "pkg", "nth", "type", "steps")
        step = F.get("steps", F.lit(0))
        moving = ready.filter(F.size("steps") > 0).select(
            "eid", "project", "pkg", "nth", "type", "steps", step.alias("step"), F.regexp_replace("type", r"^\*", "").alias("m_type"),
            F.expr("substring(get(steps, 0), 3)").alias("m_name"), step.startswith("c:").alias("m_call"))
        moving = moving.join(looked, ["project", "pkg", "m_type", "m_name", "m_call"], "left").join(under, ["project", "pkg", "m_type"], "left")
        whole = F.coalesce("underlying", "m_type")
        inline = F.get(F.filter(_struct_fields(whole, levels), lambda f: f["name"] == F.col("m_name")), F.lit(0))["type"]
        other = (F.col("type") == EXTERNAL) | F.col("m_type").rlike(r"^\w+\.\w+$")
        following = (F.when(other, F.lit(EXTERNAL)).when(F.col("step") == "s", F.col("type"))
                     .when(F.col("step") == "i", element(whole)).when(F.col("step") == "k", key(whole))
                     .otherwise(F.coalesce("member_type", inline)))
        moved = moving.select("eid", "project", "pkg", "nth", following.alias("type"), F.slice("steps", 2, F.size("steps")).alias("steps")).filter("type is not null")
        ready = cut_lineage(moved.unionByName(woken))
    if done is None:
        return rows.select("eid", F.lit("").alias("type")).limit(0)
    return done


def _struct_fields(t: Column, levels: int) -> Column:
    from testsieve.operators.scenarios import struct_fields
    return struct_fields(t, levels)


LIST_PREFIX = r"^(?:\[\d*\]|\[\.\.\.\])"


def element(t: Column) -> Column:
    """Element type of a list, value type of a map."""
    return (F.when(t.rlike(LIST_PREFIX), F.regexp_replace(t, LIST_PREFIX, ""))
            .when(t.rlike(r"^map\["), F.regexp_replace(t, r"^map\[[^\]]*\]", "")))


def key(t: Column) -> Column:
    return F.when(t.rlike(LIST_PREFIX), F.lit("int")).when(t.rlike(r"^map\["), F.regexp_extract(t, r"^map\[([^\]]*)\]", 1))
