"""Subtest refactoring at corpus scale.

Nothing is edited in place: the rewritten functions form a new table that
can be written next to the corpus or patched into it with :func:`apply_patches`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testsieve.functions import classify as cl
from testsieve.operators import statements as sm

TEST_KEY = ["project", "path", "func_line"]

# Tester parameter types accepted for the rewrite (fixed values).
TESTER_TYPES = [r"\*\s*testing\s*\.\s*T", r"\*\s*require\s*\.\s*TestingT"]
MAP_KEY = "map key"
DEFAULT_KEY_NAME = "testName"


def refactor_tester(header):
    """Tester parameter for the rewrite: ``*testing.T`` or ``*require.TestingT``."""
    params = F.regexp_extract(header, sm.PARAMS_PATTERN, 1)
    names = [F.regexp_extract(params, r"(?:^|,)\s*(\w+)(?:\s*,\s*\w+)*\s+" + t + r"\s*(?:,|$)", 1)
             for t in TESTER_TYPES]
    first = F.when(names[0] != "", names[0]).when(names[1] != "", names[1])
    return first


def plan_refactoring(analysed: DataFrame, strategy: str = "subtest") -> DataFrame:
    """Per test ``strategy, generation_status, name_expr, t_var``."""
    strat = F.lit(cl.strategy_named(strategy))
    candidate = (F.coalesce(F.col("is_table_driven"), F.lit(False))
                 & ~F.coalesce(F.col("uses_subtest"), F.lit(False)))
    first_string = F.try_element_at(F.transform(F.filter(F.coalesce("fields", F.array().cast(
        "array<struct<name:string,type:string>>")), lambda f: f["type"] == "string"), lambda f: f["name"]),
        F.lit(1))
    name = F.when(F.col("name_field") != "", F.col("name_field")).otherwise(first_string)
    tvar = refactor_tester(F.col("header"))
    key = F.col("key_var")
    value = F.col("value_var")
    status = (F.when((strat == "none") | ~candidate, F.lit("none"))
              .when(key.isNull() | value.isNull(), F.lit("fail"))
              .when(name.isNull() | (name == ""), F.lit("badFields"))
              .when((name != MAP_KEY) & (value == "_"), F.lit("fail"))
              .when(tvar.isNull(), F.lit("noTester"))
              .otherwise(F.lit("success")))
    new_key = F.when((name == MAP_KEY) & (key == "_"), F.lit(DEFAULT_KEY_NAME)).otherwise(key)
    name_expr = F.when(name == MAP_KEY, new_key).otherwise(F.concat(value, F.lit("."), name))
    return analysed.select(
        *TEST_KEY, "name", strat.alias("strategy"), status.alias("generation_status"),
        F.when(status == "success", name_expr).alias("name_expr"),
        F.when(status == "success", new_key).alias("new_key"), tvar.alias("t_var"), "runner_ord",
        "end_line")


# Pieces of masked code that the rewrite has to tell apart: words, brackets, the rest.
CODE_PIECES = r"(?s)(\w+|[{}()\[\];\n]|[^\w{}()\[\];\n]+)"
# The same for what looks at brackets only.
BRACKET_PIECES = r"(?s)([{}()\[\]]|[^{}()\[\]]+)"


def _places(masked, pieces=CODE_PIECES):
    """``ARRAY<STRUCT<piece, at, open>>`` of masked code: text, offset and nesting before the piece."""
    pieces = F.regexp_extract_all(masked, F.lit(pieces), 1)
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("open"))

    def moved(acc, p):
        step = F.when(p.rlike(r"^[{(\[]$"), 1).when(p.rlike(r"^[})\]]$"), -1).otherwise(0)
        return F.struct((acc["at"] + F.length(p)).alias("at"), (acc["open"] + step).alias("open"))
    return pieces, start, moved


def body_span(masked):
    """``STRUCT<first, last>``: offsets of the braces around the body of a loop statement: the
    last brace that opens at nesting 0, so types and literals in the clause come before it."""
    pieces, start, moved = _places(masked, BRACKET_PIECES)
    init = F.struct(start["at"].alias("at"), start["open"].alias("open"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(acc, p):
        m = moved(acc, p)
        return F.struct(m["at"].alias("at"), m["open"].alias("open"),
                        F.when((p == "{") & (acc["open"] == 0), acc["at"]).otherwise(acc["first"]).alias("first"),
                        F.when((p == "}") & (m["open"] == 0), acc["at"]).otherwise(acc["last"]).alias("last"))
    return F.aggregate(pieces, init, step, lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last")))


def continue_to_return(text, masked):
    """An unlabelled ``continue`` of this body becomes ``return``; those of inner ``for``
    loops, labelled ones and the word inside literals or comments stay. ``masked`` has the
    offsets of ``text``; each token is replaced at its own place."""
    pieces, start, moved = _places(masked)
    # `loop`: nesting of the outermost inner loop that the piece stands in (-1: none);
    # `pending`: nesting of a `for` clause whose body has not begun (-1: none).
    init = F.struct(start["at"].alias("at"), start["open"].alias("open"), F.lit(-1).alias("loop"), F.lit(-1).alias("pending"),
                    F.lit(-1).alias("cont"), F.array().cast("array<int>").alias("hits"))

    def step(acc, p):
        m = moved(acc, p)
        inside, blank = acc["loop"] >= 0, ~p.rlike(r"\S") & (p != "\n")
        # a brace that closes at the clause's nesting may have been that of a type or a
        # literal: only if another one opens right behind it does the clause go on
        closed = -acc["pending"] - 2
        pending = (F.when(closed < 0, acc["pending"]).when(blank, acc["pending"])
                   .when((p == "{") & (acc["open"] == closed), closed).otherwise(F.lit(-1)))
        pending = F.when((p == "for") & ~inside & (pending < 0), acc["open"]).when(
            (p == "\n") & ~inside & (acc["open"] == pending), F.lit(-1)).otherwise(pending)
        begins = (p == "{") & ~inside & (pending >= 0) & (acc["open"] == pending)
        closes = (p == "}") & inside & (m["open"] == acc["loop"])
        loop = F.when(begins, acc["open"]).when(closes, F.lit(-1)).otherwise(acc["loop"])
        pending = F.when(closes, -m["open"] - 2).otherwise(pending)
        # a `continue` counts unless a word (its label) follows on the same line
        settled = (acc["cont"] >= 0) & ~blank
        hits = F.when(settled & ~p.rlike(r"^[A-Za-z_]"), F.concat(acc["hits"], F.array(acc["cont"]))).otherwise(acc["hits"])
        cont = F.when((p == "continue") & ~inside, acc["at"]).when(blank, acc["cont"]).otherwise(F.lit(-1))
        return F.struct(m["at"].alias("at"), m["open"].alias("open"), loop.cast("int").alias("loop"), pending.cast("int").alias("pending"),
                        cont.cast("int").alias("cont"), hits.alias("hits"))

    size = len("continue")

    def finish(done):
        hits = F.when(done["cont"] >= 0, F.concat(done["hits"], F.array(done["cont"]))).otherwise(done["hits"])
        cuts = F.concat(F.array(F.lit(1 - size)), hits, F.array(F.length(text) + 1))
        return F.array_join(F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), lambda c, i: F.substring(
            text, c + size, F.get(cuts, i + 1) - c - size)), "return")

    # most bodies have no such word: nothing in them is looked at piece by piece
    return F.when(masked.contains("continue"), F.aggregate(pieces, init, step, finish)).otherwise(text)


def rewrite_runner(df: DataFrame) -> DataFrame:
    """Add ``new_runner``, the loop ``text`` with its body wrapped in
    ``<t>.Run(<name>, func(<t> *testing.T) {...})``. The body is what stands between the
    braces of :func:`body_span`, on one line or on many. Each step is a column of its own, so
    the folds over the code run once for each statement."""
    df = df.withColumn("span", body_span(F.col("masked")))
    first, last = F.col("span.first"), F.col("span.last")
    inside = last - first - 1
    df = df.withColumn("inner", continue_to_return(F.substring(F.col("text"), first + 1, inside), F.substring(F.col("masked"), first + 1, inside)))
    df = df.withColumn("head", F.substring(F.col("text"), F.lit(1), first)).withColumn("indent", F.regexp_extract("head", r"^([ \t]*)", 1))
    df = df.withColumn("body", F.split("inner", "\n", -1))
    # the rest of the brace's line is the first line of the body, if it holds anything
    begin = F.get("body", F.lit(0))
    more = F.slice("body", F.lit(2), F.greatest(F.size("body") - 1, F.lit(0)))
    df = df.withColumn("body", F.when(begin.rlike(r"\S"), F.concat(
        F.array(F.concat("indent", F.lit("\t"), F.trim(begin))), more)).otherwise(more))
    df = df.withColumn("body", F.when((F.size("body") > 0) & ~F.element_at("body", -1).rlike(r"\S"),
                                      F.slice("body", F.lit(1), F.size("body") - 1)).otherwise(F.col("body")))
    head = F.when(F.col("new_key").isNotNull(), F.concat(
        F.regexp_extract("head", r"^(\s*for\s+)", 1), "new_key", F.regexp_replace("head", r"^\s*for\s+\w+", ""))).otherwise(F.col("head"))
    run_open = F.concat("indent", F.lit("\t"), "t_var", F.lit(".Run("), "name_expr", F.lit(", func("), "t_var", F.lit(" *testing.T) {"))
    tail = F.concat("indent", F.substring(F.col("text"), last, F.length("text")))
    body = F.transform("body", lambda x: F.concat(F.lit("\t"), x))
    whole = F.array_join(F.concat(F.array(head, run_open), body, F.array(F.concat("indent", F.lit("\t})")), tail)), "\n")
    return df.withColumn("new_runner", whole).drop("span", "inner", "head", "indent", "body")


def rewrite_tests(plan: DataFrame, stmts: DataFrame, lines: DataFrame) -> DataFrame:
    """Refactored function text of every ``success`` test (one new row each):
    ``(project, path, func_line, name, refactored)``."""
    ok = plan.filter(F.col("generation_status") == "success")
    runner = stmts.select(*TEST_KEY, F.col("stmt_ord").alias("runner_ord"), "stmt_line",
                          F.col("end_line").alias("stmt_end"), "text", "masked")
    r = ok.join(runner, TEST_KEY + ["runner_ord"])
    r = rewrite_runner(r)
    fl = (lines.select("project", "path", F.col("decl_line").alias("func_line"), "line_no", "text")
          .join(ok.select(*TEST_KEY).hint("shuffle_hash"), TEST_KEY, "left_semi")
          .groupBy(*TEST_KEY)
          .agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("fl")))
    j = r.join(fl, TEST_KEY)
    before = F.transform(F.filter("fl", lambda x: x["line_no"] < F.col("stmt_line")), lambda x: x["text"])
    # Lines after the function's closing brace (gap before the next declaration) are not part of it.
    after = F.transform(F.filter("fl", lambda x: (x["line_no"] > F.col("stmt_end"))
                                 & (x["line_no"] <= F.col("end_line"))), lambda x: x["text"])
    body = F.array_join(F.concat(before, F.array(F.col("new_runner")), after), "\n")
    # a function on one line: its runner is a piece of that line
    body = F.when(F.col("stmt_line") == F.col("func_line"), F.replace(
        F.element_at("fl", 1)["text"], F.col("text"), F.col("new_runner"))).otherwise(body)
    return j.select(*TEST_KEY, "name", body.alias("refactored"), "end_line", "runner_ord",
                    F.col("masked").alias("runner_masked"))


def apply_patches(funcs_text: DataFrame, patches: DataFrame) -> DataFrame:
    """Replace functions by their patched text where one exists (left join
    on the function key + ``coalesce``); the output is a new table."""
    return (funcs_text.join(patches.select(*TEST_KEY, "refactored"), TEST_KEY, "left")
            .withColumn("patched", F.col("refactored").isNotNull())
            .withColumn("text", F.coalesce("refactored", "text")).drop("refactored"))


def refactor_summary(plan: DataFrame, outcomes: DataFrame | None) -> DataFrame:
    """A7 per project: attempts >= generation successes >= successes (both runs pass)."""
    p = plan
    if outcomes is not None:
        p = p.join(outcomes, ["project", "path", "name"], "left")
    else:
        p = p.withColumn("original_result", F.lit("notRun")).withColumn("refactored_result", F.lit("notRun"))
    attempted = (F.col("strategy") != "none") & (F.col("generation_status") != "none")
    gen_ok = F.col("generation_status") == "success"
    passed = gen_ok & (F.col("original_result") == "pass") & (F.col("refactored_result") == "pass")
    return p.groupBy("project").agg(
        F.count_if(attempted).alias("refactor_attempts"),
        F.count_if(gen_ok).alias("generation_successes"),
        F.count_if(passed).alias("refactor_successes"))


def patched_files(lines: DataFrame, rewritten: DataFrame) -> DataFrame:
    """J10 at file level: the corpus with every rewritten function replaced by
    its new text, as a new ``(project, path, content)`` table. One aggregation
    per file on the line facts' own partitioning."""
    p = rewritten.select("project", "path", F.col("func_line").alias("decl_line"), "refactored", "end_line")
    # a task's new texts are as bounded as its lines: they are hashed, the lines are not sorted
    j = lines.select("project", "path", "decl_line", "line_no", "text").join(
        p.hint("shuffle_hash"), ["project", "path", "decl_line"], "left")
    inside = F.col("refactored").isNotNull() & (F.col("line_no") <= F.col("end_line"))
    txt = (F.when(inside & (F.col("line_no") == F.col("decl_line")), F.col("refactored"))
           .when(inside, F.lit(None)).otherwise(F.col("text")))
    j = j.select("project", "path", "line_no", txt.alias("t")).filter(F.col("t").isNotNull())
    return j.groupBy("project", "path").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), "\n").alias("content"))


def stmt_at_same_position(stmts_a: DataFrame, key_a: DataFrame, stmts_b: DataFrame,
                          key=("project", "path", "name")) -> DataFrame:
    """Find each statement of ``key_a`` (``key`` + ``stmt_masked``) in its
    body by content (hash of the layout-free masked text; first match), then
    take the statement with the same index in the other body ``stmts_b``.
    Both statement tables carry the ``key`` columns."""
    key = list(key)
    h = F.xxhash64(F.regexp_replace(F.col("flat"), r"\s+", ""))
    a = stmts_a.select(*key, "stmt_ord", h.alias("h"))
    k = key_a.select(*key, F.xxhash64(F.regexp_replace(sm.flatten(F.col("stmt_masked")), r"\s+", ""))
                     .alias("h"))
    idx = a.join(k, key + ["h"]).groupBy(*key).agg(F.min("stmt_ord").alias("stmt_ord"))
    b = stmts_b.select(*key, "stmt_ord", F.col("flat").alias("other_flat"), F.col("text").alias("other_text"))
    return idx.join(b, key + ["stmt_ord"], "left")
