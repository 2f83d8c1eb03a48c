"""Statement facts of function bodies.

A statement starts on a body line at paren depth 0 whose previous code line did
not end in a continuation token. Statements are attached to the enclosing
top-level function by a running window on the file partitioning that the
line facts already have, so no exchange is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE_KEY = ["project", "path"]
FUNC_KEY = ["project", "path", "func_line"]

# A code line ending in one of these continues on the next line (Go inserts no
# semicolon after them); `++` and `--` do end a statement.
CONTINUATION_END = r"(?:[,+\-*/%&|^<>=!.:]|&&|\|\|)$"
INC_DEC_END = r"(?:\+\+|--)$"


def balanced(levels: int, kinds: str = r"{}()\[\]") -> str:
    """Regex for text whose brackets nest up to ``levels`` deep (possessive). The text is
    well-formed code with literals masked, so counting suffices: kinds need not be told apart."""
    opening, closing = {"{}": (r"\{", r"\}"), "()": (r"\(", r"\)")}.get(kinds, (r"[{(\[]", r"[})\]]"))
    b = rf"[^{kinds}]*+"
    for _ in range(levels):
        b = rf"(?:[^{kinds}]++|{opening}{b}{closing})*+"
    return b


def deepest(df: DataFrame, column: str = "flat") -> int:
    """Deepest nesting of brackets in a text column, over all rows: patterns are built for
    what the corpus has, so there is no depth at which they stop matching."""
    # statements share few nestings: each is folded once
    df = df.select(F.regexp_replace(F.col(column), r"[^{}()\[\]]+", "").alias("marks")).distinct()
    marks = F.split("marks", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, ch):
        now = acc["now"] + F.when(ch.rlike(r"[{(\[]"), 1).when(ch.rlike(r"[})\]]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))
    return int(df.agg(F.max(F.aggregate(marks, start, step)["most"])).first()[0] or 0) + 1


def item_pattern(levels: int, separator: str = ",") -> str:
    """One piece of a list: no separator outside nested groups."""
    return rf"(?:[^{{}}()\[\]{separator}]++|[{{(\[]" + balanced(levels) + r"[})\]])++"


def range_pattern(levels: int) -> str:
    """`for k, v := range X {BODY}`; X may itself be a composite literal."""
    return (r"^\s*for\s+(?:(\w+)\s*(?:,\s*(\w+))?\s*:?=\s*)?range\s+(.*?)\s*\{" + balanced(levels, "{}") + r"\}\s*$")


def literal_pattern(levels: int) -> str:
    """Composite literal `TYPE{ELEMS}` filling a whole expression."""
    body = balanced(levels, "{}")
    lit_type = r"(?:\[\d*\]|\[\.\.\.\]|map\[[^\]]+\])*\s*\*?\s*(?:struct\s*\{" + body + r"\}|[\w.]+)"
    return r"^\s*&?\s*(" + lit_type + r")\s*\{(" + body + r")\}\s*$"


SIMPLE_RANGE_PATTERN = r"^\s*for\s+(?:(\w+)\s*(?:,\s*(\w+))?\s*:?=\s*)?range\s+([\w.]+)\s*\{"

# Left-hand side and right-hand side of `a, b := rhs` / `a = rhs` / `var a T = rhs`.
ASSIGN_PATTERN = r"^\s*(\w+(?:\s*,\s*\w+)*)\s*:?=\s*(.*?)\s*$"
VAR_PATTERN = r"^\s*var\s+(\w+(?:\s*,\s*\w+)*)(?:\s+([^=]+?))?\s*(?:=\s*(.*?))?\s*$"

# First parameter field of type *testing.T that has a name.
TESTER_PARAM = r"(?:^|,)\s*(\w+)(?:\s*,\s*\w+)*\s+\*\s*testing\s*\.\s*T\s*(?:,|$)"
PARAMS_PATTERN = r"^\s*func\s*(?:\([^)]*\)\s*)?\w+\s*(?:\[[^\]]*\])?\s*\(([^)]*)\)"


def statement_lines(lines: DataFrame) -> DataFrame:
    """Lines of function bodies with ``stmt_start`` and the enclosing top-level
    statement line ``stmt_line`` (depth 1; the `func` line of a function on one line)."""
    w = Window.partitionBy(*FILE_KEY).orderBy("line_no")
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    masked = F.col("masked")
    nonblank = masked.rlike(r"\S")
    code = F.regexp_replace(masked, r"\s+$", "")
    goes_on = code.rlike(CONTINUATION_END) & ~code.rlike(INC_DEC_END)
    cont = F.last(F.when(nonblank, goes_on), ignorenulls=True).over(prev)
    in_func = ((F.col("cur_kind") == "func") & (F.col("line_no") != F.col("decl_line"))
               & (F.col("depth_before") >= 1))
    closing = ((F.col("depth_before") == 1) & (F.col("depth_after") == 0)
               & masked.rlike(r"^\s*\}"))
    one_line = ((F.col("cur_kind") == "func") & (F.col("line_no") == F.col("decl_line"))
                & (F.col("depth_before") == 0) & (F.col("depth_after") == 0) & masked.rlike(r"\}\s*$"))
    body = (in_func & ~closing) | one_line
    start = body & nonblank & (F.col("paren_before") == 0) & ~F.coalesce(cont, F.lit(False))
    out = (lines.withColumn("in_body", body)
           .withColumn("stmt_start", start))
    top = F.when(one_line | (F.col("stmt_start") & (F.col("depth_before") == 1)), F.col("line_no"))
    out = out.withColumn("stmt_line", F.last(top, ignorenulls=True).over(run))
    return out.filter("in_body").withColumn("func_line", F.col("decl_line"))


#: A statement that has a clause before its block, in which `;` separates no statements.
CLAUSE_START = r"^\s*(?:\w+\s*:\s*)?(?:for|if|switch|select)\b"


def cut_statements(text, masked, before, size):
    """``ARRAY<STRUCT<text, masked>>``: the statements in ``size`` characters behind the first
    ``before`` ones, cut at each `;` outside brackets that is not in the clause of a `for`,
    `if`, `switch` or `select`. ``masked`` has the offsets of ``text``."""
    pieces = F.regexp_extract_all(F.substring(masked, before + 1, size), F.lit(r"(?s)([{}()\[\];]|[^{}()\[\];]+)"), 1)
    # `fresh`: nothing of the statement has been met; `clause`: its block has not begun
    start = F.struct((before + 1).alias("at"), F.lit(0).alias("open"), F.lit(True).alias("fresh"), F.lit(False).alias("clause"),
                     F.array(before).alias("cuts"))

    def step(acc, p):
        turn = F.when(p.rlike(r"^[{(\[]$"), 1).when(p.rlike(r"^[})\]]$"), -1).otherwise(0)
        outside = acc["open"] == 0
        clause = (F.when(acc["fresh"] & p.rlike(CLAUSE_START), True).when(outside & p.rlike(r"^\s*else\s+if\b"), True)
                  .when(outside & (p == "{"), False).otherwise(acc["clause"]))
        cut = outside & (p == ";") & ~acc["clause"]
        return F.struct((acc["at"] + F.length(p)).alias("at"), (acc["open"] + turn).alias("open"),
                        F.when(cut, True).otherwise(acc["fresh"] & ~p.rlike(r"\S")).alias("fresh"),
                        (clause & ~cut).alias("clause"),
                        F.when(cut, F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"]).alias("cuts"))
    cuts = F.aggregate(pieces, start, step, lambda r: F.concat(r["cuts"], F.array(r["at"])))
    cut = lambda s, a, b: F.substring(s, a + 1, b - a - 1)
    found = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.struct(
        cut(text, F.get(cuts, i - 1), F.get(cuts, i)).alias("text"), cut(masked, F.get(cuts, i - 1), F.get(cuts, i)).alias("masked")))
    return F.filter(found, lambda x: x["masked"].rlike(r"\S"))


def block_statements(text, masked):
    """The statements between the braces of a statement or function on one line."""
    from testsieve.operators.refactor import body_span
    span = body_span(masked)
    return cut_statements(text, masked, span["first"], span["last"] - span["first"] - 1)


def statements(lines: DataFrame) -> DataFrame:
    """``stmt(project, path, func_line, pkg, stmt_line, stmt_ord, end_line, text,
    masked, flat, children)``: one row per top-level body statement; statements that share a
    line are rows of their own.

    ``flat`` = masked text on one line (newlines as ``;``, blanks collapsed);
    ``children`` = every direct statement of the first nested block (depth 2), in
    order: its first line and the masked and original text of the line and the next
    one, so an argument list that begins on the next line is seen. A block on one line has
    its statements as children too.
    """
    sl = statement_lines(lines).filter(F.col("stmt_line").isNotNull())
    g = sl.groupBy(*FUNC_KEY, "stmt_line").agg(
        F.first("pkg").alias("pkg"), F.array_sort(F.collect_list(F.struct(
            "line_no", "text", "masked", "depth_before", "paren_before", "stmt_start"))).alias("ls"))
    masked = F.array_join(F.transform("ls", lambda x: x["masked"]), "\n")
    text = F.array_join(F.transform("ls", lambda x: x["text"]), "\n")
    follow = lambda x, i, f: F.concat_ws(" ", x[f], F.when(x["masked"].rlike(r"\(\s*$"), F.get("ls", i + 1)[f]))
    children = F.filter(
        F.transform("ls", lambda x, i: F.when(x["stmt_start"] & (x["depth_before"] == 2), F.struct(
            x["line_no"].alias("line_no"), follow(x, i, "masked").alias("masked"), follow(x, i, "text").alias("text")))),
        lambda c: c.isNotNull())
    s = g.select(*FUNC_KEY, "pkg", "stmt_line", F.element_at(F.col("ls"), -1)["line_no"].alias("end_line"),
                 text.alias("text"), masked.alias("masked"), children.alias("children"))
    own = F.struct("text", "masked")
    parts = (F.when(F.col("stmt_line") == F.col("func_line"), block_statements(F.col("text"), F.col("masked")))
             .when(F.col("masked").contains(";"), cut_statements(F.col("text"), F.col("masked"), F.lit(0), F.length("masked")))
             .otherwise(F.array(own)))
    s = s.select(*FUNC_KEY, "pkg", "stmt_line", "end_line", "children", F.posexplode(parts).alias("part", "own"))
    text, masked = F.col("own.text"), F.col("own.masked")
    several = F.flatten(F.transform("children", lambda c: F.when(c["masked"].contains(";"), F.transform(
        cut_statements(c["text"], c["masked"], F.lit(0), F.length(c["masked"])),
        lambda x: F.struct(c["line_no"].alias("line_no"), x["masked"].alias("masked"), x["text"].alias("text")))).otherwise(F.array(c))))
    on_one_line = F.transform(block_statements(text, masked), lambda x: F.struct(
        F.col("stmt_line").alias("line_no"), x["masked"].alias("masked"), x["text"].alias("text")))
    one_line = ~masked.contains("\n") & masked.rlike(CLAUSE_START + r".*\{.*\}\s*$")
    children = F.when(one_line, on_one_line).when(~masked.contains("\n"), F.slice("children", 1, 0)).when(
        F.exists("children", lambda c: c["masked"].contains(";")), several).otherwise(F.col("children"))
    s = s.withColumn("children", children)
    w = Window.partitionBy(*FUNC_KEY).orderBy("stmt_line", "part")
    return (s.select(*FUNC_KEY, "pkg", "stmt_line", "end_line", "own.text", "own.masked", "children", F.row_number().over(w).alias("stmt_ord"))
            .withColumn("flat", flatten(F.col("masked"))))


def flatten(masked):
    """One-line form of masked text: newlines become ``;`` separators, then
    separators next to braces, commas and other separators are dropped."""
    one = F.trim(F.regexp_replace(masked, r"\s+", " "))  # nothing to separate
    s = F.regexp_replace(masked, r"\n", " ; ")
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, r"(?:\s*;\s*)+", "; ")
    s = F.regexp_replace(s, r"([{(,\[])\s*;\s*", "$1 ")
    s = F.regexp_replace(s, r"\s*;\s*([})\]])", " $1")
    s = F.regexp_replace(s, r"^\s*;\s*|\s*;\s*$", "")
    return F.when(masked.contains("\n") | masked.contains(";"), F.trim(s)).otherwise(one)


def tester_param(header) -> F.Column:
    """name of the first named parameter field of type ``*testing.T``."""
    params = F.regexp_extract(header, PARAMS_PATTERN, 1)
    name = F.regexp_extract(params, TESTER_PARAM, 1)
    return F.when(name != "", name)


def count_statements(stmts: DataFrame) -> DataFrame:
    """number of top-level statements per function."""
    return stmts.groupBy(*FUNC_KEY).agg(F.count(F.lit(1)).alias("n_statements"))
