"""Top-level declarations, test validity and imports.

Every aggregate here groups by ``(project, path, ...)`` on rows that are already
hash-partitioned by ``(project, path)``; Spark plans them without an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testsieve.functions import lexical as lx

FILE_KEY = ["project", "path"]
DECL_KEY = ["project", "path", "start_line"]


def decl_groups(lines: DataFrame) -> DataFrame:
    """One row per top-level declaration plus one row per file for the lines
    before the first declaration (``start_line`` NULL).

    ``end_line`` = first line at or after the start where both brace and
    parenthesis depth are back to 0. ``header`` = masked text of the first line
    plus continuation lines inside the parameter list, joined by a blank.
    ``max_code`` = last line of the group whose masked text is not blank, so a
    file's line count (F7) is read from these rows without a second pass over
    the lines.
    """
    in_header = (F.col("line_no") == F.col("decl_line")) | (
        (F.col("depth_before") == 0) & (F.col("paren_before") > 0))
    closed = (F.col("depth_after") == 0) & (F.col("paren_after") == 0)
    code = F.when(F.col("masked").rlike(r"\S"), F.col("line_no"))
    g = (lines
         .groupBy("project", "path", F.col("decl_line").alias("start_line"))
         .agg(F.max("decl_kind").alias("kind"), F.first("pkg").alias("pkg"),
              F.min(F.when(closed, F.col("line_no"))).alias("end_line"),
              F.max(code).alias("max_code"),
              F.array_sort(F.collect_list(F.when(in_header & F.col("decl_line").isNotNull(),
                                                 F.struct("line_no", "masked", "text"))))
              .alias("hdr")))
    g = g.withColumn("end_line", F.coalesce("end_line", "start_line"))
    # Continuation lines after the declaration end belong to the gap, not to it.
    hdr = F.filter("hdr", lambda h: h["line_no"] <= F.col("end_line"))
    return g.select(
        *DECL_KEY, "pkg", "kind", "end_line", "max_code",
        F.array_join(F.transform(hdr, lambda h: h["masked"]), " ").alias("header"),
        F.array_join(F.transform(hdr, lambda h: h["text"]), " ").alias("header_text"),
    )


def declarations(lines: DataFrame) -> DataFrame:
    """One row per top-level declaration (func/type/var/const/import)."""
    return decl_groups(lines).filter(F.col("start_line").isNotNull()).drop("max_code")


def with_func_names(decls: DataFrame) -> DataFrame:
    return decls.withColumn("name", F.when(F.col("kind") == "func",
                                           F.regexp_extract("header", lx.FUNC_NAME_PATTERN, 1))) \
        .withColumn("is_method", F.col("header").rlike(lx.RECEIVER_PATTERN))


def func_decls(lines: DataFrame) -> DataFrame:
    """top-level function declarations with name, receiver flag, line span and package."""
    d = with_func_names(declarations(lines).filter(F.col("kind") == "func"))
    return d.select(*DECL_KEY, "end_line", "header", "header_text", "name", "is_method", "pkg")


def with_test_flags(funcs: DataFrame) -> DataFrame:
    """``is_valid`` (reference test criteria) and ``bad_format``.

    The cheap prefix test runs before the regular expression.
    """
    name = F.col("name")
    valid = name.startswith("Test") & F.col("header").rlike(lx.TEST_HEADER_PATTERN)
    return funcs.withColumn("is_valid", valid).withColumn(
        "bad_format", valid & ~name.rlike("^Test[A-Z]"))


def test_lines_col():
    """lines of a test, ``func`` line to closing brace (doc comment excluded)."""
    return (F.col("end_line") - F.col("start_line") + 1).cast("long")


def valid_tests(funcs: DataFrame) -> DataFrame:
    """one row per valid test with its line count."""
    t = with_test_flags(funcs).filter("is_valid")
    return t.withColumn("test_lines", test_lines_col())


def file_facts(lines: DataFrame, *more) -> DataFrame:
    """Per file, in one pass over the lines: ``file_lines`` (F7), ``n_tests``,
    ``test_lines`` (A3) and ``more`` aggregates of the declarations. Both aggregates keep the
    (project, path) partitioning."""
    g = with_test_flags(with_func_names(decl_groups(lines)))
    valid = F.coalesce(F.col("is_valid"), F.lit(False))
    return g.groupBy(*FILE_KEY).agg(
        F.coalesce(F.max("max_code"), F.lit(0)).cast("long").alias("file_lines"),
        F.count_if(valid).cast("long").alias("n_tests"),
        F.coalesce(F.sum(F.when(valid, test_lines_col())), F.lit(0)).cast("long").alias("test_lines"), *more)


def file_packages(lines: DataFrame) -> DataFrame:
    """Declared package name of each file (first ``package`` clause)."""
    pk = F.regexp_extract(F.col("masked"), r"^\s*package\s+(\w+)", 1)
    return lines.filter(pk != "").groupBy(*FILE_KEY).agg(
        F.min_by(pk, F.col("line_no")).alias("package"))


# On the masked line a path is a run of filler quotes; comments are blanks there.
IMPORT_SPEC = r"""^(\s*(?:import\b\s*\(?\s*)?(?:([\w.]+)\s+)?)("+)\s*\)?\s*;?\s*$"""


def import_spec(masked, text):
    """(alias, path as written) of an import line: found in the masked text, read from the
    original at the same place; empty where the line holds none."""
    lead, quoted = (F.length(F.regexp_extract(masked, IMPORT_SPEC, i)) for i in (1, 3))
    return F.regexp_extract(masked, IMPORT_SPEC, 2), F.substring(text, lead + 1, quoted)


def imports(lines: DataFrame) -> DataFrame:
    """``import_decl(project, path, import_ord, alias, import_path)`` in file
    order; only ``"`` is trimmed (back-quoted paths keep their quotes)."""
    il = lines.filter((F.col("cur_kind") == "import") & (F.col("depth_before") == 0))
    alias, spec = import_spec(F.col("masked"), F.col("text"))
    il = il.select(*FILE_KEY, "line_no", spec.alias("spec"), alias.alias("alias")).filter(F.col("spec") != "")
    return il.select(
        *FILE_KEY, "line_no",
        F.when(F.col("alias") != "", F.col("alias")).alias("alias"),
        F.trim(F.col("spec"), F.lit('"')).alias("import_path"))




def decl_texts(lines: DataFrame, kinds=("type", "var")) -> DataFrame:
    """Full masked text of package-level declarations of the given kinds:
    ``(project, path, start_line, pkg, kind, masked, text)``."""
    sel = lines.filter(F.col("cur_kind").isin(list(kinds)) & F.col("decl_line").isNotNull())
    g = sel.groupBy("project", "path", F.col("decl_line").alias("start_line")).agg(
        F.max("decl_kind").alias("kind"), F.first("pkg").alias("pkg"),
        F.array_sort(F.collect_list(F.struct("line_no", "masked", "text"))).alias("ls"))
    return g.select(
        *DECL_KEY, "pkg", "kind",
        F.array_join(F.transform("ls", lambda x: x["masked"]), "\n").alias("masked"),
        F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"))


def import_names(lines: DataFrame) -> DataFrame:
    """``(project, path, aliases)``: the names by which a file calls its imports: the alias, or
    the last part of the path that is not a version."""
    path = F.regexp_replace(F.regexp_replace("import_path", r"`", ""), r"(?:/v\d+|\.v\d+)$", "")
    named = imports(lines).select(*FILE_KEY, F.coalesce("alias", F.regexp_extract(path, r"([\w]+)$", 1)).alias("a")).filter("a not in ('', '_', '.')")
    return named.groupBy(*FILE_KEY).agg(F.array_sort(F.collect_set("a")).alias("aliases"))


def file_info(lines: DataFrame) -> DataFrame:
    """Package clause and ordered imports of each file that has any, in one aggregation over
    the lines that can hold them (same partitioning, no exchange)."""
    pk = F.regexp_extract(F.col("masked"), r"^\s*package\s+(\w+)", 1)
    is_imp = F.coalesce((F.col("cur_kind") == "import") & (F.col("depth_before") == 0), F.lit(False))
    lines = lines.filter(is_imp | F.col("masked").rlike(r"^\s*package\s"))
    _, spec = import_spec(F.col("masked"), F.col("text"))
    imp = F.when(is_imp & (spec != ""), F.struct(F.col("line_no"), F.trim(spec, F.lit('"')).alias("p")))
    return lines.groupBy(*FILE_KEY).agg(
        F.min_by(F.when(pk != "", pk), F.when(pk != "", F.col("line_no"))).alias("package"),
        F.transform(F.array_sort(F.collect_list(imp)), lambda x: x["p"]).alias("imports"))
