"""Line facts with running brace depth (W1) and enclosing top-level declaration.

Input rows must be unique per ``(project, path)``; :func:`distinct_files`
already hash-partitions them by that key, so the windows below run without any
further exchange (checked with ``explain``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testsieve.functions import lexical as lx

FILE_KEY = ["project", "path"]

# Top-level declaration keywords at depth 0.
DECL_PATTERN = r"^(func|type|var|const|import)\b"


def file_window():
    return Window.partitionBy(*FILE_KEY).orderBy("line_no")


def masked_files(files: DataFrame) -> DataFrame:
    """Add ``masked`` (comments blanked, literals filled) next to ``content``."""
    return files.withColumn("masked", lx.mask(F.col("content")))


def file_lines(files: DataFrame, keep=(), counted: bool = False) -> DataFrame:
    """``line(project, path, pkg, line_no, text, masked, depth_before, depth_after,
    paren_before, decl_kind, decl_line)`` for every line of every file.

    ``decl_line`` is the first line of the enclosing top-level declaration
    (NULL between declarations); ``decl_kind`` is set on that first line only. With
    ``counted`` brackets are columns in front of the window: counted once, and one window less.
    """
    m = files if "masked" in files.columns else masked_files(files)
    # files of one folder and package clause are a package; p and p_test are two
    clause = F.regexp_extract(F.col("masked"), r"(?m)^[ \t]*package[ \t]+(\w+)", 1)
    m = m.withColumn("pkg", F.concat(F.regexp_extract(F.col("path"), r"^(.*)/[^/]*$", 1), F.lit("#"), clause))
    # both texts are split once for each file; a lambda around them would split again for every line
    pairs = F.arrays_zip(F.split(F.col("content"), "\n", -1).alias("text"), F.split(F.col("masked"), "\n", -1).alias("masked"))
    exploded = m.select(*FILE_KEY, "pkg", *keep, F.posexplode(pairs).alias("pos", "ln"))
    lines = exploded.select(
        *FILE_KEY, "pkg", *keep,
        (F.col("pos") + 1).alias("line_no"),
        F.col("ln.text").alias("text"),
        F.col("ln.masked").alias("masked"),
    )
    w = file_window()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    delta = lx.brace_delta(F.col("masked"))
    pdelta = lx.paren_delta(F.col("masked"))
    if counted:
        lines = lines.withColumns({"braces": delta, "parens": pdelta})
        delta, pdelta = F.col("braces"), F.col("parens")
    lines = (lines
             .withColumn("depth_after", F.sum(delta).over(run))
             .withColumn("depth_before", F.col("depth_after") - delta)
             .withColumn("paren_after", F.sum(pdelta).over(run))
             .withColumn("paren_before", F.col("paren_after") - pdelta)
             .drop("braces", "parens"))
    kind = F.regexp_extract(F.col("masked"), DECL_PATTERN, 1)
    starts = (F.col("depth_before") == 0) & (F.col("paren_before") == 0) & (kind != "")
    lines = lines.withColumn("decl_kind", F.when(starts, kind))
    # Enclosing declaration = last declaration start at or above this line.
    return (lines
            .withColumn("decl_line", F.last(F.when(F.col("decl_kind").isNotNull(), F.col("line_no")),
                                            ignorenulls=True).over(run))
            .withColumn("cur_kind", F.last(F.col("decl_kind"), ignorenulls=True).over(run)))
