"""Positions from outside (load errors, run output) and the functions that hold them.

A position names a file and a line. Function spans are listed under the bins of ``WIDTH`` lines
that they touch, positions under the bin of their line, so the interval join is an equi-join on
file and bin with a comparison behind it: no nested loop, and a long file's positions and spans
are spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
#: A position in a message: file, line and, if given, column.
POSITION_PATTERN = r"([^\s:]+\.go):(\d+)(?::(\d+))?"


def positions_in(messages: DataFrame, column: str, keep=()) -> DataFrame:
    """``(keep, nth, path, line)`` of every position that a text names, in order."""
    found = F.regexp_extract_all(column, F.lit(POSITION_PATTERN), 0)
    p = messages.select(*keep, F.posexplode(found).alias("nth", "p"))
    return p.select(*keep, "nth", F.regexp_extract("p", POSITION_PATTERN, 1).alias("path"),
                    F.regexp_extract("p", POSITION_PATTERN, 2).cast("int").alias("line"))


def enclosing(positions: DataFrame, spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each position (``project, path, line`` and more) with every span (``start_line, end_line,
    name``) that holds it; a position that no span holds is one row with null ``name``."""
    bin_ = F.floor(F.col("line") / width)
    s = spans.select(F.col("project").alias("s_project"), F.col("path").alias("s_path"), "start_line", "end_line", "name",
                     F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))).alias("s_bin"))
    p = positions.withColumn("bin", bin_)
    j = p.join(s, (p["project"] == s["s_project"]) & (p["path"] == s["s_path"]) & (p["bin"] == s["s_bin"])
               & (p["line"] >= s["start_line"]) & (p["line"] <= s["end_line"]), "left")
    return j.drop("bin", "s_project", "s_path", "s_bin")


def outermost(positions: DataFrame, spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """The outermost function of each position; positions are told apart by all their columns."""
    keys = positions.columns
    first = F.min(F.when(F.col("name").isNotNull(), F.struct("start_line", -F.col("end_line"), "name")))
    return enclosing(positions.distinct(), spans, width).groupBy(*keys).agg(first["name"].alias("name"), first["start_line"].alias("start_line"))
