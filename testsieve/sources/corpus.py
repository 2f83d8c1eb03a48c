"""Corpus scans and the file-level filters that precede every analysis.

A corpus is a DataFrame ``source_file(project, path, content)`` with one row per
Go file. It can be scanned from a directory tree of ``.go`` files or read from a
Parquet table with those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_KEY = ["project", "path"]


def read_go_tree(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """Every ``*.go`` file below ``root``, tests included, one row per file.

    ``project`` defaults to the base name of ``root``. To scan a folder holding
    many projects, call :func:`read_go_projects`.
    """
    name = project or root.rstrip("/").split("/")[-1]
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.go")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:(//)?", "")
    return df.select(F.lit(name).alias("project"), path.alias("path"), F.col("value").alias("content"))


def read_go_projects(spark: SparkSession, root: str) -> DataFrame:
    """S1 for a folder of projects: ``root/<project>/...``; project = first folder."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.go")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:(//)?", "")
    rel = F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)
    return df.select(F.substring_index(rel, "/", 1).alias("project"), path.alias("path"),
                     F.col("value").alias("content"))


def read_source_table(spark: SparkSession, path: str) -> DataFrame:
    """S1 from Parquet ``(project, path, content)``; only the needed columns are read."""
    return spark.read.parquet(path).select("project", "path", "content")


def is_vendored(path_col, strict: bool = False):
    """The reference skips any path *containing* ``vendor``; ``strict`` only a
    ``vendor/`` folder."""
    if strict:
        return path_col.rlike(r"(^|/)vendor/")
    return path_col.contains("vendor")


def skip_vendor(files: DataFrame, strict: bool = False) -> DataFrame:
    return files.filter(~is_vendored(F.col("path"), strict))


def error_files(load_errors: DataFrame) -> DataFrame:
    """Files named by load errors: text before the first ``:`` of the position,
    only when that colon is not the first character."""
    pos = F.col("position")
    return (load_errors.filter(F.instr(pos, ":") > 1)
            .select("project", F.substring_index(pos, ":", 1).alias("path"))
            .distinct())


def skip_error_files(files: DataFrame, load_errors: DataFrame | None) -> DataFrame:
    """Left anti join on the file key. AQE turns it into a broadcast
    join at run time when the error list is small, from its measured size."""
    if load_errors is None:
        return files
    return files.join(error_files(load_errors), FILE_KEY, "left_anti")


def distinct_files(files: DataFrame) -> DataFrame:
    """S6 (deliberate deviation): one row per file key.

    This is also the single shuffle that co-locates each file's rows by
    ``(project, path)``; all per-file facts derived later keep this partitioning.
    """
    return files.dropDuplicates(FILE_KEY)


def relative_path(path_col, project_col):
    """Path below the project root ``.../<project>/``; whole path when the
    project name is not a folder of it."""
    marker = F.concat(F.lit("/"), project_col, F.lit("/"))
    start = F.instr(path_col, marker) + F.length(project_col) + 2
    return F.when(F.instr(path_col, marker) > 0,
                  path_col.substr(start, F.lit(1 << 30))
                  ).otherwise(path_col)




#: Bytes of text whose lines one task sorts: as rows with their keys they take some twenty times
#: as much. Below ``LEAST_TEXT`` a task is not worth its start.
MOST_TEXT, LEAST_TEXT = 16 << 20, 1 << 20


def partitions_of(n_bytes: int, partitions: int) -> int:
    """Tasks for so many bytes of text: ``partitions`` of them, fewer if the text is little (two
    at least, as a single one would not be dealt by key), more if it is much."""
    return max(2, min(partitions, n_bytes // LEAST_TEXT), -(-n_bytes // MOST_TEXT))


def file_partitions(files: DataFrame) -> int:
    """:func:`partitions_of` the bytes of all texts, added up by one scan. Neither the size of
    the sources nor that of a shuffle tells it: both are compressed."""
    n_bytes = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    usual = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = partitions_of(n_bytes, usual)
    # as many as a shuffle has: files that come from one by the same key would keep its
    # partitions, which adaptive execution coalesces by their compressed size
    return n + 1 if n == usual else n


def prepare_files(files: DataFrame, load_errors: DataFrame | None = None,
                  strict_vendor: bool = False, partitions: int | None = None) -> DataFrame:
    """S2 + S3 + S6: the visited files, in as many partitions by file key as their text asks for
    (:func:`file_partitions`, unless given), so what is sorted per file stays in memory."""
    kept = skip_vendor(files, strict_vendor)
    if "content" in files.columns:
        kept = kept.repartition(partitions or file_partitions(kept), *FILE_KEY)
    return distinct_files(skip_error_files(kept, load_errors))
