"""T1 on source files: a stream of files that replaces what is known of changed files.

Rows ``(project, path, content, revision)`` land as Parquet; null content takes a file away. Each
micro-batch is analysed by itself (the same operators as the batch job) and leaves, under its
number, two small tables:

* ``files/batch=<id>``: the facts of each file of the batch and its functions;
* ``deltas/batch=<id>``: for each group that the batch touches, the new sums minus the sums of the
  replaced facts. The statistics of all files are the sum of the deltas, so a batch reads the
  earlier facts of its own files only and never the other files or their text.

A batch that is run again overwrites its own two folders and reads those of earlier batches, so
the result is the same. A file with an older or equal revision than the one known is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.operators import decls as dc
from testsieve.operators import lines as ln
from testsieve.session import cut_lineage
from testsieve.sources import corpus as cp

FILE_KEY = ["project", "path"]
SOURCE_SCHEMA = "project string, path string, content string, revision bigint"
FUNCTION = "struct<name:string,start_line:int,end_line:int,is_method:boolean>"
FACT_SCHEMA = ("project string, path string, revision bigint, present boolean, is_test_file boolean, file_lines bigint, "
               f"n_tests bigint, test_lines bigint, functions array<{FUNCTION}>")
#: What a group adds up: files, test files, lines, tests and their lines (A1-A5).
SUMS = {"totalFiles": "1", "testFiles": "int(is_test_file)", "totalLines": "file_lines", "testCases": "n_tests", "testLines": "test_lines"}
DELTA_SCHEMA = "project string, " + ", ".join(f"{c} bigint" for c in SUMS)


def file_records(files: DataFrame) -> DataFrame:
    """Facts of each file (``FACT_SCHEMA``) from rows (project, path, content, revision), one for
    each file; a file without content is not ``present``."""
    present = files.filter("content is not null").select("project", "path", "content")
    lines = ln.file_lines(present.repartition(cp.file_partitions(present), *FILE_KEY))
    facts = dc.file_facts(lines, F.array_sort(F.collect_list(F.when((F.col("kind") == "func") & F.col("start_line").isNotNull(), F.struct(
        "start_line", "name", F.col("end_line").cast("int").alias("end_line"), "is_method")))).alias("fs"))
    shaped = F.transform(F.coalesce("fs", F.array().cast("array<struct<start_line:int,name:string,end_line:int,is_method:boolean>>")), lambda f: F.struct(
        f["name"].alias("name"), f["start_line"].cast("int").alias("start_line"), f["end_line"].alias("end_line"), f["is_method"].alias("is_method")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return files.select(*FILE_KEY, "revision", F.col("content").isNotNull().alias("present")).join(facts, FILE_KEY, "left").select(
        *FILE_KEY, "revision", "present", F.col("path").endswith("_test.go").alias("is_test_file"), zero("file_lines"), zero("n_tests"), zero("test_lines"),
        shaped.alias("functions"))


def newest(rows: DataFrame) -> DataFrame:
    """The row of the highest revision of each file."""
    columns = [c for c in rows.columns if c not in FILE_KEY]
    return rows.groupBy(*FILE_KEY).agg(F.max_by(F.struct(*columns), "revision").alias("r")).select(*FILE_KEY, "r.*")


def _before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """Facts that earlier batches wrote."""
    if batch_id == 0:
        return spark.createDataFrame([], FACT_SCHEMA)
    paths = [f"{folder}/files/batch={i}" for i in range(batch_id)]
    return spark.read.schema(FACT_SCHEMA).parquet(*paths)


def replace_files(spark: SparkSession, batch: DataFrame, batch_id: int, folder: str, load_errors: DataFrame | None = None,
                  strict_vendor: bool = False) -> None:
    """Take one micro-batch in."""
    batch = cp.skip_error_files(cp.skip_vendor(batch.select("project", "path", "content", "revision"), strict_vendor), load_errors)
    batch = cut_lineage(newest(batch))
    old = cut_lineage(newest(_before(spark, folder, batch_id).join(batch.select(*FILE_KEY), FILE_KEY, "left_semi")))
    known = old.select(*FILE_KEY, F.col("revision").alias("known"))
    fresh = batch.join(known, FILE_KEY, "left").filter("known is null or revision > known").drop("known")
    new = cut_lineage(file_records(fresh))
    new.write.mode("overwrite").parquet(f"{folder}/files/batch={batch_id}")
    gone = old.join(new.select(*FILE_KEY), FILE_KEY, "left_semi")
    signed = new.filter("present").withColumn("sign", F.lit(1)).unionByName(gone.filter("present").withColumn("sign", F.lit(-1)))
    sums = signed.groupBy("project").agg(*[F.sum(F.expr(f"sign * ({e})")).cast("long").alias(c) for c, e in SUMS.items()])
    sums.write.mode("overwrite").parquet(f"{folder}/deltas/batch={batch_id}")


def file_stream(spark: SparkSession, source_dir: str, folder: str, checkpoint: str, load_errors: DataFrame | None = None,
                max_files_per_trigger: int | None = None, strict_vendor: bool = False) -> None:
    """Take in every file of ``source_dir`` that has not been taken in yet."""
    reader = spark.readStream.schema(SOURCE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def take(batch: DataFrame, batch_id: int) -> None:
        replace_files(batch.sparkSession, batch, batch_id, folder, load_errors, strict_vendor)
    (reader.parquet(source_dir).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def current_files(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of every file as it is now."""
    return newest(spark.read.schema(FACT_SCHEMA).parquet(f"{folder}/files/*")).filter("present")


def func_decls(spark: SparkSession, folder: str) -> DataFrame:
    """F1 of the files as they are now."""
    f = current_files(spark, folder).select(*FILE_KEY, F.explode("functions").alias("f"))
    return f.select(*FILE_KEY, "f.name", "f.start_line", "f.end_line", "f.is_method")


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """P1 of the files as they are now, per project, from the deltas alone."""
    d = spark.read.schema(DELTA_SCHEMA).parquet(f"{folder}/deltas/*")
    s = d.groupBy(F.col("project").alias("projectDir")).agg(*[F.sum(c).alias(c) for c in SUMS])
    n, lines = F.col("testCases"), F.col("testLines").cast("double")
    return s.select("projectDir", "testCases", "testFiles", "totalFiles", "testLines",
                    F.when(n > 0, lines / n).otherwise(F.lit(0.0)).alias("avgLinesPerTest"),
                    F.when(n > 0, lines / F.col("totalLines") * 100).otherwise(F.lit(0.0)).alias("percentTestLines"))
