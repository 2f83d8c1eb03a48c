"""Direct mappings (DT): operators exercised on driver tables as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.functions import classify as cl
from testsieve.operators import runs as rn
from testsieve.sources import fixtures as fx


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 on ``pages.url``: repository-root style prefix, pages per root."""
    p = _t(spark, sf_dir, "pages").select(cl.import_path_root(F.col("url")).alias("root_path"))
    return p.groupBy("root_path").agg(F.count(F.lit(1)).alias("n_pages"))


def _line_count(text):
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")


def unit_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3/A4 shape on ``conversations``: a conversation is a file, an assistant
    turn a unit; units, unit lines, all lines, average and percentage."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "role", "text")
    is_unit = F.col("role") == "assistant"
    lines = _line_count(F.col("text"))
    g = c.groupBy("conv_id").agg(
        F.count_if(is_unit).cast("long").alias("units"),
        F.coalesce(F.sum(F.when(is_unit, lines)), F.lit(0)).cast("long").alias("unit_lines"),
        F.sum(lines).cast("long").alias("total_lines"))
    n = F.col("units")
    return g.select(
        "conv_id", "units", "unit_lines", "total_lines",
        F.when(n > 0, F.col("unit_lines").cast("double") / n).otherwise(0.0).alias("avg_unit_lines"),
        F.when(n > 0, F.col("unit_lines").cast("double") / F.col("total_lines") * 100)
        .otherwise(0.0).alias("percent_unit_lines"))


def classify_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.classify_runs(fx.run_log(spark, sf_dir))


def run_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.run_messages(fx.run_log(spark, sf_dir))


def outcome_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.outcome_compare(fx.run_log(spark, sf_dir))


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.document_files(spark, sf_dir)
    return d.select("doc_id", "file_name", cl.detect_format(F.col("file_name")).alias("format"))


def enum_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.enum_texts(spark, sf_dir)
    return e.select(
        "event_id",
        cl.decode_execution_result(F.col("raw_result")).alias("execution_result"),
        cl.decode_generation_status(F.col("raw_status")).alias("generation_status"),
        cl.parse_strategy(F.col("raw_strategy")).alias("strategy"))
