"""Incremental append of per-file / per-run results with Structured Streaming.

New source files (or run logs) land in an input folder as Parquet; a stream
reads them with ``trigger(availableNow=True)``, applies the same stateless
per-row operators as the batch jobs and appends to a Parquet sink with its own
checkpoint. Project-level aggregates are recomputed in batch from the appended
facts, so no streaming state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.operators import runs as rn


def append_stream(spark: SparkSession, source_dir: str, schema, transform, sink_dir: str,
                  checkpoint: str, max_files_per_trigger: int | None = None) -> None:
    """Process every file present in ``source_dir`` once and append the result.

    ``transform`` is a DataFrame -> DataFrame function made of stateless
    operators (filters, projections, scalar classifiers).
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = transform(reader.parquet(source_dir))
    q = (stream.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def classified_runs_stream(spark: SparkSession, run_log_dir: str, sink_dir: str, checkpoint: str,
                           max_files_per_trigger: int | None = None) -> None:
    """C3/C4 for run logs arriving over time."""
    schema = spark.read.parquet(run_log_dir).schema
    append_stream(spark, run_log_dir, schema,
                  lambda df: df.select(
                      "run_id", "test_id", "project", "path", "test", "phase",
                      rn.cl.run_result(F.col("exit_ok"), F.col("output"), F.col("path"), F.col("test")).alias("result"),
                      rn.cl.run_message(F.col("exit_ok"), F.col("output"), F.col("stderr"), F.col("path"),
                                        F.col("test")).alias("message")),
                  sink_dir, checkpoint, max_files_per_trigger)


def read_appended(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir)
