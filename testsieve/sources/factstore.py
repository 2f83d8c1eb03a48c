"""Fact tables written once as bucketed Parquet in the shared folder.

The line facts are the largest table (every line, original and masked text).
Writing them as Parquet bucketed by ``(project, path)`` keeps them columnar and
compressed, lets later reports read only the columns they use, and keeps the
file-key partitioning: a bucketed scan reports ``HashPartitioning(project,
path)``, so per-file windows, aggregates and joins on the file key still need
no exchange. The data is already hash-partitioned by that key with the same
hash as bucketing, so the write produces about one file per bucket.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame

from testsieve import session
from testsieve.session import checkpoint_dir


def bucket_count(estimate: int | None, partitions: int, most: int, bytes_per_bucket: int) -> int:
    """How many buckets a table gets: the shuffle partitions, or ``bytes_per_bucket`` of the
    estimated bytes if that asks for more, but no more than the session allows. Beyond that a
    bucket grows, as one sorted file that readers split by row group."""
    wanted = max(partitions, (estimate or 0) // bytes_per_bucket)
    return max(1, min(wanted, most))


#: Groups that one task collects in memory where its text is bounded, before it sorts instead.
GROUPS_IN_MEMORY = 1 << 17


@contextmanager
def collected_in_memory(spark):
    """Inside, aggregates that collect rows sort them only beyond ``GROUPS_IN_MEMORY`` groups a
    task, not beyond 128. Only for what runs on the partitions of files, which
    ``corpus.file_partitions`` bounds by their text."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(GROUPS_IN_MEMORY))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def store_bucketed(df: DataFrame, name: str, keys=("project", "path"), sort=("project", "path"),
                   buckets: int | None = None, bytes_per_bucket: int = 512 << 20) -> DataFrame:
    """Write ``df`` as a bucketed, sorted Parquet table below the shared
    checkpoint folder and return the table. ``release`` drops it. See :func:`bucket_count`;
    the estimate is the logical plan's own."""
    spark = df.sparkSession
    n = buckets or bucket_count(estimated_bytes(df), int(spark.conf.get("spark.sql.shuffle.partitions")),
                                int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")), bytes_per_bucket)
    tag = uuid.uuid4().hex[:12]
    path = f"{checkpoint_dir(spark).rstrip('/')}/testsieve-facts/{name}-{tag}"
    table = f"testsieve_{name}_{tag}"
    with collected_in_memory(spark):
        (df.write.format("parquet").bucketBy(int(n), *keys).sortBy(*sort)
         .option("path", path).saveAsTable(table))
    _TABLES.append(table)
    return spark.table(table)


_TABLES: list[str] = []


def release(spark) -> None:
    """Drop the fact tables and lineage cuts that this process has written, with their files."""
    fs = spark._jvm.org.apache.hadoop.fs
    while session._cuts:
        path = fs.Path(session._cuts.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    while _TABLES:
        table = _TABLES.pop()
        location = [r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r.col_name == "Location"]
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        for where in location:
            path = fs.Path(where)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What Spark takes for the size of a leaf without statistics, and more.
_UNKNOWN = 1 << 60


def estimated_bytes(df: DataFrame) -> int | None:
    """Bytes of the sources below ``df``, as the optimizer knows them before any run
    (joins and explodes left out: the largest leaf counts); None if no leaf has statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max((s for s in sizes if s < _UNKNOWN), default=None)
