"""Spark session helpers.

Settings follow the cluster when one is given: nothing here overrides a value
that is already set on the session, except where explicitly requested.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults used only when the session does not already define them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Fact tables are all hash-partitioned by (project, path); joins on a finer
    # key, e.g. (project, path, func_line), reuse that partitioning.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Source text is CPU-heavy per byte (tokeniser, windows): do not let AQE
    # coalesce small shuffles into a handful of partitions.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    # Facts are wide rows that compress well: a shuffled byte takes ten and more when it is sorted.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # Facts take some forty times the size of their files in memory: a side is broadcast by its
    # size as measured in the run, never by that of the files below it.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # Fact tables have one sorted file for each bucket: windows and joins on their keys need no
    # other sort. Spark takes the order as known only where a bucket is a single file.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    # Plan descriptions are rendered for every execution; keep them bounded.
    "spark.sql.maxPlanStringLength": "200000",
}


def cut_lineage(df):
    """Materialise ``df`` once as Parquet in the shared checkpoint folder (never a local one)
    and return the table: plans that read it stay small, read the columns they use only, and
    survive lost executors. Columns without a type become strings, which hold null as well.
    ``factstore.release`` deletes the files."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import NullType
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/testsieve-facts/cut-{uuid.uuid4().hex[:12]}"
    untyped = {f.name: F.lit(None).cast("string") for f in df.schema if isinstance(f.dataType, NullType)}
    df = df.withColumns(untyped) if untyped else df
    df.write.parquet(path)
    _cuts.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders of the tables that :func:`cut_lineage` has written.
_cuts: list[str] = []


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "testsieve") -> SparkSession:
    """Build (or reuse) a session with the UI off and AQE on."""
    builder = (SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TESTSIEVE_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    apply_defaults(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the engine's session defaults that the session does not set itself."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


#: Scratch folders of local sessions that name no folder, by application.
_scratch: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``; read it from the session
    (or from the context, which reads that setting at start-up). Only when it is
    unset and the master is local (tests) a scratch folder is created and set; on
    a cluster that would be a folder which other machines do not see, so it is
    an error there.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or _scratch.get(sc.applicationId) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # a running session takes no change of spark.checkpoint.dir
        d = _scratch[sc.applicationId] = tempfile.mkdtemp(prefix="testsieve-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d
