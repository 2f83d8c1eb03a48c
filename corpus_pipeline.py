"""A pipeline over ``documents``: each stage's result is written as Parquet and read again.

Order: toxic documents go, documents of low quality go, one document of each group of
near-duplicates stays, documents with benchmark passages go, the rest is packed. The first
four stages return the columns that they got (extra columns pass through); a document is
named by its id and text together, so rows that share an id but not a text are judged one
by one. Labels of ids that a stage no longer sees are not used. Empty tables pass through.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.llm import decontam, near_dup, packing, quality, toxicity
from testsieve.llm.common import table, written

#: A document of at least this toxicity goes; one of at least this quality stays.
TOXIC, QUALITY = 0.3, 0.3
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5
#: Bytes of a record batch between Spark and Python in every stage. Batches are held several at
#: once on either side, and a stage's executors still hold what the stages before have left.
BATCH = "4m"


def lean(stage):
    """``stage`` with the session set to small record batches, for what it runs and returns."""
    @functools.wraps(stage)
    def run_lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)
    return run_lean


@lean
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, trained on all labels of the documents at hand."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.clean(docs, toxicity.train(docs, labels), TOXIC)


@lean
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, trained on all labels of the documents at hand."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.good(docs, quality.train(docs, labels), QUALITY)


@lean
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group the document with the smallest id stays (ids that are null come
    last), of texts that share it one; of repeated rows one."""
    judged = near_dup.judged(docs, SHINGLE)
    gone = written(judged.filter(~F.col("chosen")).select("t").distinct(), "pipeline-copies")
    left = without(docs, gone, "t")
    return left.dropDuplicates(["doc_id", "text"]) if repeated(docs) else left


def repeated(docs: DataFrame) -> bool:
    """Does any id stand in more than one row?"""
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose hash of id and text ``gone`` does not hold; broadcast behind
    a check of its size."""
    gone = near_dup.small(gone.select(F.col(key).alias("_gone")))
    return docs.join(gone, F.xxhash64(docs["doc_id"], docs["text"]) == gone["_gone"], "left_anti")


@lean
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: a document with any benchmark window goes."""
    judged = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = written(judged.filter("n_hit > 0").select("k").distinct(), "pipeline-contaminated")
    return without(docs, gone, "k")


@lean
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    import public_tokenizers
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near-dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifiers are trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply ``STAGES`` to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
