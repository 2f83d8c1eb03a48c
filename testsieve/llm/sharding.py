"""Sharding by sampled splitters.

Rows are ordered by a key (hash of the text, then id), so that equal texts lie side by
side. A size-weighted sample of keys gives fine range boundaries at its quantiles; the
exact bytes of every range are counted, ranges that hold more than their share are
subdivided by a denser sample of their own, and rows are dealt to shards by their place
in the running total of bytes over the ranges. A group of equal texts is cut only where
a boundary between two shards falls into it and it holds over a hundredth of a shard.

Defined results: null text has no bytes (size 1) and the checksum of empty text; null
ids sort first; repeated rows are rows of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from testsieve.llm.common import map_arrow, table, written

RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 16
MAX_ROUNDS = 8


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key (h, k) of every row; no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.lit(11)).alias("h"),
        F.coalesce(F.xxhash64(F.col("doc_id")), F.lit(0)).alias("k"))


def sampled(rows: DataFrame, share, seed: int) -> list[tuple[int, int]]:
    """Keys drawn with probability size * share (``share``: a column, at most 1 counts); the
    draw is a function of the key, so a task that runs again draws the same. The expected
    number of keys is a parameter of the caller and does not grow with the input."""
    u = (F.shiftrightunsigned(F.xxhash64("h", "k", F.lit(seed)), 11) / F.lit(float(1 << 53)))
    return [tuple(r) for r in rows.filter(u < F.col("size") * share).select("h", "k").distinct().collect()]


def with_range(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Number of the range of each row: how many splitters are at or below its key."""
    hashes = np.array([h for h, _ in splitters], np.int64)
    schema = rows.schema.simpleString()[7:-1] + ",range:int"

    def run(batches):
        for b in batches:
            h = b.column(b.schema.get_field_index("h")).to_numpy(zero_copy_only=False)
            k = b.column(b.schema.get_field_index("k")).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            out = high.astype(np.int32)
            for i in np.flatnonzero(low != high):
                out[i] = bisect.bisect_right(splitters, (int(h[i]), int(k[i])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "range"])

    return map_arrow(rows, run, schema)


def range_sizes(rows: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """Bytes, rows and smallest and largest key hash of each range (as many rows as ranges)."""
    got = rows.groupBy("range").agg(F.sum("size"), F.count("*"), F.min("h"), F.max("h")).collect()
    return {r[0]: tuple(r)[1:] for r in got}


def choose_splitters(rows: DataFrame, n_shards: int) -> list[tuple[int, int]]:
    total, count, biggest = rows.agg(F.sum("size"), F.count("*"), F.max("size")).first()
    if not count:
        return []
    n_ranges = n_shards * RANGES_PER_SHARD
    target = total / n_ranges
    keys = sorted(sampled(rows, F.lit(n_ranges * SAMPLES_PER_RANGE / total), 1))
    step = SAMPLES_PER_RANGE
    # a splitter stands before the whole group of its key
    splitters = sorted({(h, -(1 << 63)) for h, _ in keys[::step]})
    for round_ in range(MAX_ROUNDS):
        ranged = with_range(rows, splitters)
        sizes = range_sizes(ranged)
        over = {r: s for r, s in sizes.items() if s[0] > max(2 * target, 1.5 * biggest) and s[1] > 1}
        if not over:
            break
        # a range of one group only is cut by id inside the group, others between groups
        wanted = {r: max(2, int(np.ceil(s[0] / target))) for r, s in over.items()}
        share = F.create_map(*[F.lit(x) for r, w in wanted.items() for x in (r, w * SAMPLES_PER_RANGE / over[r][0])])
        drawn = sampled(ranged.filter(F.col("range").isin(list(over))), share[F.col("range")], 2 + round_)
        by: dict[int, list] = {}
        for key in sorted(drawn):
            by.setdefault(bisect.bisect_right(splitters, key), []).append(key)
        more = set()
        for r, own in by.items():
            cuts = own[::max(1, len(own) // wanted[r])]
            more |= set(cuts) if over[r][2] == over[r][3] else {(h, -(1 << 63)) for h, _ in cuts}
            if over[r][2] != over[r][3]:  # set the largest group of the range apart
                h = max({h for h, _ in own}, key=lambda x: sum(1 for a, _ in own if a == x))
                more.add((h, (1 << 63) - 1))
        if more <= set(splitters):
            break
        splitters = sorted(set(splitters) | more)
    return splitters


def shards(docs: DataFrame, n_shards: int = 8, whole_group: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and range of every row, shards near equal in
    bytes. A group of equal texts of at most ``whole_group`` of a shard's bytes stays whole."""
    spark = docs.sparkSession
    rows = written(keyed(docs.select("doc_id", "text")), "shard-keys")
    ranged = written(with_range(rows, choose_splitters(rows, n_shards)), "shard-ranges")
    sizes = range_sizes(ranged)
    total, before, count, plan = sum(s[0] for s in sizes.values()), 0, 0, []
    for r in sorted(sizes):
        plan.append((r, before, count))
        before, count = before + sizes[r][0], count + sizes[r][1]
    # one row for each range: their number is a parameter, not a matter of the input
    places = spark.createDataFrame(plan, "range int, bytes_before bigint, rows_before bigint")
    order = Window.partitionBy("range").orderBy("h", "k", "doc_id", "size", "text_crc32")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range", "h")
    here = (ranged.withColumn("end", F.sum("size").over(upto))
            .withColumn("row", F.row_number().over(order).cast("long") - 1)
            .withColumn("group_size", F.sum("size").over(group)).withColumn("group_end", F.max("end").over(group))
            .join(F.broadcast(places), "range"))
    small = F.col("group_size") <= int(whole_group * total / n_shards)
    middle = F.col("bytes_before") + F.when(small, F.col("group_end") - F.col("group_size") / 2).otherwise(F.col("end") - F.col("size") / 2)
    placed = (here.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(float(max(total, 1))))).cast("int"))
              .select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("row")).alias("place"), "range"))
    placed = written(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"), "range"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
