"""Toxicity: a linear classifier over character n-grams scaled by log-count ratios.

Texts are lower-cased code points; n-grams of three lengths are hashed into 2**20 features
that are present or absent. Each feature is scaled by its naive Bayes log-count ratio
between toxic and clean texts; a logistic regression is trained on the scaled features.
Features whose ratio is near 0 hardly move a score and are left out of the model.

So are features that fewer than ``least_docs`` training texts have.

Training takes the labelled ids with the smallest ``max_train`` hashes, and of their rows the
``max_train`` with the smallest hash of id and text; rows that repeat an id and a text teach
once. Counts of features are added up in parallel and only the features of the model go to
the one task that fits it. Scoring covers whole texts of all rows, in parallel.

Defined results: null text counts as empty and is scored; labels of null or for unknown
ids are not used; conflicting labels of an id count as toxic; without both classes the
score is the share of toxic labels (0.0 without labels); repeated rows and null ids are
scored as rows of their own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.llm.common import give_back, id_remainder, map_arrow, mix, ship, small_batches, table, text_slices, written

SIZES = (3, 4, 5)
FEATURE_BITS = 20
MAX_TRAIN = 8_000

#: Bytes of text whose n-grams a task holds together (several 64-bit values for each byte).
SLICE = 1 << 18
#: Entries of the training matrix that a step of the fit looks at together.
BLOCK = 1 << 20
#: Features whose counts meet in one group.
COUNTED = 1 << 14

_lower: np.ndarray | None = None


def lower_table() -> np.ndarray:
    global _lower
    if _lower is None:
        low = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x10000):
            c = chr(i).lower()
            if len(c) == 1:
                low[i] = ord(c)
        low[[9, 10, 11, 12, 13]] = 32
        _lower = low
    return _lower


def grams(data: np.ndarray, offsets: np.ndarray):
    """(document, feature) of every n-gram of a slice, repeats included, one length at a time."""
    points = lower_table()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = lead[offsets]
    # a blank at each end of a text, so that words at its ends look like others
    points = np.insert(points, np.concatenate([bounds[:-1], bounds[1:]]), 32)
    sizes = np.diff(bounds) + 2
    doc = np.repeat(np.arange(len(sizes)), sizes)
    values = mix(points.astype(np.uint64) + np.uint64(7))
    for n in SIZES:
        if len(points) < n:
            continue
        with np.errstate(over="ignore"):
            h = np.zeros(len(points) - n + 1, np.uint64)
            for j in range(n):
                h = h * np.uint64(0xD6E8FEB86659FD93) + values[j:len(values) - n + 1 + j]
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)
        own = doc[:len(h)] == doc[n - 1:]
        yield doc[:len(h)][own], h[own].astype(np.int64)


def present(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None):
    """Distinct (document, feature) pairs of a slice, of the wanted features only."""
    keys = []
    for doc, feature in grams(data, offsets):
        if wanted is not None:
            hit = wanted[feature]
            doc, feature = doc[hit], feature[hit]
        keys.append(doc << FEATURE_BITS | feature)
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return keys >> FEATURE_BITS, keys & ((1 << FEATURE_BITS) - 1)


def chosen(counts: np.ndarray, texts: np.ndarray, least_ratio: float, least_docs: int):
    """Of features with ``counts`` (clean, toxic) in ``texts`` texts of each label: which ones
    the model takes, and the log-count ratios of those."""
    q, p = counts + 1.0
    ratio = np.log((p / (texts[1] + 2)) / (q / (texts[0] + 2)))
    use = np.flatnonzero((np.abs(ratio) >= least_ratio) & (p + q - 2 >= least_docs))
    return use, ratio[use]


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, l2: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights times scaled log-count ratios, and the bias; ``rows`` holds for each text the
    places of its features among those of the model."""
    share, n, k = float(labels.mean()), len(labels), len(ratio)
    col = np.concatenate(rows)
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(own) for own in rows])
    # a feature's value is the same in every text that has it: its scaled log-count ratio
    scale = ratio / max(np.abs(ratio).max(), 1e-9) if k else np.zeros(0)
    blocks = [slice(at, at + BLOCK) for at in range(0, len(col), BLOCK)]
    w, b = np.zeros(k), np.log(share / (1 - share))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, steps + 1):  # full-batch Adam: the same result on every run
        z, value = np.full(n, b), w * scale
        for own in blocks:
            z += np.bincount(doc[own], value[col[own]], n)
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / n
        met = np.zeros(k)
        for own in blocks:
            met += np.bincount(col[own], g[doc[own]], k)
        gw, gb = met * scale + l2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        f, s = 1 - 0.9 ** t, 1 - 0.999 ** t
        w = w - 0.1 * (m / f) / (np.sqrt(v / s) + 1e-8)
        b = b - 0.1 * (mb / f) / (np.sqrt(vb / s) + 1e-8)
    return (w * scale).astype(np.float32), float(b)


def feature_counts(sample: DataFrame) -> DataFrame:
    """block, ids, counts: for each block of features those that a part of the sample holds, and
    in how many of its texts of each label."""
    def run(batches):
        met = np.zeros((2, 1 << FEATURE_BITS), np.int32)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in text_slices(batch.column(0), SLICE):
                doc, feature = present(data, offsets)
                toxic = label[first + doc] == 1
                for i, own in enumerate((feature[~toxic], feature[toxic])):
                    met[i] += np.bincount(own, minlength=met.shape[1]).astype(np.int32)
        for block in range(met.shape[1] // COUNTED):
            own = met[:, block * COUNTED:(block + 1) * COUNTED]
            ids = np.flatnonzero(own.any(axis=0))
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([ids.astype("<i4").tobytes()], pa.binary()), pa.array([own[:, ids].astype("<i4").tobytes()], pa.binary())],
                    ["block", "ids", "counts"])
        del met
        give_back()

    return map_arrow(sample.select("text", "label"), run, "block int, ids binary, counts binary")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, least_ratio: float = 1.0, least_docs: int = 3):
    """Model (features, weights, bias) from the labelled rows of ``docs`` (labels: doc_id, label)."""
    spark = docs.sparkSession
    bounded = (labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
               .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    # at most max_train small rows
    rows = docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").select("text", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id", "text").alias("k"))
    with small_batches(spark):
        sample = written(rows.dropDuplicates(["k"]), "toxicity-sample")
        # an id may stand in many rows: at most max_train rows, whatever their ids
        sample = sample.join(F.broadcast(sample.select("k").orderBy("k").limit(max_train)), "k", "left_semi").select("text", "label", "k")
        texts = dict(sample.groupBy("label").count().collect())  # two labels
        texts = np.array([sum(n for label, n in texts.items() if label != 1), texts.get(1, 0)])
        if not texts.all():
            return np.zeros(0, np.int64), np.zeros(0, np.float32), 40.0 if texts[1] else -40.0
        return learnt(sample, texts, least_ratio, least_docs)


def learnt(sample: DataFrame, texts: np.ndarray, least_ratio: float, least_docs: int):
    """The model from ``sample`` (text, label, k), which has ``texts`` texts of each label."""
    def add(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        total = np.zeros((2, COUNTED), np.int64)
        for own, part in zip(rows.column("ids"), rows.column("counts")):
            total[:, np.frombuffer(own.as_buffer(), "<i4")] += np.frombuffer(part.as_buffer(), "<i4").reshape(2, -1)
        use, ratio = chosen(total, texts, least_ratio, least_docs)
        return pa.table({"block": pa.array([block], pa.int32()), "ids": [(use + block * COUNTED).astype("<i4").tobytes()], "ratio": [ratio.astype("<f8").tobytes()]})

    spark = sample.sparkSession
    ship(spark)
    got = sorted(feature_counts(sample).groupBy("block").applyInArrow(add, "block int, ids binary, ratio binary").collect())
    ids = np.frombuffer(b"".join(r.ids for r in got), "<i4")  # at most 2**20
    ratio = np.frombuffer(b"".join(r.ratio for r in got), "<f8")
    shared = spark.sparkContext.broadcast((ids, ratio))

    def features(batches):
        column = np.full(1 << FEATURE_BITS, -1, np.int32)
        column[shared.value[0]] = np.arange(len(shared.value[0]), dtype=np.int32)
        wanted = column >= 0
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(0), SLICE):
                doc, feature = present(data, offsets, wanted)
                ends = np.searchsorted(doc, np.arange(len(offsets)))
                places = column[feature].astype("<i4")
                blobs = [places[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                own = batch.slice(first, len(blobs))
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), pa.array(blobs, pa.binary())], ["label", "k", "features"])
        give_back()

    def learn(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("k").to_numpy(), kind="stable")  # independent of arrival
        blobs = [b.as_buffer() for b in rows.column("features")]
        weights, bias = fit([np.frombuffer(blobs[i], "<i4") for i in order], rows.column("label").to_numpy()[order].astype(np.float64), shared.value[1])
        del blobs, rows
        give_back()
        return pa.table({"weights": [weights.tobytes()], "bias": [bias]})

    r = map_arrow(sample, features, "label int, k bigint, features binary").groupBy().applyInArrow(learn, "weights binary, bias double").first()
    shared.unpersist()
    return ids.astype(np.int64), np.frombuffer(r.weights, np.float32), r.bias


def scorer(model):
    """Function from an Arrow text column to scores."""
    ids, weights, bias = model

    def score(column) -> np.ndarray:
        wanted, weight = np.zeros(1 << FEATURE_BITS, bool), np.zeros(1 << FEATURE_BITS, np.float32)
        wanted[ids], weight[ids] = True, weights
        out = np.full(len(column), bias)
        for first, data, offsets in text_slices(column, SLICE):
            doc, feature = present(data, offsets, wanted)
            out[first:first + len(offsets) - 1] += np.bincount(doc, weight[feature], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))

    return score


def scored(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every row."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**20 features

    def run(batches):
        score = scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1)))], ["doc_id", "score"])

    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def clean(docs: DataFrame, model, threshold: float) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = scorer(shared.value)
        for b in batches:
            keep = score(b.column(b.schema.get_field_index("text"))) < threshold
            yield b.filter(pa.array(keep))
        give_back()

    return map_arrow(docs, run, docs.schema)


def training_labels(labels: DataFrame, column: str, divisor: int, left_out: int) -> DataFrame:
    return labels.filter(id_remainder("doc_id", divisor) != left_out).select("doc_id", F.col(column).alias("label"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, training_labels(table(spark, sf_dir, "labels"), "toxic", 4, 2))
    return scored(docs, model).select(
        "doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
