"""Quality: random-indexing word vectors, pooled, and a small calibrated network.

Every word has a sparse random index vector that follows from its hash. A word's vector is
the sum of the index vectors of its neighbours over all documents, scaled to length 1, plus
its own index vector. Words fall into 2**14 hash buckets (a word met often all but owns its
bucket), so the vectors are a table of fixed size whatever the input; each task adds up its
own part and the parts are summed by bucket. A document is the mean and the spread of the
vectors of its words. A two-layer network is trained in numpy on the labelled ids with the
smallest ``max_train`` hashes, and of their rows the ``max_train`` with the smallest hash of id
and text (rows that repeat both teach once); its temperature is fitted on rows left out.

Words are runs of letters, of digits, or of one other sign; line ends count; a word that
repeats one of the two before it becomes a marker word.

Defined results: null text counts as empty and is scored as a document without words;
labels of null or for unknown ids are not used, conflicting labels of an id count as 0;
without both classes the score is the share of label 1 (0.5 without labels); repeated rows
and null ids are scored as rows of their own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.llm.common import give_back, id_remainder, map_arrow, mix, runs, ship, span_hashes, table, text_slices

BUCKET_BITS = 14
WIDTH = 48
NONZERO = 4
NEIGHBOURS = 2
MAX_TRAIN = 20_000
REPEAT = 0  # the marker's bucket

CLASSES = np.arange(256, dtype=np.uint8)
CLASSES[65:91] = CLASSES[97:123] = CLASSES[128:] = 1
CLASSES[48:58] = 2
CLASSES[[9, 11, 12, 13, 32]] = 0


def words(data: np.ndarray, offsets: np.ndarray):
    """Bucket and document of every word of a slice."""
    starts, ends, docs = runs(data, offsets, CLASSES)
    h = span_hashes(data, starts, ends)
    out = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    letters = CLASSES[data[starts]] == 1 if len(starts) else np.zeros(0, bool)
    for back in (1, 2):
        same = np.zeros(len(h), bool)
        same[back:] = (h[back:] == h[:-back]) & (docs[back:] == docs[:-back])
        out[same & letters] = REPEAT
    return out, docs


def index_places() -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Where the random index vector of each bucket has +1 or -1, and which."""
    n = 1 << BUCKET_BITS
    h = [mix(np.arange(n, dtype=np.uint64) * np.uint64(NONZERO) + np.uint64(s + 1)) for s in range(NONZERO)]
    return [(x % np.uint64(WIDTH)).astype(np.int64) for x in h], [np.where(x >> np.uint64(63), 1.0, -1.0) for x in h]


def index_vectors() -> np.ndarray:
    """The random index vectors as a table."""
    out = np.zeros((1 << BUCKET_BITS, WIDTH), np.float32)
    for place, sign in zip(*index_places()):
        np.add.at(out, (np.arange(len(out)), place), sign)
    return out


def context_sums(docs: DataFrame) -> DataFrame:
    """bucket, vector: summed index vectors of the neighbours, a row per task and bucket met."""

    def run(batches):
        n = 1 << BUCKET_BITS
        # each bucket's places and signs; a place that is hit twice counts twice
        place, sign = index_places()
        total, any_rows = np.zeros(n * WIDTH), False
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0), 1 << 20):
                w, doc = words(data, offsets)
                any_rows = any_rows or len(w) > 0
                for d in range(1, NEIGHBOURS + 1):
                    own = doc[d:] == doc[:-d]
                    a, b = w[:-d][own], w[d:][own]
                    word, near = np.concatenate([a, b]) * WIDTH, np.concatenate([b, a])
                    for s in range(NONZERO):
                        total += np.bincount(word + place[s][near], sign[s][near], n * WIDTH)
        total = total.reshape(n, WIDTH)
        if any_rows:
            met = np.flatnonzero(np.abs(total).sum(axis=1))
            raw, size = total[met].astype("<f4").tobytes(), 4 * WIDTH
            vectors = pa.array([raw[i:i + size] for i in range(0, len(raw), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), vectors], ["bucket", "vector"])
        give_back()

    return map_arrow(docs.select("text"), run, "bucket int, vector binary")


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Table of 2**14 word vectors learnt from every document (fixed size)."""
    def add(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket").to_numpy()
        v = np.frombuffer(b"".join(rows.column("vector").to_pylist()), "<f4").reshape(-1, WIDTH).astype(np.float64)
        order = np.lexsort((*v.T[:3], bucket))
        ids, first = np.unique(bucket[order], return_index=True)
        sums = np.add.reduceat(v[order], first, axis=0)
        return pa.table({"bucket": ids.astype(np.int32), "vector": [r.astype("<f4").tobytes() for r in sums]})

    ship(docs.sparkSession)
    parts = context_sums(docs).withColumn("block", F.col("bucket") % 64)
    got = parts.groupBy("block").applyInArrow(add, "bucket int, vector binary").collect()
    out = np.zeros((1 << BUCKET_BITS, WIDTH), np.float64)
    for r in got:
        out[r.bucket] = np.frombuffer(r.vector, "<f4")
    out -= out.sum(axis=0) / max(np.abs(out).sum(), 1e-9) * np.abs(out).sum(axis=1, keepdims=True)  # what all words share
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return (out + index_vectors() / NONZERO).astype(np.float32)


def pool(column, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the log of its words."""
    out = np.zeros((len(column), 2 * WIDTH + 1), np.float32)
    for first, data, offsets in text_slices(column, 1 << 18):
        w, doc = words(data, offsets)
        n = len(offsets) - 1
        if not len(w):
            continue
        count = np.bincount(doc, minlength=n)
        full = np.flatnonzero(count)
        at = np.concatenate([[0], np.cumsum(count[full])[:-1]])
        for lo in range(0, len(full), 4096):
            own = full[lo:lo + 4096]
            begin = at[lo]
            stop = at[lo + 4096] if lo + 4096 < len(full) else len(w)
            size = count[own][:, None]
            x = vectors[w[begin:stop]]
            mean = np.add.reduceat(x, at[lo:lo + 4096] - begin, axis=0) / size
            square = np.add.reduceat(x * x, at[lo:lo + 4096] - begin, axis=0) / size
            out[first + own, :WIDTH] = mean
            out[first + own, WIDTH:2 * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
            out[first + own, 2 * WIDTH] = np.log1p(size[:, 0])
    return out


class Network:
    """Two layers in numpy, trained with Adam on mini-batches in a fixed order."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 7):
        self.share = float(y.mean()) if len(y) else 0.5
        self.trained = len(y) > 0 and 0 < self.share < 1
        if not self.trained:
            return
        rng = np.random.Generator(np.random.PCG64(seed))
        self.middle, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = self.prepared(x)
        calibration = np.arange(len(y)) % 5 == 0
        fit, rest = np.flatnonzero(~calibration), np.flatnonzero(calibration)
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = rng.permutation(fit)
            for at in range(0, len(order), 128):
                i = order[at:at + 128]
                h = np.tanh(x[i] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - y[i]) / len(i)
                gh = np.outer(g, p[2]) * (1 - h * h)
                grads = [x[i].T @ gh + 1e-4 * p[0], gh.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                t += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * grads[k]
                    v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                    p[k] -= 3e-3 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        self.p = p
        logits = self.logits(x[rest])
        temperatures = np.geomspace(0.25, 8, 60)
        loss = [np.logaddexp(0, np.where(y[rest] == 1, -1, 1) * logits / s).mean() for s in temperatures]
        self.temperature = float(temperatures[int(np.argmin(loss))])

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.prepared(x.astype(np.float64))) / self.temperature, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN):
    """(word vectors of all documents, network from the labelled rows of ``docs``)."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    bounded = (labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
               .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    # at most max_train small rows
    sample = docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").select("text", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id", "text").alias("k"))

    def run(batches):
        for b in batches:
            x = pool(b.column(0), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f4").tobytes() for r in x], pa.binary()), b.column(1), b.column(2)], ["x", "label", "k"])

    # an id may stand in many rows: at most max_train rows, whatever their ids
    pooled = map_arrow(sample, run, "x binary, label int, k bigint").dropDuplicates(["k"])
    got = pooled.orderBy("k").limit(max_train).collect()
    shared.unpersist()
    x = np.frombuffer(b"".join(r.x for r in got), "<f4").reshape(-1, 2 * WIDTH + 1).astype(np.float64)
    return vectors, Network(x, np.array([r.label for r in got], np.float64))


def scored(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every row."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**14 vectors and a small network

    def run(batches):
        vectors, network = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(network.score(pool(b.column(1), vectors)))], ["doc_id", "score"])

    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def good(docs: DataFrame, model, threshold: float) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        vectors, network = shared.value
        for b in batches:
            keep = network.score(pool(b.column(b.schema.get_field_index("text")), vectors)) >= threshold
            yield b.filter(pa.array(keep))
        give_back()

    return map_arrow(docs, run, docs.schema)


def training_labels(labels: DataFrame, divisor: int, left_out: int) -> DataFrame:
    return labels.filter(id_remainder("doc_id", divisor) != left_out).select("doc_id", F.col("quality").alias("label"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, training_labels(table(spark, sf_dir, "labels"), 5, 0))
    return scored(docs, model).select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
