"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points are taken; in every window of w neighbouring
hashes the smallest is chosen, the rightmost of equal ones; chosen hashes keep their
positions. Two texts that share a stretch of at least k + w - 1 code points share a
chosen hash. A text shorter than k is one gram of its own; an empty text has none.

The next document in descending id order comes from an exact range partition: ranges of
ids with boundaries at sampled quantiles, the first row of each range also sent to the
range before it, each range walked in order. Ties of an id are ordered by text.

Defined results: null text counts as empty; null ids come last and are one another's
ties; the next of the last row is the first row (of a single row: itself); repeated rows
are rows of their own; two empty fingerprints are alike (1.0), an empty and a full one
are not (0.0); other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.llm.common import map_arrow, power_tables, table

K = 12
W = 8


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram; of the whole text if it is shorter."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint64)
    powers, inverses = power_tables(n + 1)
    k = min(k, n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(3)) * np.uint64(0xBF58476D1CE4E5B9) * powers[:n], out=total[1:])
        h = total[k:] - total[:-k]
        h *= inverses[:n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        return h


def window_minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each window of w neighbours the position of the rightmost smallest hash."""
    w = min(w, len(hashes))
    best, low, span = np.arange(len(hashes)), hashes, 1  # of hashes[i:i + span]
    while span < w:
        step = min(span, w - span)
        right = low[step:] <= low[:len(low) - step]
        best = np.where(right, best[step:], best[:len(best) - step])
        low = np.where(right, low[step:], low[:len(low) - step])
        span += step
    return best


def distinct(best: np.ndarray) -> np.ndarray:
    """Positions chosen over all windows, ascending."""
    return best[np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))] if len(best) else best


def fingerprint(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text."""
    h = gram_hashes(code_points(text), k)
    at = distinct(window_minima(h, w))
    return h[at], at


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sets of distinct hashes, each sorted."""
    if not len(a) and not len(b):
        return 1.0
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    return hashlib.blake2b(hashes.astype("<u8").tobytes() + positions.astype("<u8").tobytes(), digest_size=16).hexdigest()


class Printed:
    """One text with its fingerprint and what that of an edited copy can use again."""

    def __init__(self, text: str, points: np.ndarray | None = None, hashes: np.ndarray | None = None, best: np.ndarray | None = None):
        self.text = text
        self.points = code_points(text) if points is None else points
        self.all = gram_hashes(self.points, K) if hashes is None else hashes
        self.best = window_minima(self.all, W) if best is None else best
        self.positions = distinct(self.best)
        self.hashes = self.all[self.positions]
        self.kinds = np.unique(self.hashes)

    def edited(self, following: Printed) -> Printed:
        """The last third replaced by the start of the following text; grams and windows
        of the part that stays are not computed anew."""
        n = len(self.text)
        cut, kept = n // 3, n - n // 3
        text = self.text[:kept] + following.text[:cut]
        grams = kept - K + 1
        if cut == 0 or grams < W:
            return Printed(text)
        points = np.concatenate([self.points[:kept], following.points[:cut]])
        hashes = self.all[:grams]
        if len(points) > kept:
            hashes = np.concatenate([hashes, gram_hashes(points[grams:], K)])
        windows = grams - W + 1
        best = np.concatenate([self.best[:windows], window_minima(hashes[windows:], W) + windows]) if len(hashes) > grams else self.best[:windows]
        return Printed(text, points, hashes, best)


def in_ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """(part, doc_id, text, guest) and the number of parts: every row in the range of its id,
    and the first row of each range once more, as a guest at the end of the range before it
    (the first range's at the end of the last one). The number of ranges is a matter of the
    cluster's shuffle partitions; a range is walked as a stream, whatever its size."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    wanted = max(1, min(n // 200, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.1 / wanted)}) if wanted > 1 else []
    kind = docs.schema["doc_id"].dataType
    below = F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: F.col("doc_id") < c)) if cuts else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(below).cast("int")
    parts = docs.select(part.alias("part"), "doc_id", "text", F.lit(False).alias("guest"))
    # one row for each range
    tops = sorted(tuple(r) for r in parts.groupBy("part").agg(F.max("doc_id")).collect())
    if not tops:
        return parts, 1
    before = {p: tops[i - 1][0] for i, (p, _) in enumerate(tops)}
    moved = F.create_map(*[F.lit(x) for p in before for x in (p, before[p])])
    first = F.col("doc_id").isin([t for _, t in tops if t is not None]) | F.col("doc_id").isNull()
    head = (parts.filter(first).groupBy("part").agg(F.max(F.struct("doc_id", "text")).alias("row"))
            .select(moved[F.col("part")].alias("part"), "row.doc_id", "row.text", F.lit(True).alias("guest")))
    return parts.unionByName(head), len(cuts) + 2


def walked(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to one another."""
    rows, n = in_ranges(docs)
    dealt = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def result(own: Printed, following: Printed) -> tuple:
        edited = own.edited(following)
        return (len(own.text), hashlib.sha256(edited.text.encode("utf-8", "surrogatepass")).hexdigest(),
                digest(own.hashes, own.positions), digest(edited.hashes, edited.positions),
                likeness(own.kinds, edited.kinds), likeness(own.kinds, following.kinds))

    def run(batches):
        last, last_id = None, None
        for b in batches:
            ids, out = [], []
            for doc_id, text, guest in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                own = Printed(text)
                if last is not None:
                    ids.append(last_id)
                    out.append(result(last, own))
                last, last_id = (None if guest else own), doc_id
            columns = list(zip(*out)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(1).type), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    return map_arrow(dealt, run, f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hashes, positions of every row: the fingerprints themselves, for indexes."""
    docs = docs.select("doc_id", "text")

    def run(batches):
        for b in batches:
            got = [fingerprint(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())),
                                              pa.array([p.astype(np.int32) for _, p in got], pa.list_(pa.int32()))], ["doc_id", "hashes", "positions"])

    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hashes array<bigint>, positions array<int>")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked(table(spark, sf_dir, "documents"))
