"""Clustering of integer vectors round fixed centroids, searched through a PCA rotation.

A vector of ``DIMENSIONS`` components becomes integers floor(64 * x). The rotation comes from
the covariance of all vectors. Each vector is stored with its ``LEADING`` first rotated
coordinates and the norm of the rest; for a vector and a centroid, the squared distance of the
leading coordinates plus the squared difference of the two rest norms is never more than their
squared distance. The centroid of the least bound is measured first, in integers; every other
whose bound does not exceed that distance is measured too. Bounds are floating point and are
lowered by far more than their error, so the result is the exact nearest centroid (of equal
distances the smaller number).

Sums of clusters are added up in tasks, then by Spark as decimals; the driver holds the
centroids, their counts and one 64 by 64 matrix, whatever the input.

Defined results: vectors that are null, of another length, or hold null, NaN or infinite
components are left out; repeated rows are rows of their own; a null vec_id counts as empty
text in the draw of the first centroids (and stays null in the result), of equal draws the
smaller vector comes first; with fewer vectors than centroids every vector starts one; an
empty table gives no rows; other columns are ignored. Components beyond 2^27 in magnitude
raise an error, as their squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.llm.common import map_arrow, table, written

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
LEADING = 8
LARGEST = 1 << 27


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are kept, and their integer vectors."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    keep = sizes == DIMENSIONS
    values = column.filter(pa.array(keep)).flatten().cast(pa.float64())
    x = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
    whole = np.isfinite(x).all(1)
    keep[np.flatnonzero(keep)[~whole]] = False
    q = np.floor(SCALE * x[whole])
    if len(q) and np.abs(q).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST / SCALE:.0f} has no squared distance that fits a long")
    return keep, q.astype(np.int64)


def packed(q: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    width = q.shape[1] * q.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(q), [None, pa.py_buffer(np.ascontiguousarray(q).tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, q (32-bit integers) of every kept row."""
    def run(batches):
        for b in batches:
            keep, q = integers(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), packed(q.astype("<i4"))], ["vec_id", "q"])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return map_arrow(embeddings.select("vec_id", "embedding"), run, f"vec_id {kind}, q binary")


def rotation(rows: DataFrame, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of all vectors and the directions of their largest spread (64 x leading)."""
    names = [f"v{j}" for j in range(DIMENSIONS)]

    def run(batches):
        n, total, products = 0, np.zeros(DIMENSIONS), np.zeros((DIMENSIONS, DIMENSIONS))
        for b in batches:
            q = unpacked(b.column(0), "<i4", DIMENSIONS).astype(float)
            n, total, products = n + len(q), total + q.sum(0), products + q.T @ q
        if n:
            m = np.vstack([products, total])
            yield pa.RecordBatch.from_arrays([pa.array(range(DIMENSIONS + 1), pa.int32()), pa.array([n] * (DIMENSIONS + 1), pa.int64()), *[pa.array(m[:, j]) for j in range(DIMENSIONS)]], ["i", "n", *names])

    parts = map_arrow(rows.select("q"), run, "i int, n bigint, " + ", ".join(f"{v} double" for v in names))
    got = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in names]).collect())  # 65 rows
    if not got:
        return np.zeros(DIMENSIONS), np.eye(DIMENSIONS)[:, :leading]
    m = np.array([r[2:] for r in got])
    mean = m[DIMENSIONS] / got[0]["n"]
    _, directions = np.linalg.eigh(m[:DIMENSIONS] / got[0]["n"] - np.outer(mean, mean))
    return mean, directions[:, ::-1][:, :leading]


def rotated(q: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading coordinates, norm of the rest, squared norm of the whole."""
    x = q - mean
    lead, whole = x @ directions, (x * x).sum(1)
    return lead, np.sqrt(np.maximum(0, whole - (lead * lead).sum(1))), whole


def stored(rows: DataFrame, mean: np.ndarray, directions: np.ndarray) -> DataFrame:
    """vec_id, q, lead, rest, whole of every vector."""
    def run(batches):
        for b in batches:
            lead, rest, whole = rotated(unpacked(b.column(1), "<i4", DIMENSIONS), mean, directions)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(lead.astype("<f8")), pa.array(rest), pa.array(whole)], ["vec_id", "q", "lead", "rest", "whole"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return map_arrow(rows, run, f"vec_id {kind}, q binary, lead binary, rest double, whole double")


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, whole: np.ndarray, centroids: np.ndarray, around) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, and how many distances
    were measured. ``around``: the centroids' own (lead, rest, whole)."""
    c_lead, c_rest, c_whole = around
    bound = ((lead[:, None, :] - c_lead[None]) ** 2).sum(2) + (rest[:, None] - c_rest[None]) ** 2
    bound -= 1e-9 * (whole[:, None] + c_whole[None]) + 1e-6
    label = bound.argmin(1)
    q = q.astype(np.int64)
    best = ((q - centroids[label]) ** 2).sum(1)
    first, measured = label.copy(), len(q)
    for j, c in enumerate(centroids):
        at = np.flatnonzero((bound[:, j] <= best) & (first != j))
        d = ((q[at] - c) ** 2).sum(1)
        measured += len(at)
        closer = (d < best[at]) | ((d == best[at]) & (j < label[at]))
        label[at[closer]], best[at[closer]] = j, d[closer]
    return label, best, measured


def assigning(centroids: np.ndarray, mean: np.ndarray, directions: np.ndarray):
    """A function from a batch of ``stored`` rows to (integers, label, distance)."""
    around = rotated(centroids, mean, directions)

    def run(b):
        q = unpacked(b.column("q"), "<i4", DIMENSIONS)
        lead = unpacked(b.column("lead"), "<f8", directions.shape[1])
        return q, *nearest(q, lead, b.column("rest").to_numpy(), b.column("whole").to_numpy(), centroids, around)[:2]
    return run


def moved(rows: DataFrame, centroids: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floor of each cluster's mean; empty ones stay."""
    assign = assigning(centroids, mean, directions)
    k = len(centroids)

    def run(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), np.int64)
        for b in batches:
            q, label, _ = assign(b)
            n += np.bincount(label, minlength=k)
            np.add.at(total, label, q)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, DIMENSIONS), pa.int32()), pa.array(np.tile(np.arange(DIMENSIONS), len(at)), pa.int32()),
                                          pa.array(total[at].ravel()), pa.array(np.repeat(n[at], DIMENSIONS))], ["cluster", "i", "total", "n"])

    parts = map_arrow(rows, run, "cluster int, i int, total bigint, n bigint")
    out = centroids.copy()
    sums = parts.groupBy("cluster", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    for r in sums.collect():  # centroids x 64 rows
        out[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
    return out


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hash."""
    draw = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)

    def components(r):
        return np.frombuffer(r["q"], "<i4").astype(np.int64)

    # of equal hashes the smaller vector: components with the sign bit turned, big-endian, order as bytes
    def ordered(batches):
        for b in batches:
            q = unpacked(b.column(1), "<i4", DIMENSIONS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed((q.astype(np.int64) + (1 << 31)).astype(">u4"))], ["h", "q", "o"])

    drawn = map_arrow(rows.select(draw.alias("h"), "q"), ordered, "h string, q binary, o binary")
    got = drawn.orderBy("h", "o").limit(k).collect()
    return np.array([components(r) for r in got], np.int64).reshape(-1, DIMENSIONS)


def clustered(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, leading: int = LEADING) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = embeddings.sparkSession
    rows = written(vectors(embeddings), "vectors")
    mean, directions = rotation(rows, leading)
    centroids = first_centroids(rows, k)
    rows = written(stored(rows, mean, directions), "rotated")
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids, mean, directions)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if len(centroids):
        assign = assigning(centroids, mean, directions)
    else:
        assign = None  # no vectors, so no batches with rows

    def run(batches):
        for b in batches:
            if b.num_rows:
                _, label, distance = assign(b)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(label, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = written(map_arrow(rows, run, f"vec_id {kind}, cluster int, distance bigint"), "assigned")
    sums = {r[0]: int(r[1]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # a row a cluster
    about = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _rounds_sql(rounds: int) -> str:
    distance = "list_sum(list_transform(generate_series(1, 64), lambda i: (k.q[i] - c.q[i]) * (k.q[i] - c.q[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS m
          FROM (SELECT k.r, c.c, CAST({distance} AS BIGINT) AS d FROM kept k, c{r} c) GROUP BY r)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT m.c AS c, i, sum(CAST(q[i] AS HUGEINT)) AS s, count(*) AS n
          FROM a{r} JOIN kept USING (r), generate_series(1, 64) t(i) GROUP BY ALL)""")
            steps.append(f"""m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{r} GROUP BY c)""")
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)""")
    return ",\n".join(steps)


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q
  FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM kept ORDER BY h, q LIMIT {CENTROIDS})),
{_rounds_sql(ROUNDS)}
SELECT k.vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance,
       CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept k USING (r) JOIN c{ROUNDS} c ON c.c = m.c
"""
