"""Clusters against a plain search over all centroids."""

import hashlib
import random

import numpy as np
import pytest

from testsieve.llm import centroids


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, cluster string, lead double").repartition(3)


def rows_of(seed, n=300):
    rng = random.Random(seed)
    hubs = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.2))) for x in hubs[rng.randrange(5)]]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)] + [rows[3], rows[3]]  # copies, repeated rows
    rows += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 65), (2004, [None] + [0.5] * 63),
             (2005, [float("nan")] + [0.5] * 63), (2006, [float("-inf")] * 64), (2007, [0.0] * 64), (None, [0.25] * 64)]
    return rows


def brute(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    c = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def best(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, v)), j) for j, v in enumerate(c))
    for _ in range(rounds):
        label = [best(q)[1] for _, q in kept]
        for j in set(label):
            own = [q for (_, q), x in zip(kept, label) if x == j]
            c[j] = [sum(x) // len(own) for x in zip(*own)]
    got = [best(q) for _, q in kept]
    inertia = {j: sum(d for d, x in got if x == j) for j in range(k)}
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, got)], key=str)


@pytest.mark.parametrize("seed, n", [(1, 300), (2, 60), (3, 4)])
def test_equals_plain_search(spark, seed, n):
    rows = rows_of(seed, n)
    assert sorted(map(tuple, centroids.clustered(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = rows_of(4, 5)[:5]
    assert sorted(map(tuple, centroids.clustered(frame(spark, rows)).collect()), key=str) == brute(rows)
    assert centroids.clustered(frame(spark, rows).limit(0)).count() == 0


def test_bounds_leave_most_distances_out():
    rng = np.random.default_rng(5)
    hubs = rng.normal(0, 60, (16, 64)) * np.linspace(3, 0.1, 64)
    q = np.floor(hubs[rng.integers(0, 16, 2000)] + rng.normal(0, 3, (2000, 64))).astype(np.int64)
    c = np.floor(hubs).astype(np.int64)
    mean = q.mean(0)
    _, v = np.linalg.eigh(np.cov(q.T))
    v = v[:, ::-1][:, :8]
    label, best, measured = centroids.nearest(q, *centroids.rotated(q, mean, v), c, centroids.rotated(c, mean, v))
    d = ((q[:, None, :] - c[None]) ** 2).sum(2)
    assert (label == d.argmin(1)).all() and (best == d.min(1)).all()
    assert measured < 2 * len(q)


def test_ties_go_to_the_smaller_number():
    c = np.zeros((3, 64), np.int64)
    c[0, 0], c[1, 0], c[2, 1] = 4, -4, 4
    q = np.zeros((1, 64), np.int64)
    v = np.eye(64)[:, :8]
    label, best, _ = centroids.nearest(q, *centroids.rotated(q, np.zeros(64), v), c, centroids.rotated(c, np.zeros(64), v))
    assert (label.tolist(), best.tolist()) == ([0], [16])


def test_too_large_components():
    import pyarrow as pa
    with pytest.raises(ValueError):
        centroids.integers(pa.array([[1e30] * 64], pa.list_(pa.float32())))
