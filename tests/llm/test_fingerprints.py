"""Winnowing against its definition, its guarantee, and the order of documents."""

import hashlib
import random

import numpy as np
from fixtures_llm import docs, texts, words

from testsieve.llm import fingerprints as fp


def test_windows_choose_the_rightmost_smallest():
    rng = random.Random(3)
    for n in (0, 1, 3, 8, 9, 50):
        h = np.array([rng.randrange(5) for _ in range(n)], np.uint64)
        w = min(8, n)
        want = sorted({max(range(i, i + w), key=lambda j: (-int(h[j]), j)) for i in range(n - w + 1)}) if n else []
        assert fp.distinct(fp.window_minima(h, 8)).tolist() == want


def test_shared_stretch_is_found():
    rng = random.Random(5)
    for _ in range(50):
        stretch = words(rng, 20, "abcdefghijklmnop")[:fp.K + fp.W - 1]
        a, b = (words(rng, 30, "qrstuvwxyz") + stretch + words(rng, 30, "qrstuvwxyz") for _ in range(2))
        assert set(fp.fingerprint(a)[0].tolist()) & set(fp.fingerprint(b)[0].tolist())


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    out = []
    for n, (i, t) in enumerate(order):
        t, following = t or "", order[(n + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 3] + following[:len(t) // 3]
        a, b, c = (fp.fingerprint(x) for x in (t, edited, following))
        like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if len(x) or len(y) else 1.0
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.digest(*a), fp.digest(*b), round(like(a[0], b[0]), 9), round(like(a[0], c[0]), 9)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(7)
    for rows in (texts(), [(5, "only one")], [(None, "x"), (None, "y"), (None, None)], [(i, words(rng, 60)) for i in range(900)]):
        got = [(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.walked(docs(spark, rows)).collect()]
        assert sorted(got, key=str) == brute(rows)
    assert fp.walked(docs(spark, [])).count() == 0


def test_positions_are_kept(spark):
    for r in fp.fingerprints(docs(spark)).collect():
        assert len(r.hashes) == len(r.positions) and r.positions == sorted(set(r.positions))
