"""Counts and the base score against brute force; the model against its definition."""

import collections
import math
import zlib

import numpy as np
import pytest
from fixtures_llm import docs, texts

from testsieve.llm import lm_score


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def test_scores_equal_brute_force(spark):
    rows = texts()
    got = collections.defaultdict(list)
    for r in lm_score.scored(docs(spark)).collect():
        got[r.doc_id].append(r)
    one, two = collections.Counter(), collections.Counter()
    train = [t for i, t in rows if not held(i)]
    for t in train:
        w = tokens(t)
        one.update(w)
        two.update(zip([0] + w[:-1], w))
    total, kinds = sum(one.values()), len(one)
    n = collections.Counter(one.values()), collections.Counter(two.values())
    d1, d2 = (c[1] / (c[1] + 2 * c[2]) for c in n)
    stats = {}
    for k, c in ((1, one), (2, two)):
        s = np.zeros(132)
        s[:4] = [sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values()), len(c), sum(c.values())]
        for v in c.values():
            s[4 + int(math.log2(v))] += 1
            s[68 + int(math.log2(v))] += v
        stats[k] = s
    g = lm_score.Smoothing(stats, len(train)).growth

    def p(w, h):
        single = (one[w] - d1) / total if one[w] else d1 * kinds / total
        c = len(train) if h == 0 else one[h]
        left = min(d2 * c ** (g - 1), 1) if c else 1.0
        return left * single + ((1 - left) * two[h, w] / c if c else 0)

    for i, t in rows:
        w = tokens(t)
        r = min(got[i], key=lambda r: abs(r.n_tokens - len(w)))
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(i), len(w), total)
        same = [r for r in got[i] if r.n_tokens == len(w)]
        base = sum(math.log10((one[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        score = sum(math.log10(p(x, h)) for h, x in zip([0] + w[:-1], w))
        assert any(r.base_score == pytest.approx(base) and r.score == pytest.approx(score) and r.n_known == sum(one[x] > 0 for x in w) for r in same)
    assert len([r for g_ in got.values() for r in g_]) == len(rows)
    # probabilities behind a known word add up to 1 over the known tokens and the unknown class
    h = next(x for x in one if x)
    assert sum(p(x, h) for x in one) + p("never seen", h) == pytest.approx(1)


def test_empty_table_and_no_training_rows(spark):
    assert lm_score.scored(docs(spark, [])).count() == 0
    out = [i for i in range(200) if held(i)][:3]
    r = lm_score.scored(docs(spark, [(i, "a b") for i in out])).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.score) for x in r] == [(3, 0, 0, 0.0)] * 3
