"""Order 3 against brute force: contexts of two words, chained failure arcs."""

import collections
import math

import numpy as np
import pytest
from fixtures_llm import docs
from test_lm_score import held, tokens

from testsieve.llm import lm_score

TEXTS = ["the cat sat on the mat", "the cat sat on a hat", "a cat ran", "the cat ran on the mat", "a hat", "", None, "cat sat"]
ROWS = [(i, TEXTS[i % len(TEXTS)] if i % 3 else f"{TEXTS[i % 5]} w{i % 7}") for i in range(60)]


def model():
    counts = {n: collections.Counter() for n in (1, 2, 3)}
    train = [t for i, t in ROWS if not held(i)]
    for t in train:
        w = [0, *tokens(t)]
        for n in counts:
            counts[n].update(tuple(w[i - n + 1:i + 1]) for i in range(max(1, n - 1), len(w)))
    stats = {}
    for n, c in counts.items():
        s = np.zeros(132)
        s[:4] = [sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values()), len(c), sum(c.values())]
        for g, v in c.items():
            if n == 1 or g[-1] is not None:
                s[4 + int(math.log2(v))] += 1
                s[68 + int(math.log2(v))] += v
        stats[n] = s
    return counts, lm_score.Smoothing(stats, len(train), 3), len(train)


def test_order_three_equals_brute_force(spark):
    counts, smoothing, texts = model()
    total, kinds = sum(counts[1].values()), len(counts[1])

    def p(w, h):
        """Probability and failure arcs of a token behind up to two words."""
        if not h:
            c = counts[1][w,]
            return (c - smoothing.d1 if c else smoothing.d1 * kinds) / total, 0
        n, c = len(h) + 1, texts if h == (0,) else counts[len(h)][h]
        left = min(smoothing.discounts[n] * c ** (smoothing.growths[n] - 1), 1) if c else 1.0
        short, failures = p(w, h[1:])
        met = counts[n][(*h, w)]
        return left * short + ((1 - left) * met / c if c else 0), failures + (met == 0)

    got = {r.doc_id: r for r in lm_score.scored(docs(spark, ROWS), 3).collect()}
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        w = [0, *tokens(t)]
        steps = [p(w[k], tuple(w[max(0, k - 2):k])) for k in range(1, len(w))]
        assert got[i].score == pytest.approx(sum(math.log10(s[0]) for s in steps))
        assert got[i].n_failures == sum(s[1] for s in steps)
    # behind two known words the probabilities add up to 1
    for h in [("the", "cat"), (0, b"the"), (b"the", b"cat")]:
        assert sum(p(w, h)[0] for (w,) in counts[1]) + p("never seen", h)[0] == pytest.approx(1)


def test_the_query_reads_two_words_back(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "table", lambda *_: docs(spark, ROWS))
    got = {r.doc_id: r.score for r in lm_score.op1_lm_score(spark, "").collect()}
    three = {r.doc_id: r.score for r in lm_score.scored(docs(spark, ROWS), 3).collect()}
    two = {r.doc_id: r.score for r in lm_score.scored(docs(spark, ROWS), 2).collect()}
    assert got == pytest.approx(three) and got != pytest.approx(two)
