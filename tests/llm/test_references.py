"""Operators 4, 8 and 10 against independent small versions."""

import random

import numpy as np
import pytest
from fixtures_llm import docs, texts, words

from testsieve.llm import quality, sharding, toxicity


def test_shards_against_plain_counting(spark):
    """Every row once, sizes as Python counts them, shards in the order of the ranges, slots
    gapless, near equal bytes, small groups of equal texts in one shard."""
    rng = random.Random(4)
    rows = texts() + [(5000 + i, words(rng, rng.randrange(1, 60))) for i in range(800)] + [(9000 + i, "one text of many rows") for i in range(5)]
    got = sharding.shards(docs(spark, rows), 8).collect()
    plain = sorted(((i, len((t or "").encode()) + 1) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r["size"]) for r in got), key=str) == plain
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    total, biggest = sum(s for _, s in plain), max(s for _, s in plain)
    assert set(by) == set(range(8))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r["size"] for r in rs) - total / 8) <= biggest + 0.02 * total / 8
    assert len({r.shard for r in got if r.doc_id is not None and 9000 <= r.doc_id < 9005}) == 1
    assert max(r.range for r in by[0]) <= min(r.range for r in by[7])


def plain_grams(text):
    t = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    t = " " + "".join(" " if c in "\t\n\v\f\r" else c for c in t) + " "
    return {t[i:i + n] for n in toxicity.SIZES for i in range(len(t) - n + 1)}


def test_toxicity_features_and_scores(spark):
    """The features of a text are its distinct n-grams, and a score is the logistic function of
    the sum of their weights."""
    rng = random.Random(6)
    some = [words(rng, rng.randrange(1, 12)) for _ in range(200)] + ["", "ÄÖ ß 日本\n x"]
    bad = [f"{t} vile scum" for t in some[:60]]
    import pyarrow as pa
    from testsieve.llm.common import text_slices
    for first, data, offsets in text_slices(pa.array(some)):
        doc, _ = toxicity.present(data, offsets)
        counts = np.bincount(doc, minlength=len(offsets) - 1)
        for j, n in enumerate(counts):
            own = len(plain_grams(some[first + j]))
            assert n <= own and own - n <= max(1, own * own // (1 << toxicity.FEATURE_BITS))
    rows = [(i, t) for i, t in enumerate(some + bad)]
    labels = spark.createDataFrame([(i, int(i >= len(some))) for i, _ in rows], "doc_id bigint, label int")
    model = toxicity.train(docs(spark, rows), labels)
    ids, weights, bias = model
    weight = dict(zip(ids.tolist(), weights.tolist()))
    got = {r.doc_id: r.score for r in toxicity.scored(docs(spark, rows), model).collect()}
    for i, t in rows[::17]:
        _, feature = toxicity.present(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        z = bias + sum(weight.get(f, 0.0) for f in feature.tolist())
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-5)


def test_quality_scores_from_pooled_vectors(spark):
    """A score is the network's calibrated output for the mean and spread of the text's word
    vectors, pooled here word by word."""
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randrange(5, 40), "abcd" if i % 2 else "wxyz")) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, label int")
    vectors, network = quality.train(docs(spark, rows), labels)
    got = {r.doc_id: r.score for r in quality.scored(docs(spark, rows), (vectors, network)).collect()}
    assert sum((got[i] >= 0.5) == bool(i % 2) for i, _ in rows) >= 114
    for i, t in rows[::13]:
        data = np.frombuffer(t.encode(), np.uint8)
        w, _ = quality.words(data, np.array([0, len(data)]))
        x = vectors[w].astype(np.float64)
        pooled = np.concatenate([x.mean(0), x.std(0), [np.log1p(len(w))]])[None]
        assert got[i] == pytest.approx(float(network.score(pooled)[0]), abs=2e-3)
