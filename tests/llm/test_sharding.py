"""Balance, slots, whole rows, hot groups."""

import random
import zlib

import pytest
from fixtures_llm import docs, texts, words

from testsieve.llm import sharding


def check(rows, got, n):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    total, largest = {}, max(r.size for r in got)
    for s in range(n):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        total[s] = sum(r.size for r in own)
    assert max(total.values()) - min(total.values()) <= 2 * largest + 0.02 * sum(total.values()) / n
    return total


@pytest.mark.parametrize("hot", [0, 400])
def test_balance(spark, hot):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(1, 60))) for i in range(800)] + [(1000 + i, "one hot text " * 12) for i in range(hot)]
    got = sharding.shards(docs(spark, rows), 8).collect()
    check(rows, got, 8)
    by = {}
    for r in got:
        by.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in by.values()) <= 8  # groups are cut at shard boundaries only


def test_edge_cases(spark):
    rows = texts()
    check(rows, sharding.shards(docs(spark, rows), 3).collect(), 3)
    assert sharding.shards(docs(spark, [])).count() == 0
    one = sharding.shards(docs(spark, [(1, None)])).collect()
    assert [(r.size, r.slot) for r in one] == [(1, 0)]
