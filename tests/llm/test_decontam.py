"""Phrase matches against brute force, proximity, edge cases."""

import random
import re

from fixtures_llm import docs, texts, words

from testsieve.llm import decontam


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(rows, items):
    out = []
    for i, t in rows:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            v = split(text)
            n = min(len(v), 10)
            for s in range(len(v) - n + 1) if n else []:
                for at in range(len(w) - n + 1):
                    if w[at:at + n] == v[s:s + n]:
                        hit |= set(range(at, at + n))
                        ids.add(item)
        out.append((i, len(w), len(hit), len(ids), sorted(str(x) for x in ids if x is not None)))
    return out


def run(spark, rows, items):
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id bigint, text string, term string, k string")
    out = decontam.contamination(docs(spark, rows), bench).drop("k")
    return sorted([tuple(r) for r in out.collect()], key=str)


def test_equals_brute_force(spark):
    rows = texts()
    rng = random.Random(5)
    passage = dict((i, t) for i, t in rows if i)[300]
    items = [(1, passage), (1, passage), (2, words(rng, 30)), (3, "One"), (4, None), (5, " .,;"), (6, "a a a a a a a a a a a"),
             (None, "one two"), (7, passage + " more"), (8, "é ß")]
    rows = rows + [(500, "a " * 15), (501, "x " * 3 + passage + " " + passage), (502, "b a a a a a a a a a a a b")]
    assert run(spark, rows, items) == sorted(brute(rows, items), key=str)


def test_random_small_alphabet(spark):
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randint(0, 60), "ab")) for i in range(40)]
    items = [(i, words(rng, rng.randint(0, 14), "ab")) for i in range(10)]
    assert run(spark, rows, items) == sorted(brute(rows, items), key=str)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, 0, [])]


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    rows, items = [(i, words(rng, 50, "abc")) for i in range(10)], [(i, words(rng, 4, "abc")) for i in range(6)]
    want = run(spark, rows, items)
    monkeypatch.setattr(decontam, "small", lambda df, rows=0: df)
    assert run(spark, rows, items) == want


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "p q r s t")], "item_id bigint, text string")
    rows = [(1, "p q r s t"), (2, "p q z r s t"), (3, "p z z z z z z z z z q r s t z z p"), (4, "t s r q p")]
    near = decontam.near_matches(docs(spark, rows), bench, slop=1).select("doc_id", "distance").distinct().collect()
    assert {(r.doc_id, r.distance) for r in near if r.doc_id == 1} == {(1, 0)}
    assert {r.doc_id for r in near} >= {1, 2} and 4 not in {r.doc_id for r in near if r.distance == 0}


def test_main_path_has_no_python(spark):
    bench = spark.createDataFrame([(1, "p q r")], "item_id bigint, text string")
    plan = decontam.contamination(docs(spark, [(1, "p q r")]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("LogicalRDD", "") or "MapIn" not in plan
    assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups"))
