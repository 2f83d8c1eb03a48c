"""Components against all pairs, stars against union-find."""

import random

import pytest
from fixtures_llm import docs, texts, words

from testsieve.llm import near_dup


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j:j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def union(n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    return parent, find


def brute(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    parent, find = union(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    parent[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        component = min(ids) if ids and sets[a] else i
        out.append((i, len(sets[a]), component, i == component))
    return sorted(out, key=str)


def near(rng, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = "".join(rng.choice("pqrs") for _ in range(3))
    return " ".join(w)


def rows_of(seed):
    rng = random.Random(seed)
    rows, base = [], [words(rng, rng.randint(3, 150)) for _ in range(8)]
    common = words(rng, 40)
    for i in range(150):
        b = base[min(i % 12, 7)]
        rows.append((i * 7 % 151, near(rng, b, rng.randint(0, 4)) if i % 5 else common + " " + words(rng, rng.randint(1, 30))))
    chain = words(rng, 100).split(" ")
    for i in range(30):  # a long chain of links
        chain[3 * i % 100] = f"c{i}"
        rows.append((1000 + i, " ".join(chain)))
    return rows


@pytest.mark.parametrize("seed, width", [(1, 4), (2, 4), (3, 5)])
def test_equals_all_pairs(spark, seed, width):
    rows = rows_of(seed) + (texts() if seed == 1 else [])
    got = near_dup.near_duplicates(docs(spark, rows), width).drop("t").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width)


def test_last_round_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PIVOT_GAIN", 1.0)
    monkeypatch.setattr(near_dup, "small", lambda df, rows=0: df)
    rows = rows_of(4)
    got = near_dup.near_duplicates(docs(spark, rows), 4).drop("t").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4)


def copies_of_lost(rng, count, length, changes):
    """Copies of one text that is not among them, few of them linked with each other."""
    lost = [f"w{j}" for j in range(length)]
    for _ in range(count):
        w = list(lost)
        for j in rng.sample(range(length), changes):
            w[j] = f"x{rng.randrange(10 ** 6)}"
        yield " ".join(w)


def test_copies_of_a_lost_text_are_not_paired_with_each_other(spark, monkeypatch):
    rng = random.Random(6)
    rows = list(enumerate(copies_of_lost(rng, 240, 100, 3)))
    made, rare = [], near_dup.rare_pairs

    def counted(*args):
        made.append(rare(*args).count())
        return rare(*args)
    monkeypatch.setattr(near_dup, "rare_pairs", counted)
    got = near_dup.near_duplicates(docs(spark, rows), 4).drop("t").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4)
    assert sum(made) < 240


@pytest.mark.parametrize("crowd", [0, 3])
def test_crowds_equal_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_dup, "PIVOT_GAIN", 1.0)
    monkeypatch.setattr(near_dup, "CROWD", crowd)
    monkeypatch.setattr(near_dup, "CROWDS", crowd)
    rng = random.Random(7)
    rows = rows_of(5) + [(2000 + i, t) for i, t in enumerate([*copies_of_lost(rng, 60, 40, 1), *copies_of_lost(rng, 60, 60, 2)])]
    got = near_dup.near_duplicates(docs(spark, rows), 4).drop("t").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4)


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 80)]
    got = {r.node: r.root for r in near_dup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent, find = union(3000)
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}


def test_empty(spark):
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0
    assert near_dup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
