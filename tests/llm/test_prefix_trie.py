"""The trie against a dictionary of prefixes, subtree totals against plain recursion."""

import hashlib
import random
import zlib

import pytest

from testsieve.llm import prefix_trie


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, id string, path string, depth int").repartition(4)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [m[2:] for m in sorted(ms)] for c, ms in own.items()}
    members, ends = {}, {}
    for c, ms in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])
        built = tuple(base[:h] + ms[h:])
        for d in range(len(built) + 1):
            members.setdefault(built[:d], []).append(c)
        ends.setdefault(built, []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if k in kids else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids.get(k, []))
    return sorted([(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items()], key=str)


def rows_of(seed):
    rng = random.Random(seed)
    rows, said = [], ["hi", "yes", "no", "", None, "ß 日本"]
    for c in range(-7, 60):
        for turn in range(rng.randrange(1, 14)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(said[:2 + c % 4])))
    for c in range(100, 130):  # copies
        rows += [(c, t, "user", f"copy {t}") for t in range(12)]
    rows += [(200, None, None, "first"), (200, None, "user", None), (200, 3, "a", "b"), (200, 3, "a", "b"), (200, 3, "a", "a"), (None, 1, "user", "nobody"), (201, 0, None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_prefixes(spark, seed):
    rows = rows_of(seed)
    got = prefix_trie.prefix_trie(frame(spark, rows)).drop("id", "parent").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_long_conversations_and_equal_turns(spark):
    rows = [(5, t, "user", f"t{t}") for t in range(2500)] + [(6, t, "user", f"t{t}" if t < 1700 else f"u{t}") for t in range(2400)]
    rows += [(10, None, "user", "same")] * 700
    got = prefix_trie.prefix_trie(frame(spark, rows)).drop("id", "parent").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def plain(parents, values):
    total = dict(values)
    for k in sorted(parents, reverse=True):  # children have larger numbers
        if parents[k] is not None:
            total[parents[k]] += total[k]
    return total


@pytest.mark.parametrize("shape", ["random", "comb", "steps", "star"])
def test_contraction(spark, shape, monkeypatch):
    """Trees whose chains cross paths, and chains that are longer than a stretch."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    rng = random.Random(7)
    n = 300
    if shape == "random":
        parents = {i: (None if i == 0 else rng.randrange(max(0, i - 6), i)) for i in range(n)}
    elif shape == "star":
        parents = {i: (None if i == 0 else 0) for i in range(n)}
    else:  # a spine with teeth
        parents = {i: (None if i == 0 else i - 1 if i < 150 else i - 150) for i in range(n)}
    depth = {}
    for i in range(n):
        depth[i] = 0 if parents[i] is None else depth[parents[i]] + 1
    kids = {}
    for i, p in parents.items():
        kids.setdefault(p, []).append(i)
    path = {0: 0}
    for i in range(n):  # one way down, or for steps a path of its own for each node
        for j, k in enumerate(kids.get(i, [])):
            path[k] = k if shape == "steps" or j else path[i]
    values = {i: rng.randrange(100) for i in range(n)}
    rows = [(f"n{i}", None if parents[i] is None else f"n{parents[i]}", depth[i], path[i], len(kids.get(i, [])), values[i]) for i in range(n)]
    nodes = spark.createDataFrame(rows, "id string, parent string, depth bigint, path bigint, n_children bigint, v bigint")
    got = {r.id: r.v for r in prefix_trie.subtree_totals(nodes, ["v"]).collect()}
    assert got == {f"n{i}": t for i, t in plain(parents, values).items()}


def test_empty(spark):
    assert prefix_trie.prefix_trie(frame(spark, []).limit(0)).count() == 0
