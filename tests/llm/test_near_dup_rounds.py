"""Rounds of near-duplicate search: components go on from the last ones, the driver drops what ended."""

from fixtures_llm import docs

from testsieve.llm import near_dup

BASE = [f"w{i}" for i in range(120)]
#: A chain of texts, of which each is linked with its neighbours only, and texts apart.
CHAIN = [(i, " ".join(f"x{i}" if j // 5 == i else w for j, w in enumerate(BASE))) for i in range(12)]


def test_components_go_on_from_the_last_ones(spark, monkeypatch):
    calls, dropped, whole = [], [], near_dup.components

    def watched(links):
        out = whole(links)
        calls.append(({tuple(r) for r in links.select("a", "b").collect()}, {tuple(r) for r in out.select("node", "root").collect()}))
        return out

    monkeypatch.setattr(near_dup, "components", watched)
    monkeypatch.setattr(near_dup, "drop_garbage", dropped.append)
    rows = near_dup.near_duplicates(docs(spark, CHAIN + [(50 + i, f"apart {i} " * 9) for i in range(5)])).collect()
    assert {r.component_id for r in rows if r.doc_id < 12} == {0} and len({r.component_id for r in rows}) == 6
    assert dropped
    # a crowd's components are a call of their own
    assert len(calls) > 1 and any(before and before <= links for (_, before), (links, _) in zip(calls, calls[1:]))


def test_components_of_stars_and_new_links(spark):
    links = spark.createDataFrame([(3, 1), (4, 3), (8, 7), (9, 8)], "a bigint, b bigint")
    first = near_dup.components(links)
    again = near_dup.components(spark.createDataFrame([(9, 4)], "a bigint, b bigint").unionByName(first.toDF("a", "b")))
    assert {tuple(r) for r in again.collect()} == {(n, 1) for n in (1, 3, 4, 7, 8, 9)}
