"""Held-out accuracy of both classifiers, and their edge cases."""

import pytest
from fixtures_llm import docs
from pyspark.sql import functions as F

from testsieve.llm import quality, registry, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, good", [("op4_toxicity", "toxic", 0.9), ("op8_quality", "quality", 0.95)])
def test_held_out(spark, name, label, good):
    out = registry.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    held = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    rows = held.select("score", "predicted", label).collect()
    assert out.count() == n and sum(r[1] == r[2] for r in rows) / len(rows) >= good
    low, high = out.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1


ROWS = [(i, ("you vile clod " if i % 2 else "a kind word ") + "of text " * (i % 7)) for i in range(60)] + [
    (400, None), (401, ""), (402, "x" * 50_000), (0, "repeated id"), (0, "repeated id"), (None, "vile clod")]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, label int")


@pytest.mark.parametrize("train, score, keep", [(toxicity.train, toxicity.scored, toxicity.clean), (quality.train, quality.scored, quality.good)])
def test_edge_cases(spark, train, score, keep):
    d = docs(spark, ROWS)
    model = train(d, labels(spark, [(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (999, 1), (6, 1)]))
    got = score(d, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert min(by[i] for i in range(1, 60, 2)) > max(by[i] for i in range(2, 60, 2) if i != 6)
    assert keep(d, model, 0.5).columns == d.columns
    assert score(docs(spark, []), model).count() == 0 and keep(docs(spark, []), model, 0.5).count() == 0


@pytest.mark.parametrize("train, score, none", [(toxicity.train, toxicity.scored, 0.0), (quality.train, quality.scored, 0.5)])
def test_without_labels_or_with_one_class(spark, train, score, none):
    d = docs(spark, ROWS)
    assert {round(r.score, 6) for r in score(d, train(d, labels(spark, []))).collect()} == {none}
    assert {round(r.score, 6) for r in score(d, train(d, labels(spark, [(1, 1), (2, 1)]))).collect()} == {1.0}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_training_is_bounded_in_rows(spark, module, monkeypatch):
    """An id that stands in many rows brings at most ``max_train`` rows to the fit; repeated rows
    teach once, and the same rows teach whatever their order."""
    seen = []
    if module is toxicity:
        given = toxicity.learnt
        monkeypatch.setattr(toxicity, "learnt", lambda sample, *a: seen.append(sample.count()) or given(sample, *a))
    else:
        given = quality.Network
        monkeypatch.setattr(quality, "Network", lambda x, y, *a: seen.append(len(y)) or given(x, y, *a))
    rows = [(i % 2, ("vile clod " if i % 2 else "kind word ") * (1 + i // 2)) for i in range(300)]
    own = labels(spark, [(0, 0), (1, 1)])
    for given_rows in (rows, rows[::-1] + rows):
        module.train(docs(spark, given_rows), own, max_train=100)
        module.train(docs(spark, given_rows), own, max_train=1000)
    assert seen == [100, 300, 100, 300]


def test_few_labels_of_both_classes_train(spark):
    """No least number of labels: a few rows of both classes already tell texts apart."""
    for module in (toxicity, quality):
        d = docs(spark, ROWS[:12])
        extra = {"least_docs": 1, "least_ratio": 0.5} if module is toxicity else {}
        model = module.train(d, labels(spark, [(i, i % 2) for i in range(1, 7)]), **extra)
        by = {r.doc_id: r.score for r in module.scored(d, model).collect()}
        assert min(by[i] for i in range(1, 12, 2)) > max(by[i] for i in range(2, 12, 2))
