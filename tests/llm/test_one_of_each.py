"""Near-dedup stage: one row of each group stays, also under repeated and null ids."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from fixtures_llm import docs, words  # noqa: E402


def near(rng):
    w = words(rng, 200).split(" ")
    return " ".join(w), " ".join(w[:-1] + ["changed"])


def test_one_of_near_texts_under_one_id_and_under_null_ids(spark):
    rng = random.Random(5)
    same, null, mixed = near(rng), near(rng), near(rng)
    rows = [(1, same[0]), (1, same[1]), (None, null[0]), (None, null[1]), (None, null[1]), (None, mixed[0]), (7, mixed[1]),
            (3, words(rng, 150)), (3, words(rng, 150)), (4, "short"), (None, "tiny"), (None, None)]
    left = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, docs(spark, rows), "").collect()]
    assert sum(r in left for r in rows[:2]) == 1
    assert sum(r in left for r in rows[2:4]) == 1
    assert [r for r in left if r[1] in mixed] == [(7, mixed[1])]
    assert set(rows[7:]) <= set(left) and len(left) == 8
