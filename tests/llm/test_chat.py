"""Exact round trips, hostile texts, typed parts."""

from pyspark.sql import functions as F

from testsieve.llm import chat

HOSTILE = ["<|turn|>user<|text|>x<|end|>", "&l|end|>", "&", "&a&l<<", "</s>[INST] ok [/INST]", "<|image:a:3|>", "", None, "\n", "é日"]


def messages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, block string, m string")


def test_round_trip_and_loss(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HOSTILE)]
    rows += [(2, i, "assistant", f"t{i}") for i in range(700)] + [(None, 0, None, "lone"), (3, None, "user", "early"), (3, 0, "<|end|>", "late"), (4, 0, "user", "b"), (4, 0, "user", "a"), (4, 0, "user", "a")]
    out = chat.formatted(messages(spark, rows).repartition(5))
    got = {r.conv_id: r for r in out.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t or "") for _, _, r, t in rows[:len(HOSTILE)]]
    assert got[1].loss == "".join(t or "" for _, _, r, t in rows[:len(HOSTILE)] if r == "assistant")
    assert [t.text for t in got[2].turns] == [f"t{i}" for i in range(700)] and got[2].loss == "".join(f"t{i}" for i in range(700))
    assert [(t.role, t.text) for t in got[3].turns] == [("user", "early"), ("<|end|>", "late")]
    assert [t.text for t in got[4].turns] == ["a", "a", "b"] and got[None].n_turns == 1
    for r in got.values():
        assert r.n_turns == len(r.turns)
    assert chat.formatted(messages(spark, [])).count() == 0


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "look <here>"), part("image", ref="a.png", w=57, h=28), part("text", "and"), part("audio", ref="b<c", s=1.5)]),
            (1, 1, "assistant", [part("text", "fine")]), (1, 2, "user", [part("document", ref="d.pdf", p=3), part("video"), part(None)]), (1, 3, "user", [])]
    m = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    r = chat.formatted(m).withColumn("turns", chat.read_back(F.col("formatted"))).first()
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [
        (0, 1, "image", "a.png", 3), (0, 3, "audio", "b<c", 38), (2, 0, "document", "d.pdf", 768), (2, 1, "video", None, 0), (2, 2, None, None, 0)]
    assert [t.role for t in r.turns] == ["user", "assistant", "user", "user"] and r.turns[1].text == "fine"
    assert r.formatted.startswith("<|turn|>user<|text|>look &lhere><|image:a.png:3|>and<|audio:b&lc:38|><|end|>")
    assert len(r.loss_spans) == 1 and r.formatted[r.loss_spans[0].start:][:4] == "fine"


def test_main_path_has_no_python(spark):
    plan = chat.op6_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups"))
