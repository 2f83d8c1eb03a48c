"""Registered queries against their SQL, the contract's columns, and the pipeline's stages."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline  # noqa: E402
from fixtures_llm import save  # noqa: E402
from oracle_check import canon, duck  # noqa: E402

from testsieve.llm import registry  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id held_out n_tokens n_known train_tokens base_score score", 2: "doc_id n_words n_hit n_items items_sha256 contaminated",
    3: "doc_id piece start length ids_crc32 sequence_id offset", 4: "doc_id held_out score predicted", 5: "doc_id n_bytes n_tokens over_limit",
    6: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", 7: "doc_id n_shingles component_id kept", 8: "doc_id held_out score predicted",
    9: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", 10: "doc_id size text_crc32 law shard slot grown_shard",
    11: "vec_id cluster distance cluster_inertia inertia centroid_sha256", 12: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    13: "doc_id n_bytes n_removed n_spans kept_sha256"}


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_columns_and_rows(spark, name):
    df = registry.QUERIES[name](spark, SF)
    n = int(name[2:].split("_")[0])
    assert df.columns[:len(COLUMNS[n].split())] == COLUMNS[n].split()
    if n not in (3, 6, 11, 12):
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(SF).execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canon(df.columns, rows) == canon(names, cur.fetchall())


def test_pipeline_stages(spark, tmp_path):
    """Planted cases: a toxic text, a copy, a near copy and a benchmark passage go; extra
    columns pass through; every text that goes on is packed."""
    tables = {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    d = tables["documents"]
    passage = tables["benchmark"].orderBy("item_id").first().text
    clean = next(r for r in d.orderBy("doc_id").collect() if r.lang == "en" and 100 < len(r.text.split()) < 400 and r.doc_id > 100)
    w = clean.text.split(" ")
    # the smallest ids stay, so what is planted has larger ones
    planted = [(9_000_001, clean.text), (9_000_002, " ".join(w[:-1] + ["other"])), (9_000_003, " ".join(reversed(w)) + " " + passage), (9_000_004, " ".join(w[::2])), (9_000_004, " ".join(w[::2]))]
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in planted], d.schema)
    save(d.unionByName(more).withColumn("k", d["source"]), tmp_path, "documents")
    save(tables["labels"], tmp_path, "labels")
    save(tables["benchmark"], tmp_path, "benchmark")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "keep_quality", "keep_one_of_each", "drop_contaminated", "pack"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "packing":
            assert docs.columns == columns and docs.join(before, columns, "left_anti").count() == 0
    labels = {r.doc_id: r for r in tables["labels"].collect()}
    gone = {r.doc_id for r in d.collect()} - set(left["toxicity"])
    assert sum(labels[i].toxic == 0 for i in gone if i in labels) <= 2
    kept = set(left["toxicity"]) - set(left["quality"])
    assert sum(labels[i].quality == 1 for i in kept if i in labels) <= 2
    if 9_000_001 in left["quality"] and clean.doc_id in left["quality"]:
        assert 9_000_001 not in left["near-dedup"]
    if 9_000_002 in left["quality"]:
        assert 9_000_002 not in left["near-dedup"]
    assert left["near-dedup"].count(9_000_004) <= 1
    assert 9_000_003 not in left["decontamination"]
    assert set(left["packing"]) == set(left["decontamination"])


def test_pipeline_of_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        save(spark.read.parquet(f"{SF}/{t}.parquet").limit(0), tmp_path, t)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
