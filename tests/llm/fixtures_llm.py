"""Small tables that hold the awkward cases: nulls in every column, empty and long texts,
repeated rows and ids, ties, and columns whose names clash with the operators' own."""

import random

CLASH = ["part", "range", "h", "k", "c", "n", "t", "v", "chunk", "size", "pos", "term", "length", "score", "row", "guest", "label"]


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(n))


def texts(seed=3):
    rng = random.Random(seed)
    base = words(rng, 120)
    passage = words(rng, 15, "xyz")
    out = [(i, words(rng, rng.randint(1, 80))) for i in range(20)]
    out += [(100 + i, base) for i in range(6)]
    for i in range(6):  # near copies: one word changed
        w = base.split(" ")
        w[10 * i + 5] = "changed"
        out.append((200 + i, " ".join(w)))
    out += [(300, passage), (301, "Before " + passage.upper() + " after"), (302, passage.replace(" ", "\n\t"))]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one two"), (405, "ÄÖ é ß 日本 12 's don't"),
            (406, words(rng, 9000)), (407, "a" * 5000), (408, "<|endoftext|> x <|startoftext|>!!<|endoftext|>")]
    out += [(0, out[0][1]), (0, "another text of id 0"), (None, base), (None, None)]
    return out


def docs(spark, rows=None):
    """doc_id, text and clashing extra columns."""
    rows = texts() if rows is None else rows
    extra = ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, *(["x"] * len(CLASH))) for i, t in rows], f"doc_id bigint, text string, {extra}").repartition(3)


def save(frame, folder, name):
    frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
