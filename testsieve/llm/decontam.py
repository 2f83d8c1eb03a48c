"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

A window is ``WINDOW`` neighbouring words of a benchmark item (a shorter item is one
window). Words of the corpus are counted for the benchmark's vocabulary; each window is
then looked up by its two rarest words. The index stores the postings (term, document,
position) of those words; every posting less its word's place in the item gives the offset
at which the item would lie in the document, and the lists of the two words are intersected
on (document, item, offset). What is left is compared word by word with the document's
own words, which makes phrases exact; ``near_matches`` gives proximity matches.

The benchmark's tables are broadcast if a count shows that they are small, and joined by
shuffle otherwise; so are the documents' surviving offsets.

Defined results: null text has no words; items without words are ignored; repeated items
count once; repeated documents are rows of their own; null ids are kept (a null item_id is
left out of the list of items but counts as an item); empty tables give no rows or no
hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.llm.common import table, written

WINDOW = 10
SMALL_ROWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased (and no other letter)."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(low, F.lit("")), SEPARATORS), lambda w: w != "")


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``rows`` rows; Spark's own choice of join beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k (names id and text together) and words of every document."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), words(F.col("text")).alias("words"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, item_id, words, span of every item that has words (item: a number of its own)."""
    rows = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    return rows.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.least(F.size("words"), F.lit(WINDOW)).alias("span"))


def rarest(items: DataFrame, frequency: DataFrame, n: int = 2) -> DataFrame:
    """item, start, places: for each window that can occur the places of its ``n`` rarest words."""
    places = items.select("item", "span", F.size("words").alias("size"), F.posexplode("words").alias("place", "term")).join(frequency, "term", "left")
    starts = places.select(
        "item", "place", "term", F.coalesce("df", F.lit(0)).alias("df"), "span",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("span") + 1), F.least(F.col("place"), F.col("size") - F.col("span")))).alias("start"))
    by = starts.groupBy("item", "start").agg(F.sort_array(F.collect_list(F.struct("df", "place", "term"))).alias("ws"))
    return by.filter(F.col("ws")[0]["df"] > 0).select("item", "start", F.slice("ws", 1, n).alias("rare"))


def build_index(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings: term, k, pos; windows: item, start, rare), both written to the shared folder."""
    terms = items.select(F.explode("words").alias("term")).distinct()
    corpus = keyed(docs)
    frequency = corpus.select(F.explode("words").alias("term")).join(small(terms), "term").groupBy("term").agg(F.count("*").alias("df"))
    frequency = written(frequency, "decontam-frequency")
    windows = written(rarest(items, frequency), "decontam-windows")
    used = windows.select(F.explode("rare.term").alias("term")).distinct()
    postings = corpus.select("k", F.posexplode("words").alias("pos", "term")).join(small(used), "term").select("term", "k", "pos")
    return written(postings, "decontam-postings"), windows


def offsets(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """k, item, at: offsets at which all the rare words of some window of the item stand."""
    rare = windows.select("item", F.explode("rare").alias("r")).select("item", F.col("r.place").alias("place"), F.col("r.term").alias("term")).distinct()
    met = postings.join(small(rare), "term").select("k", "item", (F.col("pos") - F.col("place")).alias("at"), "place")
    met = met.groupBy("k", "item", "at").agg(F.collect_set("place").alias("met"))
    needed = windows.groupBy("item").agg(F.collect_set(F.col("rare.place")).alias("needed"))
    both = met.join(small(needed), "item")
    return both.filter(F.exists("needed", lambda w: F.size(F.array_except(w, F.col("met"))) == 0)).select("k", "item", "at")


def phrase_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, k, n_words and matches (item_id, hits: positions of the document's words inside
    occurrences of the item's windows) of every document."""
    items = written(items_of(benchmark), "decontam-items")
    postings, windows = build_index(docs, items)
    survivors = offsets(postings, windows).join(small(items), "item")
    survivors = survivors.groupBy("k").agg(F.collect_list(F.struct("item", "item_id", "words", "span", "at")).alias("found"))
    survivors = written(survivors, "decontam-survivors")

    def hits(f: Column) -> Column:
        """Positions in the document that lie in a window of the item laid at offset ``at``."""
        n, span = F.size(f["words"]), f["span"]
        same = F.transform(f["words"], lambda w, p: F.coalesce(F.get(F.col("words"), f["at"] + p) == w, F.lit(False)))
        starts = F.filter(F.sequence(F.lit(0), n - span), lambda s: F.forall(F.slice(same, s + 1, span), lambda x: x))
        return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(f["at"] + s, f["at"] + s + span - 1))))

    found = keyed(docs).join(small(survivors), "k", "left")
    matches = F.filter(F.transform(F.coalesce("found", F.array().cast(survivors.schema["found"].dataType)), lambda f: F.struct(
        f["item"].alias("item"), f["item_id"].alias("item_id"), hits(f).alias("hits"))), lambda m: F.size(m["hits"]) > 0)
    return found.select("doc_id", "k", F.size("words").cast("long").alias("n_words"), matches.alias("matches"))


def near_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 5) -> DataFrame:
    """doc_id, item_id, start, pos, distance: windows whose two rarest words stand in a
    document in their order's distance give or take ``slop`` words (0: as in the window)."""
    items = written(items_of(benchmark), "decontam-items")
    postings, windows = build_index(docs, items)
    two = windows.filter(F.size("rare") == 2).select("item", "start", *[F.col("rare")[i][c].alias(f"{c}{i}") for i in (0, 1) for c in ("term", "place")])
    a = postings.join(small(two), F.col("term") == F.col("term0")).select("k", "item", "start", "place0", "place1", "term1", F.col("pos").alias("pos0"))
    b = postings.select("k", F.col("term").alias("term1"), F.col("pos").alias("pos1"))
    off = F.abs((F.col("pos1") - F.col("pos0")) - (F.col("place1") - F.col("place0")))
    near = a.join(b, ["k", "term1"]).filter(off <= slop).select("k", "item", "start", (F.col("pos0") - F.col("place0") + F.col("start")).alias("pos"), off.alias("distance"))
    ids = docs.select(F.xxhash64("doc_id", "text").alias("k"), "doc_id").distinct()
    return near.join(small(items.select("item", "item_id")), "item").join(ids, "k").select("doc_id", "item_id", "start", "pos", "distance")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, k (hash of id and text), n_words, n_hit, n_items, item_ids (sorted as strings)
    of every document."""
    m = phrase_matches(docs, benchmark)
    ids = F.array_compact(F.transform("matches", lambda x: x["item_id"].cast("string")))
    return m.select(
        "doc_id", "k", "n_words", F.size(F.array_distinct(F.flatten("matches.hits"))).cast("long").alias("n_hit"),
        F.size(F.array_distinct(F.col("matches.item_id"))).cast("long").alias("n_items"), F.array_sort(F.array_distinct(ids)).alias("item_ids"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (
  SELECT item_id, ws, least(len(ws), 10) AS span FROM (
    SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark) WHERE len(ws) > 0),
w AS (
  SELECT DISTINCT item_id, span, array_to_string(ws[s:s + span - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, span, unnest(range(1, len(ws) - span + 2)) AS s FROM b)),
spans AS (SELECT DISTINCT span FROM w),
p AS (
  SELECT doc_id, span, i, array_to_string(ws[i:i + span - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, span, unnest(range(1, len(ws) - span + 2)) AS i FROM d, spans WHERE len(ws) >= span)),
h AS (SELECT doc_id, item_id, i, p.span FROM p JOIN w ON p.span = w.span AND p.phrase = w.phrase),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
       FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
