"""Prefix trie of rebuilt conversations, its subtree totals by parallel tree contraction.

**Conversations.** Rows are range-partitioned by conversation and turn, so a conversation of any
length lies in blocks; a row's place is its number in the block plus the rows of the blocks
before. Conversation c is rebuilt from the first h turns of c - c % 5 and its own turns from
the h-th on (h = crc32 of its decimal id, modulo 9).

**Nodes.** The key of a prefix is the exclusive-or of the digests (120 bits) of its turns, each
digest taken of role, text and place; equal prefixes have equal keys, and the key of a prefix
one turn shorter follows from it. Prefix keys are running exclusive-ors inside a block, carried
over blocks. Nodes are groups of equal keys.

**Contraction.** Every node has a current parent, a count of current children, what its own
subtree has gathered, and what lies on the edge to its parent. A round rakes (leaves hand their
totals to their parents and leave) and compresses (nodes with one child leave; what they had
moves to the edge above the node that stays). A node's ``path`` is its longest conversation, so
nodes of one path are one way down the tree; a run of one-child nodes of a path inside a stretch
of depths is compressed at once, and the stretches grow with the rounds. A one-child node whose
child is of another path is compressed by coin tosses of the two paths. So the number of rounds
grows with the logarithm of the tree, for long chains too. Then compressed nodes are expanded
again in reverse order, each from the total of the node that stayed below it.

Defined results: rows without conv_id belong to no conversation and are left out; a null turn
comes first; null role or text counts as empty; rows of one turn are ordered by role and text,
repeated rows are kept; a conversation that is rebuilt to no turns is a member of the root; ids
are integers, the remainder has the sign of the id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from testsieve.llm.common import map_arrow, table, written

HEADS = 9
FAMILY = 5
#: A run of one-child nodes is compressed inside stretches of this many depths in the first
#: round, and so many times longer ones in each further round.
STRETCH = 512
#: Ids in a piece of a node's list of ids (whole ranges of so many ids, so a piece is bounded).
PIECE = 4096


def head_turns() -> Column:
    """How many of its first turns a conversation takes from its family's first."""
    return (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, block, place (from 1), digest, bytes of every row."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # equal rows are told apart, so no run of them has to lie in one partition
    rows = rows.withColumn("apart", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("apart"))
    dealt = dealt.withColumn("block", F.spark_partition_id())
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "apart")
    numbered = dealt.withColumn("number", F.row_number().over(inside)).select("conv_id", "block", "number", "digest", F.octet_length("text").cast("long").alias("bytes"))
    numbered = written(numbered, "trie-rows")
    return numbered.join(_before(numbered, F.count("*")), ["conv_id", "block"]).select(
        "conv_id", "block", (F.col("number") + F.col("before")).alias("place"), "digest", "bytes")


def _before(rows: DataFrame, count: Column) -> DataFrame:
    """conv_id, block, before: rows of the conversation in earlier blocks (a row for each block)."""
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("conv_id", "block").agg(count.cast("long").alias("m")).select(
        "conv_id", "block", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, block, depth, digest, bytes) of the rebuilt conversations, and all
    conversations (conv_id, turns)."""
    all_ = rows.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", head_turns()).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    bases = all_.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    all_ = all_.join(bases, "base", "left").select("conv_id", "base", "h", "own", F.least("h", F.coalesce("base_own", F.lit(0))).alias("heads"))
    all_ = written(all_, "trie-conversations")
    # a base is the first of at most FAMILY ids on either side of zero, and gives HEADS - 1 rows to each
    first = rows.filter(F.col("place") < HEADS).select(F.col("conv_id").alias("base"), "place", "digest", "bytes")
    heads = all_.join(first, "base").filter("place <= heads").select("conv_id", F.lit(-1).alias("block"), F.col("place").alias("depth"), "digest", "bytes")
    tails = rows.join(all_.select("conv_id", "h", "heads"), "conv_id").filter("place > h").select(
        "conv_id", "block", (F.col("place") - F.col("h") + F.col("heads")).alias("depth"), "digest", "bytes")
    turns = F.col("heads") + F.greatest(F.lit(0), F.col("own") - F.col("h"))
    return heads.unionByName(tails), all_.select("conv_id", turns.cast("long").alias("turns"))


def lane(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, bytes, key and parent key (two lanes each) of every turn."""
    whole = F.sha2(F.concat("digest", F.lit(":"), F.col("depth").cast("string")), 256)
    rows = turns.withColumn("w", whole).select("conv_id", "block", "depth", "bytes", lane(F.col("w"), 1).alias("l1"), lane(F.col("w"), 16).alias("l2"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "block", "depth", "bytes", "l1", "l2", F.bit_xor("l1").over(inside).alias("x1"), F.bit_xor("l2").over(inside).alias("x2"))
    rows = written(rows, "trie-lanes")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("conv_id", "block").agg(F.bit_xor("l1").alias("m1"), F.bit_xor("l2").alias("m2")).select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(f"m{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    out = rows.join(carry, ["conv_id", "block"])
    key = {i: F.col(f"x{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)}
    return out.select("conv_id", "depth", "bytes", key[1].alias("k1"), key[2].alias("k2"), key[1].bitwiseXOR(F.col("l1")).alias("p1"), key[2].bitwiseXOR(F.col("l2")).alias("p2"))


def name(one: str, two: str, depth: Column) -> Column:
    """A node's id of its key; the root has no turns."""
    return F.concat_ws(":", depth.cast("string"), F.hex(one), F.hex(two))


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, parent, depth, conv_id, n_convs, bytes, path) and ends (id, conv_id)."""
    turns, all_ = rebuilt(written(placed(conversations), "trie-placed"))
    steps = prefixes(turns).join(all_, "conv_id")
    root = all_.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.lit("0:0:0").alias("id"), F.lit(None).cast("string").alias("parent"), "turns")
    steps = steps.select("conv_id", F.col("depth").cast("long").alias("depth"), "bytes", name("k1", "k2", F.col("depth")).alias("id"), name("p1", "p2", F.col("depth") - 1).alias("parent"), "turns").unionByName(root)
    steps = written(steps, "trie-steps")
    longest = F.min(F.struct((-F.col("turns")).alias("t"), "conv_id"))
    nodes = steps.groupBy("id").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"), longest.alias("p")).select(
        "id", "parent", "depth", "conv_id", "n_convs", "bytes", F.col("p.conv_id").alias("path"))
    return nodes, steps.filter("depth = turns").select("id", "conv_id")


def coin(path: str, round_: int) -> Column:
    return F.xxhash64(F.col(path), F.lit(round_)).bitwiseAND(F.lit(1))


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """id and the sums of ``values`` over each node's subtree, its top included. ``nodes``: id,
    parent (null for a root), depth, path (nodes of one path are one way down, of distinct
    depths), n_children and the values (long)."""
    state = written(nodes.select("id", "parent", "depth", "path", F.col("n_children").alias("kids"), *[F.col(v).alias(f"a_{v}") for v in values],
                                 *[F.lit(0).cast("long").alias(f"e_{v}") for v in values]), "trie-state")
    done, gone, round_ = [], [], 0  # totals of leaves, compressed nodes, by round
    plain = ["id", "parent", "depth", "path", "kids", *[f"{k}_{v}" for v in values for k in "ae"]]
    while not state.isEmpty():
        # rake: totals of leaves are whole; they go to the parents, added up before they are shuffled
        done.append(state.filter("kids = 0").select("id", *[F.col(f"a_{v}").alias(v) for v in values]))
        handed = state.filter("kids = 0 and parent is not null").groupBy(F.col("parent").alias("id")).agg(
            F.count("*").alias("raked"), *[F.sum(F.col(f"a_{v}") + F.col(f"e_{v}")).alias(f"h_{v}") for v in values])
        left = state.filter("kids > 0").join(handed, "id", "left").select(
            "id", "parent", "depth", "path", (F.col("kids") - F.coalesce("raked", F.lit(0))).alias("kids"),
            *[c for v in values for c in ((F.col(f"a_{v}") + F.coalesce(f"h_{v}", F.lit(0))).alias(f"a_{v}"), F.col(f"e_{v}"))])
        # compress: runs of one-child nodes of one path
        stretch = F.floor(F.col("depth") / float(STRETCH) ** min(round_ + 1, 30))
        down = Window.partitionBy("path", "stretch").orderBy("depth")
        onward = down.rowsBetween(0, Window.unboundedFollowing)
        runs = left.withColumn("stretch", stretch).withColumn("follows", F.coalesce(F.lead("parent").over(down) == F.col("id"), F.lit(False)))
        runs = runs.withColumn("leaves", (F.col("kids") == 1) & F.col("parent").isNotNull() & F.col("follows"))
        runs = runs.withColumn("run", F.sum(F.when(F.col("leaves"), 0).otherwise(1)).over(onward))
        whole = Window.partitionBy("path", "stretch", "run")
        # from a node on: what the leaving nodes of its run have gathered, and the edges between them
        from_here = whole.orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
        bottom = lambda c: F.max(F.when(~F.col("leaves"), F.col(c))).over(whole)
        runs = runs.withColumn("stays", bottom("id")).withColumn("top", F.min_by("parent", "depth").over(whole))
        for v in values:
            runs = runs.withColumn(f"s_{v}", F.sum(F.when(F.col("leaves"), F.col(f"a_{v}") + F.col(f"e_{v}")).otherwise(F.col(f"e_{v}"))).over(from_here))
        for v in values:
            runs = runs.withColumn(f"w_{v}", F.sum(F.when(F.col("leaves"), F.col(f"a_{v}") + F.col(f"e_{v}")).otherwise(F.col(f"e_{v}"))).over(whole))
        runs = written(runs.select(*plain, "leaves", "stays", "top", *[f"{k}_{v}" for v in values for k in "sw"]), "trie-round")
        gone.append(runs.filter("leaves").select("id", "stays", *[(F.col(f"s_{v}") - F.col(f"e_{v}")).alias(v) for v in values]))
        state = runs.filter("not leaves").select("id", F.col("top").alias("parent"), "depth", "path", "kids", *[c for v in values for c in (F.col(f"a_{v}"), F.col(f"w_{v}").alias(f"e_{v}"))])
        # compress: one-child nodes whose child is of another path
        over = state.filter("kids = 1 and parent is not null").select(
            F.col("id").alias("o_id"), F.col("parent").alias("o_parent"), F.col("path").alias("o_path"), *[F.col(f"{k}_{v}").alias(f"o{k}_{v}") for v in values for k in "ae"]).filter(coin("o_path", round_) == 1)
        if not over.isEmpty():
            met = state.join(over, (state["parent"] == over["o_id"]) & (state["path"] != over["o_path"]) & (coin("path", round_) == 0), "left")
            met = written(met, "trie-coins")
            out = met.filter("o_id is not null")
            gone.append(out.select(F.col("o_id").alias("id"), F.col("id").alias("stays"), *[(F.col(f"oa_{v}") + F.col(f"e_{v}")).alias(v) for v in values]))
            hit = F.col("o_id").isNotNull()
            moved = met.select("id", F.when(hit, F.col("o_parent")).otherwise(F.col("parent")).alias("parent"), "depth", "path", "kids",
                               *[c for v in values for c in (F.col(f"a_{v}"), F.when(hit, F.col(f"e_{v}") + F.col(f"oa_{v}") + F.col(f"oe_{v}")).otherwise(F.col(f"e_{v}")).alias(f"e_{v}"))])
            state = written(moved.join(out.select(F.col("o_id").alias("id")), "id", "left_anti"), "trie-state")
        round_ += 1
    totals = None
    for part in done:
        totals = part if totals is None else totals.unionByName(part)
    if totals is None:
        return nodes.select("id", *values)
    totals = written(totals, "trie-totals")
    # expand: the node that stayed below a compressed one has its total by now
    for part in reversed(gone):
        if part.isEmpty():
            continue
        below = totals.select(F.col("id").alias("stays"), *[F.col(v).alias(f"t_{v}") for v in values])
        found = written(part.join(below, "stays").select("id", *[(F.col(v) + F.col(f"t_{v}")).alias(v) for v in values]), "trie-expanded")
        totals = totals.unionByName(found)
    return totals


def id_digests(ends: DataFrame) -> DataFrame:
    """id, ends_sha256: hash of the ascending conv_ids of each node, joined by commas. Pieces of
    bounded size are joined in Spark; a node's pieces go through one hash, in order."""
    pieces = ends.groupBy("id", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    rows = pieces.repartition("id").sortWithinPartitions("id", "piece")

    def run(batches):
        node, state = None, None
        for b in batches:
            names, digests = [], []
            for i, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if i != node:
                    if node is not None:
                        names.append(node)
                        digests.append(state.hexdigest())
                    node, state = i, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string())], ["id", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["id", "ends_sha256"])

    return map_arrow(rows, run, "id string, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: id, parent, conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    nodes, ends = trie(conversations)
    nodes = written(nodes, "trie-nodes")
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = written(nodes, "trie-children")
    totals = subtree_totals(nodes, ["n_leaves", "saved_tokens"])
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, "id").join(above, "parent", "left").join(id_digests(ends), "id", "left")
    return out.select("id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("id", "parent")


#: DuckDB has no crc32: ids' crc32 is worked out bit by bit with the reversed polynomial.
OP12_SQL = """
WITH RECURSIVE r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
         struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS m
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM r),
crc(conv_id, s, i, bit, c) AS (
  SELECT conv_id, s, 0, 8, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT conv_id, s, CASE WHEN bit = 8 THEN i + 1 ELSE i END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END,
         CASE WHEN bit = 8 THEN xor(c, CAST(ascii(substring(s, i + 1, 1)) AS BIGINT))
              WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END
  FROM crc WHERE NOT (bit = 8 AND i = length(s))),
h AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc WHERE bit = 8 AND i = length(s)),
own AS (SELECT conv_id, list(m ORDER BY place) AS ms FROM r GROUP BY conv_id),
built AS (
  SELECT o.conv_id, list_concat(coalesce(b.ms[1:h.h], []), o.ms[h.h + 1:]) AS ms
  FROM own o JOIN h USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
steps AS (SELECT conv_id, d AS depth, ms[1:d] AS k, len(ms) = d AS ends FROM built, LATERAL (SELECT unnest(generate_series(0, len(ms))) AS d)),
nodes AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ids
  FROM steps GROUP BY k, depth),
weighed AS (
  SELECT n.*, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(k[depth].text) END AS saved,
         (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.k[1:n.depth] = n.k) AS n_children
  FROM nodes n),
up AS (
  SELECT w.k[1:d] AS k, d AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM weighed w, LATERAL (SELECT unnest(generate_series(0, w.depth)) AS d) GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children,
       CAST(up.n_leaves AS BIGINT) AS n_leaves, CAST(up.saved_tokens AS BIGINT) AS saved_tokens, sha256(w.ids) AS ends_sha256
FROM weighed w JOIN up ON up.k = w.k AND up.depth = w.depth
LEFT JOIN nodes p ON w.depth > 0 AND p.depth = w.depth - 1 AND p.k = w.k[1:w.depth - 1]
"""
