"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its distinct word shingles (64-bit hashes). Equal sets are one
class, so copies cost nothing further. A class keeps its ``K`` smallest hashes; inverted
lists of retained values give the classes that overlap.

No link is lost and no list is cut. Two sets with a similarity of at least 0.8 share at least
``LEAST`` of K retained values (the chance of fewer is 2e-8 a pair; sets of fewer than K
shingles share 80 in 100 of them for certain), so of its r values a class has to be listed
only under the r - LEAST + 1 rarest: values that many documents have drop out unless a
document has little else. A shingle that no other listed class has cannot be shared, and a
link needs 4 in 9 of the shingles of both sets together in common; so classes with too few
shareable shingles drop out. Inside a list the members are compared with one pivot first,
the one that shares most with others; members that come out linked are one component and
need no comparison with each other. In further rounds a list's members are compared with
``PIVOTS`` members, drawn anew each round, of its largest component and of one drawn
component; rounds go on while each takes away a tenth of the pairs that are left between
components. What is left then is listed anew, by full sets:
with shingles in order of rarity, two linked sets must share one of the rarest ninth of the
smaller set and fifth of the larger one, at places that leave enough shingles behind them.
Lists of rare shingles that are long make crowds, as copies of a lost original do that are not
linked with each other; there, sets are listed by what they have and lack against the crowd's
usual shingles, of which two linked sets must share some unless both are linked with the one
nearest to the usual (:func:`crowd_pairs`).
A pair is estimated from the union of the two sketches first and confirmed on the full sets
last.

Components come from alternating large-star and small-star steps over the links.

Defined results: null text, empty text and text of white space only have no shingles and
are linked with nothing (component_id is the own id); a text of fewer words than a shingle
is one shingle; repeated rows are rows of their own with the same result; rows with a null
id take part, and component_id is the smallest id that is not null, if any; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.llm.common import chain, drop_garbage, give_back, map_arrow, mix, small_batches, table, text_slices, word_hashes, written

K = 64
LEAST = 32
SMALL_ROWS = 200_000
#: Bytes of text whose shingles a task holds together.
SLICE = 1 << 18
#: Pivots that a component sends into a round, and the share of the open pairs that a round has
#: to take away for another round to follow.
PIVOTS = 4
PIVOT_GAIN = 0.1
#: Smaller sets in a list of rare shingles up to which its members are paired as they stand.
CROWD = 8
#: Crowds whose usual shingles are broadcast.
CROWDS = 2_000


def shingle_slices(column, width: int):
    """(first row, sets) of runs of texts with ``SLICE`` bytes or a single long one; a set is the
    sorted distinct shingle hashes (63 bits) of a text."""
    for first, data, offsets in text_slices(column, SLICE):
        h, doc = word_hashes(data, offsets)
        edges = np.searchsorted(doc, np.arange(len(offsets)))
        full = h
        for j in range(1, width):
            full = chain(full[:-1], h[j:]) if len(full) > 1 else full[:0]
        full, sets = full >> np.uint64(1), []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a >= width:
                sets.append(np.unique(full[a:b - width + 1]))
            elif b > a:
                one = h[a:a + 1]
                for j in range(a + 1, b):
                    one = chain(one, h[j:j + 1])
                sets.append(mix(one + np.uint64(b - a)) >> np.uint64(1))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield first, sets


def class_of(shingles: np.ndarray) -> int | None:
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, t (hash of id and text), c (class), n (shingles), sketch."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("t"))

    def run(batches):
        for b in batches:
            for first, sets in shingle_slices(b.column(1), width):
                own = b.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(2), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s[:K].astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "t", "c", "n", "sketch"])
        give_back()

    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t bigint, c bigint, n bigint, sketch array<bigint>")


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast ``df`` if a count shows at most ``rows`` rows; a shuffled join beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def least_shared(r: Column) -> Column:
    return F.least(F.lit(LEAST), F.ceil(r * 0.8)).cast("int")


def inverted_lists(classes: DataFrame) -> DataFrame:
    """v, c, n, weight: each class under the rarest of its retained values that others have too."""
    entries = classes.select("c", "n", F.size("sketch").alias("r"), F.explode("sketch").alias("v"))
    shared = entries.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    met = entries.join(shared, "v").groupBy("c").agg(
        F.first("n").alias("n"), F.first("r").alias("r"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    room = F.col("r") - least_shared(F.col("r")) + 1 - (F.col("r") - F.size("vs"))
    weight = F.aggregate("vs", F.lit(0).cast("long"), lambda a, x: a + x["df"])
    return met.select("c", "n", weight.alias("weight"), F.explode(F.slice("vs", F.lit(1), F.greatest(F.lit(0), room))).alias("e")).select(F.col("e.v").alias("v"), "c", "n", "weight")


def possible(n: str, shareable: str, n2: str, shareable2: str) -> Column:
    """Can two classes share 80 in 100 of their united shingles, which is 4 in 9 of the sum?"""
    return F.least(shareable, shareable2) * 9 >= (F.col(n) + F.col(n2)) * 4


def spread(sets: DataFrame) -> DataFrame:
    """c, s: one row for each shingle of each class."""
    def run(batches):
        for b in batches:
            for c, members in zip(b.column(0), b.column(1)):
                v = np.frombuffer(members.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c.as_py())), pa.array(v)], ["c", "s"])

    return map_arrow(sets.select("c", "members"), run, "c bigint, s bigint")


def linkable(sets: DataFrame, rounds: int = 2) -> DataFrame:
    """c, shareable: classes of which 80 in 100 of the shingles are met in other classes of
    ``sets``, and how many are; looked at again among those that are left."""
    left, sizes = sets, sets.select("c", (F.octet_length("members") / 8).cast("long").alias("n"))
    for _ in range(rounds):
        rows = spread(left)
        again = rows.groupBy("s").agg(F.count("*").alias("m")).filter("m > 1").select("s")
        met = rows.join(again, "s").groupBy("c").agg(F.count("*").alias("shareable"))
        kept = written(met.join(sizes, "c").filter("shareable * 100 >= n * 80").select("c", "shareable"), "dup-linkable")
        left = left.join(kept.select("c"), "c", "left_semi")
    return kept


def rare_pairs(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``classes`` (c, n, root) with different roots that may be linked, by the
    rarest shingles of their full sets. A shingle's place is its rank by rarity in its set; the
    first one that two sets share has no shared one before it, so min(n - place) bounds what
    they share."""
    rows = spread(sets.join(classes.select("c"), "c", "left_semi"))
    often = rows.groupBy("s").agg(F.count("*").alias("m")).filter("m > 1")
    by = rows.join(often, "s").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("m", "s"))).alias("shared")).join(classes, "c")
    # shingles that nobody shares come first
    listed = (by.select("c", "n", "root", "shared", F.greatest(F.lit(0), F.floor(F.col("n") * 0.2).cast("int") + 1 - (F.col("n").cast("int") - F.size("shared"))).alias("room"))
              .select("c", "n", "root", F.size("shared").alias("size"), F.posexplode(F.slice("shared", F.lit(1), F.col("room"))).alias("at", "e"))
              .select("c", "n", "root", F.col("e.s").alias("s"), (F.col("n") - F.col("size") + F.col("at")).alias("place")))
    listed = written(listed, "dup-rare")
    small_end = F.col("place") * 9 <= F.col("n")
    met = listed.groupBy("s").agg(F.count_if(small_end).alias("small"), F.min("c").alias("anchor"), F.count("*").alias("m")).filter("small > 0 and m > 1")
    # one row meets at most CROWD others in a list; what stands in a longer one is a crowd
    long_ = met.filter(F.col("small") > CROWD).select("s", "anchor")
    listed = listed.join(met.select("s", "small"), "s")
    x = listed.filter(small_end & (F.col("small") <= CROWD))
    y = listed.filter(F.col("small") <= CROWD).select("s", *[F.col(k).alias(f"{k}2") for k in ("c", "n", "root", "place")])
    smaller = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("c") < F.col("c2")))
    room = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) * 9 >= (F.col("n") + F.col("n2")) * 4
    pairs = x.join(y, "s").filter(smaller & (F.col("root") != F.col("root2")) & room).select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b"))
    crowds = components(listed.join(long_, "s").select(F.col("c").alias("a"), F.col("anchor").alias("b")))
    members = written(crowds.select(F.col("node").alias("c"), F.col("root").alias("crowd")).join(classes, "c"), "dup-crowds")
    if not members.isEmpty():
        pairs = pairs.unionByName(crowd_pairs(members, rows))
    return pairs.distinct()


def crowd_pairs(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``members`` (c, crowd, n, root) of one crowd with different roots that may
    be linked; ``rows`` are (c, s). A set is taken as its difference from the shingles that more
    than half of the crowd have: d shingles too many or missing. Two sets that share k of theirs
    differ in d + d2 - 2k shingles and are linked if 9 times that is at most n + n2; with
    e = 9d - n, if 18k >= e + e2. Sets that need to share none are linked with the least e as
    well, so all others have to share one, of which few have the rare ones."""
    sets = rows.join(members.select("c", "crowd"), "c")
    counts = sets.groupBy("crowd", "s").agg(F.count("*").alias("m")).join(small(members.groupBy("crowd").agg(F.count("*").alias("size")), CROWDS), "crowd")
    common = F.col("m") * 2 > F.col("size")
    usual = counts.filter(common).groupBy("crowd").agg(F.collect_list(F.struct((F.col("size") - F.col("m")).alias("m"), "s")).alias("usual"))
    usual = small(written(usual, "dup-usual"), CROWDS)
    own = sets.join(counts, ["crowd", "s"]).groupBy("c").agg(
        F.collect_list(F.when(~common, F.struct("m", "s"))).alias("extra"), F.collect_list(F.when(common, F.struct((F.col("size") - F.col("m")).alias("m"), "s"))).alias("has"))
    none = F.array().cast("array<struct<m:bigint,s:bigint>>")
    differing = (members.join(own, "c").join(usual, "crowd", "left")
                 .withColumn("diff", F.concat("extra", F.array_except(F.coalesce("usual", none), "has"))).withColumn("d", F.size("diff"))
                 .withColumn("e", F.col("d") * 9 - F.col("n")).select("crowd", "c", "root", "d", "e", F.array_sort(F.filter("diff", lambda x: x["m"] > 1)).alias("shared")))
    differing = written(differing, "dup-differing")
    least = differing.groupBy("crowd").agg(F.min(F.struct("e", "c", "root")).alias("least"))
    by = differing.join(small(least, CROWDS), "crowd")
    star = by.filter((F.col("e") + F.col("least.e") <= 0) & (F.col("root") != F.col("least.root"))).select(
        F.least("c", "least.c").alias("a"), F.greatest("c", "least.c").alias("b"))
    # of two that have to share k the first shared one has k - 1 shared ones behind it in both
    listed = by.select("crowd", "c", "root", "d", "e", F.col("least.e").alias("low"), F.size("shared").alias("size"), F.posexplode("shared").alias("at", "x")).select(
        "crowd", "c", "root", "e", "low", F.col("x.s").alias("s"), (F.col("size") - F.col("at")).cast("long").alias("behind"))
    listed = written(listed.filter(F.col("behind") * 18 >= F.col("e") + F.col("low")).drop("low"), "dup-differences")
    x = listed.filter(F.col("behind") * 9 >= F.col("e"))
    y = listed.select("crowd", "s", *[F.col(k).alias(f"{k}2") for k in ("c", "root", "e", "behind")])
    lower = (F.col("e") < F.col("e2")) | ((F.col("e") == F.col("e2")) & (F.col("c") < F.col("c2")))
    needed = F.col("e") + F.col("e2")
    pairs = x.join(y, ["crowd", "s"]).filter(lower & (needed > 0) & (F.col("root") != F.col("root2")) & (F.least("behind", "behind2") * 18 >= needed))
    return star.unionByName(pairs.select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b")))


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose union sketch does not rule out a similarity of 0.8."""
    own = classes.select("c", "sketch")
    both = (pairs.join(own.select(F.col("c").alias("a"), F.col("sketch").alias("sa")), "a")
            .join(own.select(F.col("c").alias("b"), F.col("sketch").alias("sb")), "b"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    both = both.withColumn("u", union).withColumn("common", F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")))
    whole = (F.size("sa") < K) & (F.size("sb") < K) & (F.size(F.array_union("sa", "sb")) <= K)
    return both.filter(F.when(whole, F.col("common") * 100 >= F.size("u") * 80).otherwise(F.col("common") >= least_shared(F.size("u")))).select("a", "b")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """c, members (sorted hashes) of the wanted classes (c, doc_id, t: one row of each)."""
    wanted = wanted.select("c", F.col("doc_id").alias("rep"), F.col("t").alias("rep_t"))
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("t"))
    rows = docs.join(small(wanted), (F.col("t") == F.col("rep_t")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("c", "text")

    def run(batches):
        for b in batches:
            for first, sets in shingle_slices(b.column(1), width):
                c = b.column(0).slice(first, len(sets))
                keep = [class_of(s) == x for s, x in zip(sets, c.to_pylist())]
                yield pa.RecordBatch.from_arrays([c, pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["c", "members"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return map_arrow(rows, run, "c bigint, members binary").groupBy("c").agg(F.first("members").alias("members"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with 100 * shared >= 80 * united on the full sets."""
    both = (pairs.join(sets.select(F.col("c").alias("a"), F.col("members").alias("ma")), "a")
            .join(sets.select(F.col("c").alias("b"), F.col("members").alias("mb")), "b"))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return map_arrow(both.select("a", "b", "ma", "mb"), run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of the links (a, b); root is the smallest node reachable."""
    edges = written(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state = mark(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            both.filter("v < u").join(low.filter("m < u"), "u").filter("v = m").select("u", "v")).filter("u != v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        following = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = written(following.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        last, state = state, mark(edges)
        drop_garbage(links.sparkSession)
        if state == last:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def pivot_pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of a class (c, n, shareable, root) and a pivot p of another component."""
    met = met.filter((F.col("root") != F.col("other")) & possible("n", "shareable", "p.n", "p.shareable"))
    return met.select(F.least("c", "p.c").alias("a"), F.greatest("c", "p.c").alias("b")).distinct()


def links_of(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """node, root over all classes that are linked with another."""
    lists = written(inverted_lists(classes), "dup-lists")
    reps = classes.select("c", "doc_id", "t")
    listed = lists.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1").select("v")
    members = lists.join(listed, "v", "left_semi").select("c").distinct()
    sets = written(full_sets(docs, reps.join(members, "c", "left_semi"), width), "dup-sets")
    alive = linkable(sets)
    drop_garbage(docs.sparkSession)
    lists = written(lists.join(alive, "c"), "dup-lists")
    classes = written(classes.select("c", "sketch").join(alive.select("c"), "c", "left_semi"), "dup-alive")
    sets = written(sets.join(alive.select("c"), "c", "left_semi"), "dup-sets")
    roots, done, round_, before = None, None, 0, None
    while True:
        if roots is None:
            placed = lists.withColumn("root", F.col("c"))
        else:
            placed = lists.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
            placed = written(placed, "dup-placed")
        # of each list its largest component and one drawn anew each round
        chosen = F.array_distinct(F.array(F.max(F.struct("m", "root"))["root"], F.min(F.struct(F.xxhash64("root", F.lit(round_)).alias("h"), "root"))["root"]))
        open_ = (placed.groupBy("v", "root").agg(F.count("*").alias("m"), F.min(F.struct(-F.col("weight"), "c", "n", "shareable")).alias("p"))
                 .groupBy("v").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("inside"), F.min(F.struct("p", "root")).alias("first"), chosen.alias("roots"))
                 .withColumn("pairs", F.col("m") * F.col("m") - F.col("inside")).filter("pairs > 0").select("v", "first", "roots", "m", "pairs"))
        open_ = written(open_, "dup-open")
        left, rows = open_.agg(F.sum("pairs"), F.sum("m")).first()
        if not left:
            break
        last = round_ > 0 and (left <= 8 * rows or left > (1 - PIVOT_GAIN) * before)
        before = left
        if last:
            x = placed.join(open_.select("v"), "v", "left_semi").select("c", "n", "root").distinct()
            pairs = rare_pairs(x, sets)
        elif round_ == 0:
            p = open_.select("v", F.col("first.root").alias("other"), F.col("first.p").alias("p"))
            pairs = pivot_pairs(placed.join(p, "v").select("c", "n", "shareable", "root", "other", "p"))
        else:
            members = placed.join(open_.select("v"), "v", "left_semi").select("c", "n", "shareable", "root").distinct()
            drawn = members.groupBy("root").agg(F.array_distinct(F.array(*[
                F.min(F.struct(F.xxhash64("c", F.lit(PIVOTS * round_ + j)).alias("h"), "c", "n", "shareable")) for j in range(PIVOTS)])).alias("ps"))
            met = placed.join(open_.select("v", F.explode("roots").alias("other")), "v").filter("root != other").select("c", "n", "shareable", "root", "other").distinct()
            pairs = pivot_pairs(met.join(drawn.select(F.col("root").alias("other"), F.explode("ps").alias("p")), "other"))
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = written(estimated(pairs, classes), "dup-pairs")
        found = written(confirmed(pairs, sets), "dup-links")
        # the components so far stand for the links so far
        roots = components(found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        done = pairs if done is None else done.unionByName(pairs)
        if last:
            break
        round_ += 1
    return roots if roots is not None else classes.select(F.col("c").alias("node"), F.col("c").alias("root")).limit(0)


def judged(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, t (hash of id and text), n_shingles, component_id, kept, chosen of every row.
    ``kept`` goes by the id, so rows that share the smallest one are all kept; ``chosen`` are
    the rows of one id and text of each component."""
    with small_batches(docs.sparkSession):
        return _judged(docs, width)


def _judged(docs: DataFrame, width: int) -> DataFrame:
    rows = written(sketches(docs, width), "dup-sketches")
    classes = written(rows.filter("c is not null").groupBy("c").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .select("c", "rep.doc_id", "rep.t", "n", "sketch"), "dup-classes")
    roots = written(links_of(docs, classes, width), "dup-roots")
    placed = classes.select("c", "doc_id", "t").join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = placed.groupBy("root").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first"))
    names = placed.join(least, "root").select("c", "component_id", F.col("first.t").alias("first"))
    out = rows.select("doc_id", "t", "c", F.col("n").alias("n_shingles")).join(names, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "t", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
                      (F.col("c").isNull() | (F.col("t") == F.col("first"))).alias("chosen"))


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, t (hash of id and text), n_shingles, component_id, kept of every row."""
    return judged(docs, width).drop("chosen")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4).drop("t")
