"""Language-model scores with a weighted backoff automaton.

States are the contexts seen in training (the previous ``order - 1`` words and fewer, down to
the empty context; the beginning of a text is a word of its own, and contexts do not reach
beyond it); an arc of a state is a word seen behind it, weighted with its smoothed log10
probability; a word without an arc follows the state's failure arc to the context without its
first word, weighted with the log10 of the share of probability that the state leaves to shorter
contexts, and from there on, until a state has an arc. One traversal of a text from left to right
carries the states and adds up the weights on its way.

Smoothing: with counts c, N training tokens and V distinct ones, and h' = h without its first word,

    p(w)     = (c(w) - D1) / N, and D1 V / N for the class of unknown words
    p(w | h) = s(h) c(hw) / c(h) + (1 - s(h)) p(w | h'),   1 - s(h) = Dn c(h) ** (gn - 1)

where D = n1 / (n1 + 2 n2) are the discounts that the numbers of n-grams met once and twice
give, and gn is chosen so that the contexts' c(h) ** gn add up to the number of distinct
n-grams (the share of events at which a context met something new). All counts come from all
training rows. p(w) and p(w | h) add up to 1 over the V known tokens and the unknown class.

The automaton grows with the corpus, so it is never held in one place. Texts are cut into
chunks of about ``CHUNK_BYTES``; a chunk is one row of sorted distinct 64-bit n-gram
hashes. Chunks send the n-grams they need, with their own training counts, to buckets of
the hash range; buckets add up the counts and send each chunk the totals of what it asked
for; chunks then walk their texts. Frequent words are added up inside chunks first. Orders are
asked for one after the other, and what was sent for one is deleted before the next.

Defined results: null text is an empty text (its end token alone); a null id counts as
empty text for the split (held out); repeated rows and ids are rows of their own; without
training rows every token is unknown with probability 1; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.llm.common import chain, give_back, id_remainder, map_arrow, mix, ship, table, text_slices, word_hashes, written

ORDER = 3
CHUNK_BYTES = 8 << 20
KEYS_PER_BUCKET = 1_000_000
END, BEGIN = (mix(np.array([i], np.uint64))[0] for i in (0xE0D, 0xBE61))


def pack(values: np.ndarray, kind: str) -> bytes:
    """Byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)), "<u8")


def unpack_sorted(blob: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(blob, "<u8"), dtype=np.uint64)


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, ids, train (a byte per text), sizes (tokens per text), vocabulary, codes."""
    docs = docs.select("doc_id", "text", (id_remainder("doc_id", 10) != 0).alias("train"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "ids", "train", "sizes", "vocabulary", "codes"]

    def run(batches):
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal number, held, size
            ids = pa.concat_arrays([h[0] for h in held])
            train, sizes, tokens = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            vocabulary, codes = np.unique(tokens, return_inverse=True)
            row = [pa.array([part << 32 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                   *(pa.array([b], pa.binary()) for b in (train.astype(np.uint8).tobytes(), pack(sizes, "<u4"), pack_sorted(vocabulary), pack(codes, "<u4")))]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays(row, names)

        for b in batches:
            train = b.column(2).to_numpy(zero_copy_only=False)
            for first, data, offsets in text_slices(b.column(1)):
                n = len(offsets) - 1
                h, doc = word_hashes(data, offsets)
                count = np.bincount(doc, minlength=n)
                tokens = np.insert(h, np.cumsum(count), END)  # each text's end behind its words
                held.append((b.column(0).slice(first, n), train[first:first + n], count + 1, tokens))
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield flush()
        if held:
            yield flush()
        give_back()

    return map_arrow(docs, run, f"chunk bigint, ids array<{id_type}>, train binary, sizes binary, vocabulary binary, codes binary")


def grams(vocabulary: np.ndarray, codes: np.ndarray, sizes: np.ndarray, order: int):
    """For each n from 2: n, the tokens that end an n-gram (those with n - 1 tokens before them,
    the beginning included) and the n-grams' hashes, odd if they end a text (no contexts)."""
    tokens = vocabulary[codes]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    place = np.arange(len(tokens)) - np.repeat(first, sizes)
    ends = (tokens == END).astype(np.uint64)
    before = np.concatenate([[BEGIN], tokens[:-1]])
    before[first] = BEGIN
    for n in range(2, order + 1):
        whole = (chain(before, tokens) & ~np.uint64(1)) | ends
        at = np.flatnonzero(place >= n - 2)
        yield n, at, whole[at]
        before = np.concatenate([whole[:1], whole[:-1]])


def requests(rows: DataFrame, bits: int, n: int) -> DataFrame:
    """n, bucket, chunk, keys, counts: the n-grams of ``n`` words that a chunk needs, with its
    training counts."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                codes, sizes, vocabulary = unpack(r["codes"], "<u4"), unpack(r["sizes"], "<u4").astype(np.int64), unpack_sorted(r["vocabulary"])
                train = np.repeat(np.frombuffer(r["train"], np.uint8).astype(bool), sizes)
                seen, keys, at = train, vocabulary, codes
                for m, last, g in grams(vocabulary, codes, sizes, n):
                    if m == n:
                        seen, (keys, at) = train[last], np.unique(g, return_inverse=True)
                counts = np.bincount(at[seen], minlength=len(keys))
                edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                edges = np.concatenate([[0], edges, [len(keys)]]).astype(np.int64)
                full = np.flatnonzero(np.diff(edges))
                cells = [slice(edges[i], edges[i + 1]) for i in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(full), pa.int32()), pa.array(full.astype(np.int32)), pa.array([r["chunk"]] * len(full), pa.int64()),
                     pa.array([pack_sorted(keys[c]) for c in cells], pa.binary()), pa.array([pack(counts[c], "<u4") for c in cells], pa.binary())],
                    ["n", "bucket", "chunk", "keys", "counts"])
                del codes, vocabulary, seen, keys, at, counts
                give_back()

    return map_arrow(rows, run, "n int, bucket int, chunk bigint, keys binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """n, bucket, chunk, totals (one for each key asked for); and for each bucket a row with
    chunk null and stats: keys met once, twice, at all, tokens, and a histogram of the counts
    (beyond single tokens, of those that are contexts)."""

    def add(rows: pa.Table) -> pa.Table:
        n, bucket = rows.column("n")[0].as_py(), rows.column("bucket")[0].as_py()
        keys = [unpack_sorted(k.as_py()) for k in rows.column("keys")]
        counts = [unpack(c.as_py(), "<u4") for c in rows.column("counts")]
        ends = np.cumsum([len(k) for k in keys])
        kinds, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(kinds)).astype(np.int64)
        met = total[total > 0]
        states = met if n == 1 else total[(total > 0) & (kinds & np.uint64(1) == 0)]
        scale = np.floor(np.log2(np.maximum(states, 1))).astype(int)
        stats = [float((met == 1).sum()), float((met == 2).sum()), float(len(met)), float(met.sum()),
                 *np.bincount(scale, minlength=64).astype(float), *np.bincount(scale, states, 64).astype(float)]
        packed = [pack(part, "<u8") for part in np.split(total[at], ends[:-1])]
        del keys, counts, kinds, at, total, met, states
        give_back()
        m = len(packed) + 1
        return pa.table({"n": pa.array([n] * m, pa.int32()), "bucket": pa.array([bucket] * m, pa.int32()),
                         "chunk": pa.array([*rows.column("chunk").to_pylist(), None], pa.int64()),
                         "totals": pa.array([*packed, None], pa.binary()),
                         "stats": pa.array([None] * (m - 1) + [stats], pa.list_(pa.float64()))})

    ship(asked.sparkSession)
    return asked.groupBy("n", "bucket").applyInArrow(add, "n int, bucket int, chunk bigint, totals binary, stats array<double>")


class Smoothing:
    """The model's numbers that hold for every state."""

    def __init__(self, stats: dict[int, np.ndarray], texts: int, order: int = 2):
        every = [stats.get(n, np.zeros(132)) for n in range(1, order + 1)]
        one = every[0]
        discount = lambda s: s[0] / (s[0] + 2 * s[1]) if s[0] else 0.5
        self.tokens, self.distinct, self.texts, self.order = int(one[3]), int(one[2]), texts, order
        self.d1 = min(discount(one), 0.999)
        self.discounts = {n: min(max(discount(s), 0.01), 0.999) for n, s in enumerate(every, 1)}
        # contexts of pairs: the distinct words (not the end, but as often) and the beginning of a text
        self.growths = {n: self.exponent(every[n - 2], every[n - 1][2]) for n in range(2, order + 1)}
        self.growth = self.growths.get(2)

    @staticmethod
    def exponent(contexts: np.ndarray, distinct: float) -> float:
        many, size = contexts[4:68], contexts[68:132] / np.maximum(contexts[4:68], 1)
        low, high = 0.0, 1.0
        for _ in range(60):
            g = (low + high) / 2
            if (many * np.where(many > 0, np.maximum(size, 1) ** g, 0)).sum() < distinct:
                low = g
            else:
                high = g
        return (low + high) / 2

    def single(self, c: np.ndarray) -> np.ndarray:
        """p(w) from the counts of tokens."""
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, np.maximum(c - self.d1, 1e-9), self.d1 * self.distinct) / self.tokens

    def left(self, c: np.ndarray, n: int) -> np.ndarray:
        """Weight of the failure arc of a state of n - 1 words: what it leaves to the shorter context."""
        return np.where(c > 0, np.minimum(self.discounts[n] * np.maximum(c, 1) ** (self.growths[n] - 1), 1.0), 1.0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def walk(c1: np.ndarray, longer: list, sizes: np.ndarray, model: Smoothing):
    """(log10 weight, failure arcs taken) at every token of the texts of a chunk. ``longer`` has for
    each n from 2 the tokens that end an n-gram and the n-grams' counts."""
    weight, failures = np.log10(model.single(c1)), np.zeros(len(c1), np.int64)
    shorter = c1  # counts of the n-grams one word shorter, at their last token
    for n, at, c in longer:
        state = np.concatenate([[model.texts], shorter[:-1]])  # count of the state each token is met in
        if n == 2:
            state[np.cumsum(sizes)[:-1]] = model.texts
        state = state[at]
        left, arc = model.left(state, n), c > 0
        weight[at] = np.where(arc, np.log10((1 - left) * c / np.maximum(state, 1) + left * 10 ** weight[at]), np.log10(left) + weight[at])
        failures[at] += ~arc
        shorter = np.zeros(len(c1), np.int64)
        shorter[at] = c
    return weight, failures


def scored(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_failures."""
    spark = docs.sparkSession
    rows = written(chunks(docs), "lm-chunks")
    count = rows.count()
    # about KEYS_PER_BUCKET keys meet in a bucket
    bits = max(3, int(np.ceil(np.log2(max(1, count * CHUNK_BYTES / 8 / KEYS_PER_BUCKET)))))
    # one order after the other, so that only one order's n-grams are on the executors' disks
    got = functools.reduce(DataFrame.unionByName, [written(answers(requests(rows, bits, n)), f"lm-answers-{n}") for n in range(1, order + 1)])
    sums = (got.filter("chunk is null").select("n", F.posexplode("stats").alias("i", "v")).groupBy("n", "i").agg(F.sum("v").alias("v")).collect())
    stats: dict[int, np.ndarray] = {}
    for r in sums:  # 132 numbers for each n
        stats.setdefault(r.n, np.zeros(132))[r.i] = r.v
    texts = rows.select(F.sum(F.length(F.replace(F.hex("train"), F.lit("00"), F.lit(""))) / 2)).first()[0]
    model = Smoothing(stats, int(texts or 0), order)
    id_type = docs.schema["doc_id"].dataType
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_failures"]

    def run(chunk: pa.Table, totals: pa.Table) -> pa.Table:
        r = chunk.to_pylist()[0]
        ids = chunk.column("ids").combine_chunks().flatten()
        codes, sizes, vocabulary = unpack(r["codes"], "<u4"), unpack(r["sizes"], "<u4").astype(np.int64), unpack_sorted(r["vocabulary"])
        parts: dict[int, list] = {n: [] for n in range(1, order + 1)}
        for t in sorted(zip(*(totals.column(c).to_pylist() for c in ("n", "bucket", "totals"))), key=lambda t: t[:2]):
            parts[t[0]].append(unpack(t[2], "<u8"))
        c1 = np.concatenate(parts[1])[codes].astype(np.int64)
        counts = lambda n, g: np.concatenate(parts[n])[np.unique(g, return_inverse=True)[1]].astype(np.int64) if len(g) else np.zeros(0, np.int64)
        longer = ((n, at, counts(n, g)) for n, at, g in grams(vocabulary, codes, sizes, order))
        weight, failed = walk(c1, longer, sizes, model)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        add = lambda x: np.add.reduceat(x, first)
        train = np.frombuffer(r["train"], np.uint8) == 1
        out = pa.table([ids, pa.array(~train), pa.array(sizes), pa.array(add((c1 > 0).astype(np.int64))), pa.array(np.full(len(sizes), model.tokens)),
                        pa.array(add(model.base(c1))), pa.array(add(weight)), pa.array(add(failed))], names=names)
        del codes, vocabulary, c1, weight, failed
        parts.clear()
        give_back()
        return out

    ship(spark)
    schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_failures bigint"
    asked = got.filter("chunk is not null").select("chunk", "n", "bucket", "totals")
    return rows.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(run, schema)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), ORDER)
