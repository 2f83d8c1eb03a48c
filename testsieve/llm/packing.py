"""Best-fit packing of token sequences by large-item matching.

Every document becomes token ids plus an end id; only documents beyond the capacity are
cut, into full pieces and a rest. How pieces are packed depends on their lengths alone,
so the plan is made from the histogram of lengths (at most ``capacity`` numbers, whatever
the input): pieces over half the capacity open a bin each; pieces over a third are matched
with them greedily (the fullest bin takes the longest that fits), what is left of them
pairs with its like, so no bin holds more than two large pieces; smaller pieces, longest
first, go where they fit best, and open bins when nothing is left. Bins of equal history
are handled together as one range of sequence numbers, which keeps the plan small.

The plan is applied in parallel: the r-th piece of a length goes to the place that the plan
gives to the rank r of that length; ranks come from counts for each partition and length.

Defined results: null text is an empty document (the end id alone); repeated rows and null
ids are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from testsieve.llm.common import give_back, map_arrow, table, written

#: Bytes of text that are cut into words together.
SLICE = 1 << 20
#: Words, and pieces of them, in a generation of what a worker remembers.
CACHE = 200_000

#: How a tokenizer cuts text into the pieces that its model encodes, if ``PIECES`` does the same
#: for ``PLAIN`` text (printable ASCII, the letters of Latin-1, white space of ASCII).
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_PLAIN = "!-~À-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[{_PLAIN}\\t-\\r ]*")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
#: Longer words and pieces are not remembered.
LONG = 64


class Remembered(dict):
    """Ids by text, in two generations of about ``entries`` each: a full one becomes the older,
    and texts of the older one that are not met before the next is full are forgotten. ``ids``
    encodes a text that neither has."""

    def __init__(self, ids, entries: int, older: dict | None = None):
        super().__init__()
        self.ids, self.entries, self.older = ids, entries, {} if older is None else older

    def __missing__(self, text: str) -> bytes:
        own = self.older.pop(text, None)
        if own is None:
            own = self.ids(text)
        if len(text) <= LONG:
            self[text] = own
        return own

    def renewed(self) -> Remembered:
        """What to go on with: a new generation if this one is full."""
        if len(self) < self.entries:
            return self
        self.older = {}
        return Remembered(self.ids, self.entries, self)


class WordIds:
    """Ids of whole texts, encoded one run without blanks at a time and remembered.

    Exact for tokenizers whose tokens never cross white space and which drop it. If the
    tokenizer cuts text as ``PIECES`` does, plain text is cut here and its model encodes each
    piece that is not remembered. Other words are encoded many at a time, with a special token
    between them; those that hold a special token's string, or are very long, are encoded one by
    one and not remembered."""

    def __init__(self, path: str, cache_entries: int = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = min(special.items()) if special else (None, None)
        self.specials = list(special)
        rules = json.loads(self.tokenizer.to_str())
        self.cuts = (rules["normalizer"], rules["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
        self.model, self.bytes = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words, self.pieces = Remembered(self.one, cache_entries), Remembered(self.piece, cache_entries)

    def odd(self, word: str) -> bool:
        return len(word) > LONG or self.mark is None or any(s in word for s in self.specials)

    def one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = self.bytes.pre_tokenize_str(piece)[0][0]
        return np.array([t.id for t in self.model.tokenize(piece)], "<u4").tobytes()

    def learn(self, missing: list[str]) -> None:
        for at in range(0, len(missing), 4096):
            part = missing[at:at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != len(part) - 1:
                raise ValueError("the tokenizer does not keep its special token apart")
            raw, ends = ids.tobytes(), (ends * 4).tolist()
            self.words.update(zip(part, [raw[x:y] for x, y in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)])]))

    def by_word(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self.words = known = self.words.renewed()
        missing = {w for w in set().union(*split) if w not in known and w not in known.older}
        own = {w for w in missing if self.odd(w)}
        plain = {w for w in missing - own if self.cuts and PLAIN.fullmatch(w)}
        self.learn(sorted(missing - own - plain))
        own, plain = {w: self.one(w) for w in own}, {w: self.by_piece(w) for w in plain}
        return [b"".join([own[w] if w in own else plain[w] if w in plain else known[w] for w in words]) for words in split]

    def by_piece(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text.lower())))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        self.pieces = self.pieces.renewed()
        plain = [self.cuts and PLAIN.fullmatch(t) is not None and not any(s in t for s in self.specials) for t in texts]
        rest = iter(self.by_word([t for t, p in zip(texts, plain) if not p]))
        return [np.frombuffer(self.by_piece(t) if p else next(rest), "<u4") for t, p in zip(texts, plain)]


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordIds(path)
    return _encoders[path]


def encoded(enc: WordIds, column: pa.Array):
    """Ids of each text, some hundred texts at a time."""
    group, size = [], 0
    for text in column:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= SLICE:
            yield from enc.encode(group)
            group, size = [], 0
    yield from enc.encode(group)


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece; part and nth number the pieces of one length inside a partition."""
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext
        part, seen, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(vocabulary)
        end = np.array([end_id], "<u4")
        for batch in batches:
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, ids in enumerate(encoded(enc, batch.column(1))):
                ids = np.concatenate([ids, end])
                for p, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at:at + capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
                    nth.append(int(seen[len(own)]))
                    seen[len(own)] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()),
                 pa.array(nth, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
            give_back()

    return map_arrow(docs, run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces, pieces in each bin, first sequence, offset).

    ``gaps`` holds ranges of bins that are filled alike, by the room that is left."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    given: dict[int, int] = {}
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    bins = 0

    def put(length: int, n: int, each: int, first_bin: int, offset: int) -> None:
        rows.append((length, given.get(length, 0), n, each, first_bin, offset))
        given[length] = given.get(length, 0) + n

    def leave(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def take(gap: int) -> tuple[int, int]:
        own = gaps[gap].pop()
        if not gaps[gap]:
            del gaps[gap]
            order.remove(gap)
        return own

    large = sorted((n for n in histogram if 2 * n > capacity), reverse=True)
    middle = sorted((n for n in histogram if 2 * n <= capacity < 3 * n), reverse=True)
    small = sorted((n for n in histogram if 3 * n <= capacity), reverse=True)
    left = {n: histogram[n] for n in middle}
    for n in large:  # the fullest bins choose first, each the longest that fits
        count = histogram[n]
        for m in middle:
            if m > capacity - n or not left[m] or not count:
                continue
            k = min(count, left[m])
            put(n, k, 1, bins, 0)
            put(m, k, 1, bins, n)
            leave(capacity - n - m, bins, k)
            bins, count, left[m] = bins + k, count - k, left[m] - k
        if count:
            put(n, count, 1, bins, 0)
            leave(capacity - n, bins, count)
            bins += count
    waiting = None  # a bin with one middle piece
    for m in middle:
        count = left[m]
        if waiting and count:
            other, at = waiting
            put(m, 1, 1, at, other)
            leave(capacity - other - m, at, 1)
            count, waiting = count - 1, None
        if count // 2:
            put(m, count // 2 * 2, 2, bins, 0)
            leave(capacity - 2 * m, bins, count // 2)
            bins += count // 2
        if count % 2:
            put(m, 1, 1, bins, 0)
            waiting = (m, bins)
            bins += 1
    if waiting:
        leave(capacity - waiting[0], waiting[1], 1)
    for n in small:  # best fit: the smallest room that is large enough, filled as far as it goes
        count = histogram[n]
        while count:
            at = int(np.searchsorted(order, n))
            if at == len(order):
                each = capacity // n
                opened = -(-count // each)
                leave(capacity, bins, opened)
                bins += opened
                continue
            gap = order[at]
            first, many = take(gap)
            each = gap // n
            full = min(many, count // each)
            if full:
                put(n, full * each, each, first, capacity - gap)
                leave(gap - each * n, first, full)
                first, many, count = first + full, many - full, count - full * each
            if many and count:  # fewer than fill one more bin
                put(n, count, count, first, capacity - gap)
                leave(gap - count * n, first, 1)
                first, many, count = first + 1, many - 1, 0
            leave(gap, first, many)
    return rows


def packed(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    rows = written(pieces(docs, vocabulary, capacity, end_id), "packing-pieces")
    counts = written(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    # at most one number for each length up to the capacity
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    places = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(counts, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    # the plan's size is bounded by the capacity, not by the input
    shared = spark.sparkContext.broadcast(places)
    schema = ranked.schema.simpleString()[7:-1].replace(",rank:bigint", "") + ",sequence_id:bigint,offset:bigint"

    def run(batches):
        own = shared.value
        step = 1 << 50
        keys = own[:, 0] * step + own[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = own[np.searchsorted(keys, length * step + rank, "right") - 1]
            r = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(at[:, 4] + r // at[:, 3]), pa.array(at[:, 5] + r % at[:, 3] * length)],
                [*b.schema.names[:-1], "sequence_id", "offset"])

    return map_arrow(ranked, run, schema)


def op3_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers
    return packed(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))
