"""Token counts at every prefix of a text, by dynamic programming over BPE tokens.

The encoding of a prefix ends in exactly one token ``t`` that is compatible with the
last token of the encoding of the prefix without ``t``; so one pass from left to right
gives the exact count at every prefix. Text falls into units (white space plus one run
of letters, digits or other signs) whose counts do not depend on their surroundings;
the count changes inside a unit are kept in a bounded cache and joined per text.

Defined results: null text counts as empty (0 bytes, 0 tokens); every input row gives
one output row, repeated rows and null ids included; other columns are ignored.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from testsieve.llm.common import SLICE_BYTES, map_arrow, mix, power_tables, table

CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}  # fixed values of the tokenizer
UNIT = regex.compile(r"(?:\s*[^\S ])?'(?:s|t|re|ve|m|ll|d)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
SPACES = regex.compile(r"\s*")


def byte_names() -> dict[str, int]:
    """The printable stand-in for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    names.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return names


class PrefixCounter:
    """Counts for one byte-level BPE vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str, cache_entries: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        model = spec["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        # a token's number is the order in which merging can make it: bytes first, then merges
        self.number = {bytes([i]): i for i in range(256)}
        self.halves = [(i, i) for i in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            self.joined[self.number[a], self.number[b]] = self.number[a + b] = len(self.halves)
            self.halves.append((self.number[a], self.number[b]))
        self.longest = max(map(len, self.number))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache_entries = cache_entries
        self.units: dict[str, bytes] = {}
        self.totals: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Does merging keep these two tokens apart when their bytes stand side by side?

        Undo the latest merge on either side of the seam again and again; the tokens are
        apart unless some pair across the seam would have merged before that."""
        joined, halves, before = self.joined, self.halves, 1 << 60
        while True:
            made = joined.get((left, right))
            if made is not None and made < before:
                return False
            if left > right:
                if left < 256:
                    return True
                before, left = left, halves[left][1]
            else:
                if right < 256:
                    return True
                before, right = right + 1, halves[right][0]

    def piece(self, text: str) -> list[int]:
        """Counts after each code point of one pre-token."""
        data = text.encode("utf-8", "surrogatepass")
        n, number, pairs, longest = len(data), self.number, self.pairs, self.longest
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = number.get(data[j:i])
                if t is None:
                    continue
                if j:
                    key = last[j] << 20 | t
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) >= 1_000_000:
                            pairs.clear()
                        ok = pairs[key] = self.compatible(last[j], t)
                    if not ok:
                        continue
                last[i], count[i] = t, count[j] + 1
                break
        if n == len(text):
            return count[1:]
        ends = [i for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80]
        return [count[i] for i in ends]

    def unit(self, text: str) -> bytes:
        """Changes of the count at each code point of one unit, native int16."""
        white = SPACES.match(text).end()
        run, rest = text[:white], text[white:]
        if not rest:
            counts = self.piece(run)
        elif run in ("", " ") and rest not in CONTRACTIONS:
            counts = self.piece(text)
        else:
            counts = self.piece(run) if run else []
            lead = " " if run.endswith(" ") else ""
            if lead:
                base = self.piece(run[:-1])[-1] if len(run) > 1 else 0
            else:
                base = (self.piece(run[:-1])[-1] if len(run) > 1 else 0) + (self.piece(run[-1:])[-1] if run else 0)
            if not lead and rest in CONTRACTIONS:
                inner = [1 + (self.piece(rest[1:j])[-1] if j > 1 else 0) for j in range(1, len(rest))] + [self.piece(rest)[-1]]
            else:
                inner = self.piece(lead + rest)[len(lead):]
            counts = counts + [base + c for c in inner]
        return array("h", [b - a for a, b in zip([0] + counts, counts)]).tobytes()  # raises beyond int16

    def _plain(self, text: str) -> np.ndarray:
        units = UNIT.findall(text)
        cache = self.units
        try:
            blob = b"".join([cache[u] for u in units])
        except KeyError:
            out = []
            for u in units:
                d = cache.get(u)
                if d is None:
                    d = self.unit(u)
                    if len(u) <= 64:
                        if len(cache) >= self.cache_entries:
                            cache.clear()
                        cache[u] = d
                out.append(d)
            blob = b"".join(out)
        return np.cumsum(np.frombuffer(blob, np.int16), dtype=np.int64)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact number of tokens of ``text[:i]`` for i = 1 .. len(text)."""
        if self.special_re is None or not self.special_re.search(text):
            return self._plain(text)
        parts, done, base = [], self.special_re.split(text), 0
        for i in range(0, len(done), 2):
            body, mark = done[i], done[i + 1] if i + 1 < len(done) else ""
            counts = self._plain(body + mark[:-1])
            whole = int(counts[len(body) - 1]) if body else 0
            parts.append(base + counts)
            if mark:
                base += whole + 1
                parts.append(np.array([base]))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _classes() -> np.ndarray:
    """Class of every code point: 0 white space, 1 letter, 2 number, 3 other."""
    global _class_table
    if _class_table is None:
        out = np.full(0x110000, 3, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                if b - a + 1 == len(m[0]):
                    out[a:b + 1] = k
                else:
                    out[[ord(c) for c in m[0]]] = k
        _class_table = out
    return _class_table


_class_table: np.ndarray | None = None


def unit_ends(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the units in a run of texts; ``bounds`` are the texts' offsets. The same
    units as ``UNIT`` finds, for all texts at once."""
    n = len(points)
    cls = _classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = edge[0] = edge[n] = True
    first = edge[:-1].copy()
    full = cls != 0
    edge[1:n] |= cls[1:] != cls[:-1]
    begins = edge[:-1] & full
    # 's 't 're 've 'm 'll 'd behind anything but a blank are pieces of their own
    quote = np.flatnonzero(begins & (points == 39))
    quote = quote[quote + 1 < n]
    quote = quote[(cls[quote + 1] == 1) & ~first[quote + 1]]
    quote = quote[first[quote] | (points[quote - 1] != 32)]
    if len(quote):
        c1 = points[quote + 1]
        third = np.minimum(quote + 2, n - 1)
        c2 = np.where((quote + 2 < n) & ~first[third], points[third], 0)
        two = np.isin(c1, [ord(c) for c in "stmd"])
        three = ~two & (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l")))
        size = np.where(two, 2, np.where(three, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        begins[quote + 1] = False
        after = quote + size
        inside = after < n
        more = after[inside]
        more = more[(cls[more] == 1) & ~first[more]]
        begins[more] = True
    ends = np.zeros(n + 1, bool)
    ends[bounds[1:]] = True
    # a piece ends where the next piece begins or white space follows
    ends[1:n] |= full[:-1] & (begins[1:] | ~full[1:])
    ends[0] = False
    return np.flatnonzero(ends)


def totals(count: PrefixCounter, texts: list[str], budget: int | None):
    """(tokens per text, longest prefix within ``budget`` per text or None)."""
    whole = "".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if not whole:
        zero = np.zeros(len(texts), np.int64)
        return zero, zero
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = unit_ends(points, bounds)
    starts = np.concatenate([[0], ends[:-1]])
    powers, inverses = power_tables(len(points) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * powers[:len(points)], out=total[1:])
        hashes = (total[ends] - total[starts]) * inverses[starts]
    kinds, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    known, sums = count.totals, np.empty(len(kinds), np.int64)
    for i, (h, a, b) in enumerate(zip(kinds.tolist(), starts[where].tolist(), ends[where].tolist())):
        c = known.get(h)
        if c is None:
            c = sum(np.frombuffer(count.unit(whole[a:b]), np.int16).tolist())
            if len(known) >= 2 * count.cache_entries:
                known.clear()
            known[h] = c
        sums[i] = c
    at_end = np.concatenate([[0], np.cumsum(sums[back])])
    first_unit = np.searchsorted(ends, bounds, "right")
    first_unit[0] = 0
    n_tokens = at_end[first_unit[1:]] - at_end[first_unit[:-1]]
    if budget is None:
        return n_tokens, None
    # counts at unit ends never fall, so the longest prefix ends in or before the first unit beyond the budget
    beyond = np.searchsorted(at_end[1:], at_end[first_unit[:-1]] + budget, "right")
    keep = sizes.copy()
    for d in np.flatnonzero(beyond < first_unit[1:]).tolist():
        u = int(beyond[d])
        inner = np.cumsum(np.frombuffer(count.unit(whole[starts[u]:ends[u]]), np.int16))
        base = int(at_end[u] - at_end[first_unit[d]])
        keep[d] = starts[u] - bounds[d] + longest_prefix(base + inner, budget)
    return n_tokens, keep


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per file and worker process."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    at = np.flatnonzero(counts <= budget)
    return int(at[-1]) + 1 if len(at) else 0


def token_counts(docs: DataFrame, vocabulary: str, budget: int | None = None, prefixes: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens; with ``budget`` also keep_chars, the
    code points of the longest prefix within it; with ``prefixes`` also prefix_counts, the
    count at every prefix as little-endian unsigned 32-bit numbers."""
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes bigint, n_tokens bigint"
    schema += ", keep_chars bigint" * (budget is not None) + ", prefix_counts binary" * prefixes

    def run(batches):
        count = counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            n_tokens, keep, blobs = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [b""] * len(texts)
            one = [i for i, t in enumerate(texts) if prefixes or count.special_re is not None and count.special_re.search(t)]
            for i in one:
                c = count.prefix_counts(texts[i])
                n_tokens[i] = c[-1] if len(c) else 0
                keep[i] = longest_prefix(c, budget) if budget is not None else 0
                blobs[i] = c.astype("<u4").tobytes() if prefixes else b""
            skip, group, size = set(one), [], 0
            for i in [*range(len(texts)), None]:
                if group and (i is None or size >= SLICE_BYTES):
                    got, kept = totals(count, [texts[g] for g in group], budget)
                    n_tokens[group] = got
                    if kept is not None:
                        keep[group] = kept
                    group, size = [], 0
                if i is not None and i not in skip:
                    group.append(i)
                    size += len(texts[i])
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens)]
            if budget is not None:
                columns.append(pa.array(keep))
            if prefixes:
                columns.append(pa.array(blobs, pa.binary()))
            names = ["doc_id", "n_bytes", "n_tokens"] + ["keep_chars"] * (budget is not None) + ["prefix_counts"] * prefixes
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(docs, run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """Exact token counts of every whole text, and where each must be cut to fit."""
    import public_tokenizers
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    out = token_counts(table(spark, sf_dir, "documents"), path, budget=limit)
    return out.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {limit} AS over_limit", "keep_chars")
