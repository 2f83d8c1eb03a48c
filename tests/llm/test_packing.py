"""The plan's bounds for many histograms; packed pieces against the tokenizer."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures_llm import docs, texts
from tokenizers import Tokenizer

from testsieve.llm import packing


def expand(rows, histogram, capacity):
    bins = {}
    for length, first, n, each, seq, offset in rows:
        for r in range(n):
            bins.setdefault(seq + r // each, []).append((offset + r % each * length, length))
    placed = {}
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
            placed[length] = placed.get(length, 0) + 1
        assert end <= capacity
        assert sum(3 * n > capacity for _, n in own) <= 2 or capacity < 3
    assert placed == {n: c for n, c in histogram.items() if c}
    return len(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100, 4096])
    histogram = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
    if seed % 3 == 0:
        histogram = {n: c * 10_000 for n, c in histogram.items() if n * 3 < capacity} or {1: 7}
    rows = packing.plan(histogram, capacity)
    if seed % 3:
        bins = expand(rows, histogram, capacity)
        large = sum(c for n, c in histogram.items() if 2 * n > capacity)
        bound = max(math.ceil(sum(n * c for n, c in histogram.items()) / capacity), large)
        assert bins <= bound * 11 / 9 + 2
    assert len(rows) <= 40 * len(histogram) + 40  # however many pieces


def test_pieces_are_the_tokenizers(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = texts()
    got = packing.packed(docs(spark), path, capacity=64).collect()
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, p, s, len(ids[s:s + 64]), zlib.crc32(ids[s:s + 64].tobytes())) for p, s in enumerate(range(0, len(ids), 64))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    # pieces over half a sequence need one each
    bound = max(math.ceil(sum(ends.values()) / 64), sum(r.length > 32 for r in got))
    assert max(ends.values()) <= 64 and len(ends) <= bound * 11 / 9 + 2
    assert packing.packed(docs(spark, []), path).count() == 0


def test_plain_text_is_cut_without_the_whole_tokenizer(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    words, t = packing.WordIds(path, 50), Tokenizer.from_file(path)
    rng = random.Random(7)
    plain = ["".join(rng.choice("abcSTLREéÉßÿ'''.,!$<|>01²  \n\t\r") for _ in range(rng.randint(0, 90))).replace("²", "") for _ in range(300)]
    other = ["Σας 中文 ﬁ á x\x1cy don't", "a<|endoftext|>b Don'T <|endoftext|> é", "İ ſs ½   it's " + "q" * 200, ""]
    want = [t.encode(x, add_special_tokens=False).ids for x in plain + other]
    assert [x.tolist() for x in words.encode(plain + other)] == want
    assert [x.tolist() for x in words.encode(plain[::-1])] == want[len(plain) - 1::-1]  # remembered or forgotten
    assert "q" * 200 not in words.words and "q" * 200 not in words.words.older

    def whole(*a, **k):
        raise AssertionError("plain text needs the model only")
    monkeypatch.setattr(packing.WordIds, "one", whole)
    monkeypatch.setattr(packing.WordIds, "learn", lambda self, missing: whole() if missing else None)
    fresh = packing.WordIds(path)
    assert [x.tolist() for x in fresh.encode(plain)] == want[:len(plain)]
    # generations are bounded: a full one becomes the older, what that held goes
    small = packing.Remembered(str.encode, 3)
    for i in range(20):
        small = small.renewed()
        assert small[f"w{i}"] == f"w{i}".encode() and small["again"] == b"again"
        assert len(small) + len(small.older) <= 8
