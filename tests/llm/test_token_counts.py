"""Counts at every prefix against the tokenizer itself."""

import random

import numpy as np
import public_tokenizers
from fixtures_llm import docs, texts
from tokenizers import Tokenizer

from testsieve.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "'", "'l", " 's", "a", "the", "é", "ß", "12", "3", "!!", "...", "<|endoftext|>", "<|endof",
         "日本", " hello", "world", "=====", "　", "re", "'re", "x"]


def exact(text):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]


def test_every_prefix():
    rng, count = random.Random(4), token_counts.PrefixCounter(PATH)
    for _ in range(60):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        assert count.prefix_counts(text).tolist() == exact(text), text


def test_totals_of_many_texts_at_once():
    rng, count, t = random.Random(9), token_counts.PrefixCounter(PATH), Tokenizer.from_file(PATH)
    plain = [p for p in PARTS if "|>" not in p]
    many = ["".join(rng.choice(plain) for _ in range(rng.randint(0, 20))) for _ in range(300)]
    n, keep = token_counts.totals(count, many, 5)
    assert n.tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in many]
    for x, k in zip(many, keep.tolist()):
        c = count.prefix_counts(x)
        assert k == token_counts.longest_prefix(c, 5)


def test_operator(spark):
    t = Tokenizer.from_file(PATH)
    got = token_counts.token_counts(docs(spark), PATH, budget=10, prefixes=True).collect()
    assert len(got) == len(texts())
    want = sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in texts()), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    for r in got:
        c = np.frombuffer(r.prefix_counts, "<u4")
        assert (c[-1] if len(c) else 0) == r.n_tokens
    assert token_counts.token_counts(docs(spark, []), PATH).count() == 0
