"""Best-fit packing: ids as the library gives them, whole pieces, gapless sequences, few of them."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import best_fit as B

DDL = "doc_id long, text string"


def check(rows, got, max_len):
    """All pieces of all rows, each once; sequences without gaps or overflow."""
    lib = Tokenizer.from_file(public_tokenizers.path(B.TOKENIZER))
    want = []
    for doc_id, text in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), max_len):
            part = ids[k:k + max_len]
            want.append((doc_id, k // max_len, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(e <= max_len for e in ends.values())
    return len(ends), -(-sum(r[3] for r in want) // max_len)


def bodies():
    rng = random.Random(2)
    words = ["Hello", "it's", "ÉTÉ", "naïve", "ΣΟΦΟΣ", "İstanbul", "日本語", "é", "ﬁn", "12,5%", "a\x1cb", "don't!",
             "<|endoftext|>", "x<|startoftext|>y", " ", "q" * 90, "ſ", " ", "www.a-b.org/?q=1", "\x00", "👍🏽"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, n))) for n in (3, 10, 40, 200) for _ in range(30)]


def test_ids_are_those_of_the_library():
    path = public_tokenizers.path(B.TOKENIZER)
    e, lib = B.WordEncoder(path), Tokenizer.from_file(path)
    for t in [*bodies(), " a  b\t\nc ", "", "\x1c", " "]:
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(t), "<u4").tolist() == want
        assert np.frombuffer(b"".join(e.slices(t, 7)), "<u4").tolist() == want


@pytest.mark.parametrize("max_len", [16, 64, 4096])
def test_pieces_and_sequences(spark, max_len):
    rows = [(i, t) for i, t in enumerate(bodies())] + [(5, None), (5, ""), (None, "same"), (None, "same"), (7, "word " * 9000)]
    got = B.pack(spark.createDataFrame(rows, DDL).repartition(5), max_len=max_len).collect()
    n, least = check(rows, got, max_len)
    assert n <= least + max(1, least // 50)


def test_empty_table_and_other_columns(spark):
    assert B.pack(spark.createDataFrame([], DDL)).collect() == []
    df = spark.createDataFrame([(1, "a b", 3, 4)], DDL + ", length int, task int")
    assert [tuple(r) for r in B.pack(df).collect()] == [(1, 0, 0, 3, B.pack(df).first().ids_crc32, 0, 0)]


def holds_all(plan, sizes, counts, capacity):
    seen = np.zeros(len(sizes), np.int64)
    for config, n in plan:
        assert sum(int(sizes[i]) * k for i, k in config.items()) <= capacity
        for i, k in config.items():
            seen[i] += k * n
    assert (seen == counts).all()
    return sum(n for _, n in plan)


@pytest.mark.parametrize("low,high", [(1, 4096), (700, 1500), (1100, 4000), (2100, 4096), (1, 30)])
def test_plans(low, high):
    rng = np.random.default_rng(low)
    sizes, counts = np.unique(rng.integers(low, high, 20_000), return_counts=True)
    n = holds_all(B.plan(sizes, counts, 4096), sizes, counts, 4096)
    greedy = holds_all(B.best_fit(sizes, counts, 4096), sizes, counts, 4096)
    assert -(-int(sizes @ counts) // 4096) <= n <= greedy


def test_fewest_sequences_on_small_histograms():
    """Against all ways of packing."""
    rng = np.random.default_rng(3)

    def fewest(items, bins=()):
        if not items:
            return len(bins)
        first, rest = items[0], items[1:]
        options = {b: k for k, b in enumerate(bins) if b + first <= 12}
        return min([fewest(rest, tuple(b + first if j == k else b for j, b in enumerate(bins))) for k in options.values()]
                   + [fewest(rest, (*bins, first))])

    for _ in range(25):
        items = sorted(rng.integers(1, 12, 8).tolist(), reverse=True)
        sizes, counts = np.unique(items, return_counts=True)
        assert holds_all(B.plan(sizes, counts, 12), sizes, counts, 12) <= fewest(tuple(items)) + 1


def test_knapsack_against_search():
    rng = np.random.default_rng(4)
    for _ in range(10):
        sizes = np.unique(rng.integers(1, 15, 4))
        values = rng.random(len(sizes))
        best, _ = B.knapsack(sizes, values, 30)
        plain = [0.0]
        for c in range(1, 31):
            plain.append(max([plain[-1]] + [plain[c - s] + v for s, v in zip(sizes.tolist(), values.tolist()) if s <= c]))
        assert np.allclose(best, plain)
