"""Both exact repeat removers against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import anchors, recompression, suffix_dedup

LAST = (1 << 63) - 1


def brute_words(rows, w=50):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (d, _), ws in zip(rows, words):
        for i in range(len(ws) - w + 1):
            s = tuple(ws[i:i + w])
            first[s] = min(first.get(s, LAST), LAST if d is None else d)
    out = []
    for (d, _), ws in zip(rows, words):
        gone = [False] * len(ws)
        for i in range(len(ws) - w + 1):
            if first[tuple(ws[i:i + w])] < (LAST if d is None else d):
                gone[i:i + w] = [True] * w
        kept = b" ".join(x for x, g in zip(ws, gone) if not g)
        out.append((d, len(ws), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def brute_bytes(rows, n=200):
    bodies = [(t or "").encode() for _, t in rows]
    count = Counter(b[i:i + n] for b in bodies for i in range(len(b) - n + 1))
    out = []
    for (d, _), b in zip(rows, bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i:i + n]] > 1:
                gone[i:i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [prose(70) for _ in range(4)]
    out = [(i, prose(rng.randrange(60)) + " " + " ".join(
        rng.choice([*passages, "zz zz zz zz zz zz"]) for _ in range(rng.randrange(3))) + "\n" + prose(rng.randrange(40)))
        for i in range(60)]
    return out + [(100, None), (101, ""), (102, "a " * 300), (103, "a " * 120), (104, "b a " * 100), (105, out[3][1]),
                  (105, out[3][1]), (105, out[4][1] + passages[0]), (None, passages[1] + passages[2]),
                  (106, "é ñ " * 120), (107, passages[0] + " x " + passages[0]), (90, passages[0])]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, name string")


def test_word_windows(spark, rows):
    got = recompression.remove_repeats(frame(spark, rows)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_words(rows)


@pytest.mark.parametrize("hot,shard_bytes", [(2000, 1 << 20), (3, 2000)])
def test_byte_strings(spark, rows, hot, shard_bytes):
    """Also with anchors dealt over several shards."""
    got = suffix_dedup.remove_repeats(frame(spark, rows), hot=hot, shard_bytes=shard_bytes).drop("kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_bytes(rows)


def test_a_line_common_to_very_many_texts(spark):
    """More contexts around one line than a shard may take of an anchor, by the
    default bound; borders agree by chance, and some texts go on alike."""
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(224))
    letters = "xy"
    rows = []
    for i in range(suffix_dedup.HOT + 300):
        front, back = ("".join(rng.choice(letters) for _ in range(rng.randrange(20, 260))) for _ in range(2))
        rows.append((i, front + line + back))
    rows += [(9000 + k, "left " + line[:150] + "x" * 60) for k in range(3)] + [(9100, rows[5][1][30:] + "q")]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).drop("kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_bytes(rows)


def test_narrower_anchors_lose_no_string(spark, rows):
    """Groups of every width, from the first anchor on."""
    got = suffix_dedup.remove_repeats(frame(spark, rows), hot=0).drop("kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_bytes(rows)


def test_rewrite_keeps_columns_and_drops_broken_characters(spark):
    tail = "é" * 150
    docs = frame(spark, [(1, "xa" + tail), (2, "yb" + tail + "ñ"), (3, "unique"), (4, None)])
    got = {r.doc_id: r.text for r in suffix_dedup.rewrite(docs).collect()}
    # the first byte of ñ is that of é, so it is repeated and the rest of ñ goes too
    assert got == {1: "xa", 2: "yb", 3: "unique", 4: None}
    assert suffix_dedup.rewrite(docs).columns == docs.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert recompression.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(4)
    for letters in (1, 2, 4, 26):
        for n in (1, 2, 5, 60, 300, 900):
            t = np.array([rng.randrange(letters) + 1 for _ in range(n)] + [0])
            want = sorted(range(n + 1), key=lambda i: t[i:].tolist())
            assert suffix_dedup.suffix_array(t).tolist() == want
            if n > 2:        # both ways of inducing give one order
                small = suffix_dedup.smaller_than_next(t)
                left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
                sizes = np.bincount(t)
                assert suffix_dedup.induce_by_bucket(t, small, left, sizes).tolist() == suffix_dedup.induce(
                    t, small, left, sizes).tolist()
            room = n - np.arange(n + 1)
            before, plcp = suffix_dedup.common_prefixes(t, np.array(want), room)
            for i in range(n + 1):
                j, k = before[i], 0
                while j >= 0 and i + k < n and j + k < n and t[i + k] == t[j + k]:
                    k += 1
                assert plcp[i] == (k if j >= 0 else 0)


def test_equal_words_get_equal_interior_symbols():
    rng = np.random.default_rng(5)
    inner = rng.integers(1, 4, 80).astype(np.uint64)     # few words: many runs
    seen = []
    for _ in range(20):
        ends = [rng.integers(1, 4, rng.integers(0, 30)).astype(np.uint64) for _ in range(2)]
        names, lengths, margin = recompression.recompress(np.concatenate([ends[0], inner, ends[1]]))
        start = np.cumsum(lengths) - lengths - len(ends[0])
        assert lengths.max() <= recompression.CAP
        inside = (start >= margin) & (start + lengths <= 80 - margin)
        seen.append([(s, n) for s, n in zip(start[inside].tolist(), names[inside].tolist())])
    assert all(s == seen[0] for s in seen) and seen[0]


def test_choose_takes_the_leftmost_smallest():
    values = np.array([5, 3, 3, 9, 1, 7], np.uint64) << np.uint64(40)
    pos, first, count = anchors.choose(values, 3)
    assert list(zip(pos.tolist(), first.tolist(), count.tolist())) == [(1, 0, 2), (4, 2, 2)]
