"""Collocations against plain counting, with shards, ranges and unions of any size."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import collocations as C

DDL = "doc_id long, text string, lang string"


def plain(rows, max_words=3, least=10, top=2000, share=50):
    f, n = defaultdict(Counter), Counter()
    upper = {c: c + 32 for c in range(65, 91)}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(upper)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        gone = {g[i:i + k] for g, a in cand.items() for k in range(2, len(g)) for i in range(len(g) - k + 1)
                if 100 * a >= share * counts[g[i:i + k]]}
        some = []
        for g, a in cand.items():
            cuts = [(1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            if g not in gone:
                some.append((score, a, " ".join(g), counts[g[:k]], counts[g[k:]]))
        some.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, left, right, n[lang], score)
                for i, (score, a, p, left, right) in enumerate(some[:top], 1)]
    return sorted(out)


def texts(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "new", "york", "city", "of", "été", "Été", "日本", "\x01a", "a b", "x", "naïve", "#1"]
    words += [f"w{i}" for i in range(30)]
    gaps = [" "] * 8 + ["  ", "\t", ". ", ", ", "\n", "\x0b", "?!", " ; "]
    rows = []
    for i in range(n):
        body = "".join(words[min(int(rng.expovariate(0.2)), len(words) - 1)] + rng.choice(gaps)
                       for _ in range(rng.randint(0, 60)))
        rows.append((i, body, rng.choice(["en", "en", "en", "fr", None, "und"])))
    return rows + [(1, "new york city " * 50, "en"), (1, "new york city " * 50, "en"), (None, None, None), (2, "", "en"),
                   (3, " \t.,", "zz")]


def mined(df, **kw):
    return sorted(map(tuple, C.mine(df, **kw).collect()))


@pytest.mark.parametrize("kw", [{}, {"shard_bytes": 2000, "paths": 40, "fan": 3}, {"least": 3, "top": 7, "share": 80}])
def test_against_counting(spark, kw):
    rows = texts(3)
    want = plain(rows, **{k: v for k, v in kw.items() if k in ("least", "top", "share")})
    assert mined(spark.createDataFrame(rows, DDL), **kw) == want and want


def test_longer_phrases(spark):
    rows = texts(4)
    assert mined(spark.createDataFrame(rows, DDL), max_words=4, paths=100) == plain(rows, max_words=4)


def test_n_grams_across_slices_of_a_long_text(spark):
    rng = random.Random(1)
    body = " ".join(rng.choice(["ab", "cd", "ef", "gh", "i."]) for _ in range(900_000))       # about 2.6 MB: three slices
    rows = [(1, body, "en"), (2, "x" * 3_000_000 + " ab cd", "en")]
    assert mined(spark.createDataFrame(rows, DDL).coalesce(1), shard_bytes=1 << 19) == plain(rows)


def test_empty_table_and_other_columns(spark):
    assert mined(spark.createDataFrame([], DDL)) == []
    df = spark.createDataFrame([(i, "a b", "en", "x", 1) for i in range(12)], DDL + ", phrase string, shard int")
    assert mined(df) == [("en", 1, "a b", 12, 12, 12, 24, 1_000_000)]


def test_transducers():
    rng = np.random.default_rng(0)
    words = sorted({bytes(rng.integers(97, 102, rng.integers(1, 4)).astype(np.uint8)) for _ in range(60)})
    made = []
    for seed in range(6):
        ids = np.unique(rng.integers(0, len(words), (200, 3)), axis=0)
        counts = rng.integers(1, 9, len(ids))
        t = C.Transducer.build(words, ids, counts)
        made.append((t, dict(zip((tuple(words[i] for i in r) for r in ids), counts.tolist()))))
        assert dict(zip((tuple(t.words[i] for i in r) for r in t.paths()[0]), t.paths()[1].tolist())) == made[-1][1]
        assert t.phrases() == sorted(t.phrases(), key=lambda p: p.split(b" "))
        again = C.Transducer.of(t.to_bytes())
        assert again.phrases() == t.phrases()
    both = Counter()
    for _, d in made:
        both.update(d)
    union = C.Transducer.union([t for t, _ in made], 3)
    assert dict(zip(map(lambda p: tuple(p.split(b" ")), union.phrases()), union.paths()[1].tolist())) == {
        k: v for k, v in both.items() if v >= 3}
    asked = made[0][0]
    got = union.compose(asked)
    assert dict(zip(got.phrases(), got.paths()[1].tolist())) == {
        b" ".join(k): both[k] for k in made[0][1] if both[k] >= 3}
    cut = dict(union.cut([(b"b",), (b"c", b"d"), (b"zz",)]))
    assert [p for t in cut.values() for p in t.phrases()] == union.phrases()


def test_equal_ends_share_their_states():
    words = [bytes([97 + i]) for i in range(20)]
    ids = np.array([(i, 18, 19) for i in range(18)])
    t = C.Transducer.build(words, ids, np.arange(5, 23))
    assert [len(level[1]) for level in t.levels] == [18, 1, 1]
