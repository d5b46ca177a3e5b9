"""SimHash components against all-pairs brute force."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from ledgerline.llm import simhash
from ledgerline.llm.components import connected_components


def brute_fp(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, bits=3):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, d in enumerate(ids):
        r = find(i)
        groups[r] = min(groups.get(r, d), d)
    return {d: groups[find(i)] for i, d in enumerate(ids)}


def test_components_equal_brute_force(spark):
    base = "the quick brown fox jumps over one lazy dog while " * 6
    rows = [(i, base + f"tail {i % 7} end") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "  \t\n"), (103, "one"), (104, "One two"), (105, base.upper()),
             (106, "ünï çode wörd ñ " * 30), (107, "a b c " * 50_000), (107, "a b c " * 50_000)]
    rng = np.random.default_rng(1)
    rows += [(200 + i, " ".join(rng.choice(["ba", "do", "ki", "lu", "me"], 12))) for i in range(150)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string")
    got = [tuple(r)[:3] for r in simhash.simhash_components(df).collect()]
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components([d for d, _ in rows], fps)
    want = [(d, f"{f:016x}", comp[d]) for (d, _), f in zip(rows, fps)]
    assert sorted(got) == sorted(want)


def test_trie_finds_every_component_in_dense_and_sparse_sets(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = set(rng.integers(0, 2**63, 2000, dtype=np.uint64).tolist())
    for c in centre.tolist():
        for _ in range(40):
            x = c
            for b in rng.integers(0, 64, 5):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for target in (50, 1 << 18):     # many small cells, few
        links = simhash.near_links(df, 3, target=target)
        roots = {r.node: r.root for r in connected_components(links).collect()}
        want = brute_components(fps, fps)
        got = {}
        for f in fps:
            s = int(np.uint64(f).view(np.int64))
            got.setdefault(roots.get(s, s), set()).add(f)
        expect = {}
        for f in fps:
            expect.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))


def classes(links, fps):
    roots = {r.node: r.root for r in connected_components(links).collect()}
    out = {}
    for f in fps:
        s = int(np.uint64(f).view(np.int64))
        out.setdefault(roots.get(s, s), set()).add(f)
    return sorted(map(sorted, out.values()))


def test_cells_are_cut_by_their_free_bits(spark):
    """All fingerprints share 24 bits, many share more; two differ only in the last bits that get free."""
    rng = np.random.default_rng(3)
    top = 0xABCDEF << 40
    fps = {top | int(x) for x in rng.integers(0, 1 << 40, 700)} | {top | int(x) for x in rng.integers(0, 1 << 12, 500)}
    fps = sorted(fps | {top ^ (1 << 63), top ^ (1 << 62 | 1 << 30 | 1)})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    want = {}
    for f, c in brute_components(fps, fps).items():
        want.setdefault(c, set()).add(f)
    assert classes(simhash.near_links(df, 3, target=60), fps) == sorted(map(sorted, want.values()))


def test_copies_do_not_grow(spark):
    for n in (100, 4000):
        rows = spark.range(n).selectExpr("xxhash64(id) AS fp", "0L AS used")
        assert simhash.route(rows, 3).count() == 4 * n


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(200)] + [(5000, 5000)]
    got = {r.node: r.root for r in connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1
    assert len({got[2000 + i] for i in range(200)} | {got[1000]}) == 1
    assert got[0] != got[1000] and 5000 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
