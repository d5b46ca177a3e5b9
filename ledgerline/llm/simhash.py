"""SimHash near-duplicates by a binary-trie self-join.

1. Each text becomes a 64-bit fingerprint (majority of its shingle hashes).
2. The bits are cut into one block more than may differ. Two fingerprints
   within the budget agree on a whole block, so each distinct fingerprint goes
   to one cell for each block: four copies, however large the input. Crowded
   cells are cut again by the bits that are still free.
3. In a cell the fingerprints form a binary trie below the bits they share.
   The task walks it with itself, pairs of nodes level by level, adds up
   differing bits and drops a pair as soon as the budget is exceeded; small
   node pairs are compared bit by bit.
4. A task reports a spanning forest of the links it found, never all pairs of
   a dense group, and connected components join the forests.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows and equal texts share a fingerprint and so a component;
an empty table gives an empty table; extra columns are ignored. A null doc_id
keeps its row and is never a component's name unless nothing else is there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, partitions, texts, written
from .components import connected_components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
CELL = 1 << 18               # fingerprints of a cell at most
BLOCK = 1 << 16
FRONTIER = 1 << 17


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Words are split at ASCII white space after lower-casing A-Z; bytes do
    both. Shingles are hashed in blocks, so memory does not grow with the text."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams, n = [b" ".join(words)], 1
    else:
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    grams, ones = iter(grams), np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        block = np.fromiter((digest(g, seed) for _, g in zip(range(min(BLOCK, n - at)), grams)),
                            dtype=np.uint64, count=min(BLOCK, n - at))
        bits = np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as the signed long of the same bits."""
    def batch(ids, bodies):
        fps = np.array([fingerprint(t, shingle, seed) for t in bodies], dtype=np.uint64)
        return {"doc_id": ids, "fp": fps.view(np.int64)}
    return map_texts(docs, batch, "doc_id long, fp long")


def free_bits(used: int) -> list[int]:
    """Bits that no block so far has fixed, the highest first."""
    return [b for b in range(63, -1, -1) if not used >> b & 1]


def blocks_of(used: int, max_bits: int) -> list[list[int]]:
    """The free bits in ``max_bits`` + 1 blocks, about even: fingerprints that
    agree on the fixed bits and differ in at most ``max_bits`` others agree on
    all of one block at least. (Below that many free bits a cell holds at most
    2 to the power of ``max_bits`` fingerprints and is not cut.)"""
    return [part.tolist() for part in np.array_split(free_bits(used), max_bits + 1)]


def picked(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of ``fp`` at these places, as numbers."""
    out = np.zeros(len(fp), np.uint64)
    for b in bits:
        out = out << np.uint64(1) | (fp >> np.uint64(b) & np.uint64(1))
    return out


def turned(fp: np.ndarray, first: list[int], rest: list[int]) -> np.ndarray:
    """``fp`` with its bits in the order ``first``, ``rest``: the trie below
    starts with the bits that its fingerprints have in common."""
    return picked(fp, first) << np.uint64(len(rest)) | picked(fp, rest)


class Forest:
    """Union-find over positions that keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)
        self.links: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.root[i], self.root[j]
        new = a != b
        if not new.any():
            return
        pairs, at = np.unique(np.stack([a[new], b[new]], axis=1), axis=0, return_index=True)
        i, j, parent = i[new][at], j[new][at], self.root

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x
        for (x, y), p, q in zip(pairs.tolist(), i.tolist(), j.tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.links.append((p, q))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def trie_links(values: np.ndarray, common: int, max_bits: int, forest: Forest, leaf: int = 64) -> None:
    """Walk the trie of ``values`` (sorted) with itself, from the nodes at depth
    ``common`` on: only values that agree on the bits above are linked.

    A trie node is a range of values and its children meet at the first value
    with the next bit set. The frontier is worked off in blocks, depth first,
    which bounds memory."""
    if len(values) < 2:
        return
    head = values >> np.uint64(64 - common) if common else np.zeros(len(values), np.uint64)
    lo = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    hi = np.append(lo[1:], len(values))
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    todo = [(common, np.stack((lo, hi, lo, hi, np.zeros(len(lo), np.int64)), axis=1))]

    def middle(lo, hi, depth):
        bit = np.uint64(1) << np.uint64(63 - depth)
        head = values[lo] & ~(bit | (bit - np.uint64(1)))
        return np.clip(np.searchsorted(values, head | bit), lo, hi)

    while todo:
        depth, nodes = todo.pop()
        if len(nodes) > FRONTIER:
            todo.append((depth, nodes[FRONTIER:]))
            nodes = nodes[:FRONTIER]
        size = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        small = (size <= leaf) | (depth == 64)
        done, nodes = nodes[small], nodes[~small]
        for at in range(0, len(done), FRONTIER // 8):
            compare(values, done[at:at + FRONTIER // 8], max_bits, forest)
        if not len(nodes):
            continue
        same = nodes[:, 0] == nodes[:, 2]
        ma = middle(nodes[:, 0], nodes[:, 1], depth)
        mb = middle(nodes[:, 2], nodes[:, 3], depth)
        alo, ahi, blo, bhi, diff = nodes.T
        children = [np.stack(c, axis=1) for c in (
            (alo, ma, blo, mb, diff), (ma, ahi, mb, bhi, diff), (alo, ma, mb, bhi, diff + 1))]
        children.append(np.stack((ma, ahi, blo, mb, diff + 1), axis=1)[~same])
        nodes = np.concatenate(children)
        keep = (nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (nodes[:, 4] <= max_bits)
        if keep.any():
            todo.append((depth + 1, nodes[keep]))


def compare(values: np.ndarray, nodes: np.ndarray, max_bits: int, forest: Forest) -> None:
    """Every value pair of small node pairs."""
    if not len(nodes):
        return
    alo, ahi, blo, bhi, _ = nodes.T
    width = bhi - blo
    size = (ahi - alo) * width
    which = np.repeat(np.arange(len(nodes)), size)
    at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    i, j = alo[which] + at // width[which], blo[which] + at % width[which]
    near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= max_bits)
    forest.add(i[near], j[near])


def route(rows: DataFrame, max_bits: int) -> DataFrame:
    """Each row (fp, used) once for each block of its free bits: ``used`` then
    has the block's bits too, and ``cell`` is what the fingerprint has there."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fps, masks = pdf["fp"].to_numpy().view(np.uint64), pdf["used"].to_numpy().view(np.uint64)
            for used in np.unique(masks):
                fp = fps[masks == used]
                for bits in blocks_of(int(used), max_bits):
                    mask = used | np.bitwise_or.reduce(np.uint64(1) << np.array(bits, np.uint64))
                    yield pd.DataFrame({"fp": fp.view(np.int64), "used": np.full(len(fp), mask).view(np.int64),
                                        "cell": (fp & mask).view(np.int64)})
    return rows.mapInPandas(run, "fp long, used long, cell long")


def walk(pdf: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """The links in cells that have the same bits fixed. With these bits put
    first, the cells are the nodes of one trie at the depth where they end."""
    used = int(pdf["used"].iloc[0]) & (1 << 64) - 1
    fixed = [b for b in range(63, -1, -1) if used >> b & 1]
    fp = pdf["fp"].to_numpy()
    values = turned(fp.view(np.uint64), fixed, free_bits(used))
    order = np.argsort(values, kind="stable")
    values, fp = values[order], fp[order]
    forest = Forest(len(values))
    trie_links(values, len(fixed), max_bits, forest)
    links = np.array(forest.links, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": fp[links[:, 0]], "b": fp[links[:, 1]]})


def near_links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, target: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at ``max_bits``
    or fewer differing bits: a spanning forest of each group of cells, so that
    the components are those of all links.

    Cells over ``target`` fingerprints are routed on by their free bits until
    they are small; only their rows get more copies. Cells are small at the
    latest when all bits are fixed, as fingerprints are distinct."""
    spark = distinct_fps.sparkSession
    target = max(target, 1 << max_bits)
    rows, links = distinct_fps.select("fp", F.lit(0).cast("long").alias("used")), None
    while True:
        cells = route(rows, max_bits)
        crowded = written(cells.groupBy("used", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > target)
                          .select("used", "cell"), "crowded-cells")
        more = not crowded.isEmpty()
        small = cells.join(crowded, ["used", "cell"], "left_anti") if more else cells
        # small cells share a group, so that a call's cost is in its rows
        groups = max(partitions(spark), rows.count() // target)
        found = (small.withColumn("part", F.pmod(F.xxhash64("used", "cell"), F.lit(groups))).groupBy("used", "part")
                 .applyInPandas(lambda pdf: walk(pdf, max_bits), "a long, b long"))
        links = found if links is None else links.unionByName(found)
        if not more:
            return links
        rows = written(cells.join(crowded, ["used", "cell"], "left_semi").select("fp", "used").distinct(), "crowded-rows")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                       seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, n_same): one row for each input row;
    n_same counts the documents with the very same fingerprint."""
    fps = written(fingerprints(texts(docs, id_col, text_col), shingle, seed), "fingerprints")
    groups = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"),
                                           F.count(F.lit(1)).alias("n_same")), "fp-groups")
    roots = connected_components(near_links(groups, max_bits))
    named = groups.join(roots, groups.fp == roots.node, "left").select(
        "fp", "first_id", "n_same", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.join(least, "root").select("fp", "n_same", "component_id")
    return fps.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")
