"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs in a text with at most k edits shares at
least m - q + 1 - k q of its q-grams with it, and all of them on diagonals
(place in the text less place in the passage) that lie at most k apart. For
every text

1. the q-grams that occur in the benchmark are looked up (a bitmap first, then
   the exact index),
2. hits are counted in overlapping diagonal bands, each passage with bands wide
   enough for its k, so that any k + 1 neighbouring diagonals lie in one band,
3. regions whose count meets the bound are verified by an alignment of the
   whole passage inside the band's diagonals.

A run of one sign would meet every place of such a run in a passage. Its
q-grams have no postings: how many pairs lie on a diagonal follows from where
the two runs begin and end. All other hits are expanded in slices of bounded
size, of which only the counts by band are kept.

Case and runs of white space do not count. k is ``EDITS`` of the passage's
length; a passage too short for the bound gets the largest k that keeps it at
one, and one shorter than a q-gram has to occur unchanged.

The benchmark is the query set: it is taken in blocks of bounded size, each
block's index goes to all tasks, and all texts are read once for each block.
Huge texts are worked through in overlapping blocks.

Defined results: null and blank texts are clean; null and blank passages are
ignored; repeated passages are reported each, repeated texts too; empty tables
give no rows; extra columns are ignored (``drop_contaminated`` passes them on)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, mix64, pieces, texts

Q = 8
EDITS = 0.1
BLOCK_CHARS = 1 << 19        # passages' characters in one index
TEXT_BLOCK = 1 << 20         # characters of a text looked at together
BITMAP_BITS = 24
HITS = 1 << 19               # postings expanded at once


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of every q-gram (q is 8: three doublings)."""
    h = codes.astype(np.uint64) + np.uint64(1)
    for span, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        if len(h) <= span:
            return np.empty(0, np.uint64)
        h = h[:-span] * np.uint64(factor) + (h[span:] ^ (h[span:] >> np.uint64(29)))
    return mix64(h)


def sign_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(sign, first, last + 1) of the q-grams inside runs of one sign."""
    if len(codes) < Q:
        return []
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    size = np.diff(np.append(first, len(codes)))
    long_ = size >= Q
    return [(int(codes[a]), a, a + n - Q + 1) for a, n in zip(first[long_].tolist(), size[long_].tolist())]


class Index:
    """q-gram postings of a block of passages."""

    def __init__(self, passages: list[tuple[int, str]], edits: float = EDITS):
        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in passages) if t]
        self.short = [n for n, (_, t) in enumerate(self.items) if len(t) < Q]
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.k = np.maximum(0, np.minimum((self.size * edits).astype(np.int64), (self.size - Q) // Q))
        self.bound = np.maximum(1, self.size - Q + 1 - self.k * Q)
        self.width = self.k + 1                      # a band spans two widths, the next starts one later
        grams, item, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self.runs: dict[int, list[tuple[int, int, int]]] = {}        # sign -> (passage, first and last + 1 q-gram)
        for n, (_, t) in enumerate(self.items):
            codes = codes_of(t)
            h = gram_hashes(codes)
            plain = np.ones(len(h), bool)
            for sign, lo, hi in sign_runs(codes):
                self.runs.setdefault(sign, []).append((n, lo, hi))
                plain[lo:hi] = False
            where = np.flatnonzero(plain)
            grams.append(h[where])
            item.append(np.full(len(where), n))
            at.append(where)
        grams, item, at = map(np.concatenate, (grams, item, at))
        order = np.argsort(grams, kind="stable")
        self.grams, self.first, count = np.unique(grams[order], return_index=True, return_counts=True)
        self.count, self.item, self.at = count, item[order], at[order]
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[self.grams >> np.uint64(64 - BITMAP_BITS)] = True
        self.longest = int(self.size.max()) if len(self.items) else 0

    def bands(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, band, hits) of the q-grams that meet, in parts; a band and
        the one after it make up what is counted together."""
        h = gram_hashes(codes)
        hit = np.flatnonzero(self.bitmap[h >> np.uint64(64 - BITMAP_BITS)]) if len(self.grams) else np.empty(0, np.int64)
        if len(hit):
            slot = np.minimum(np.searchsorted(self.grams, h[hit]), len(self.grams) - 1)
            true = self.grams[slot] == h[hit]
            hit, slot = hit[true], slot[true]
            end = np.cumsum(self.count[slot])
            lo = 0
            while lo < len(hit):
                done = end[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(end, done + HITS, side="right")))
                count = self.count[slot[lo:hi]]
                post = np.repeat(self.first[slot[lo:hi]] - np.cumsum(count) + count, count) + np.arange(count.sum())
                item = self.item[post]
                band = (np.repeat(hit[lo:hi], count) - self.at[post] + self.longest) // self.width[item]
                pair, n = np.unique(item << 40 | band, return_counts=True)
                yield pair >> 40, pair & ((1 << 40) - 1), n
                lo = hi
        if self.runs:
            for sign, lo, hi in sign_runs(codes):
                for n, first, last in self.runs.get(sign, ()):
                    diagonal = np.arange(lo - last + 1, hi - first)
                    pairs = np.minimum(hi, last + diagonal) - np.maximum(lo, first + diagonal)
                    band = (diagonal + self.longest) // int(self.width[n])
                    start = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
                    yield np.full(len(start), n), band[start], np.add.reduceat(pairs, start)

    def regions(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(passage, lowest diagonal) of the bands that meet their bound."""
        parts = list(self.bands(codes))
        if not parts:
            return []
        item, band, n = (np.concatenate(c) for c in zip(*parts))
        key = np.concatenate([item << 40 | band, item << 40 | np.maximum(band - 1, 0)])
        n = np.concatenate([n, np.where(band > 0, n, 0)])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat(n, first)
        which, band = key[first] >> 40, key[first] & ((1 << 40) - 1)
        good = n >= self.bound[which]
        return list(zip(which[good].tolist(), (band[good] * self.width[which[good]] - self.longest).tolist()))

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, least edits found) for each passage within its budget."""
        body = normal(text)
        found: dict[int, int] = {n: 0 for n in self.short if self.items[n][1] in body}
        step = TEXT_BLOCK
        reach = self.longest * 2 + 64
        for at in range(0, max(1, len(body)), step):
            part = body[at:at + step + reach]
            if len(part) < Q:
                continue
            codes = codes_of(part)
            seen: set[tuple] = set()                     # long runs make very many equal regions
            for n, low in self.regions(codes):
                if found.get(n) == 0:
                    continue
                width, k = int(self.width[n]), int(self.k[n])
                passage = self.items[n][1]
                region = part[max(0, low):max(0, low + 2 * width + len(passage))]
                if (n, min(0, low), region) in seen:
                    continue
                seen.add((n, min(0, low), region))
                d = 0 if passage in region else banded_edits(codes_of(passage), codes, low, 2 * width, k)
                if d is not None and d < found.get(n, d + 1):
                    found[n] = d
        return sorted((self.items[n][0], d) for n, d in found.items())


def banded_edits(passage: np.ndarray, text: np.ndarray, low: int, width: int, k: int) -> int | None:
    """Fewest edits of the whole passage against any part of the text, on the
    ``width`` diagonals from ``low`` on, or None above k. A row has one cell for
    each diagonal; the rows end when no cell is within the budget."""
    # places in front of and behind the text match nothing, which is as good as leaving the passage's sign out
    none = np.uint32(0xFFFFFFFF)
    lead = max(0, -low)
    span = text[max(0, low):max(0, low + len(passage) + width)]
    b = np.full(len(passage) + width, none, np.uint32)
    b[lead:lead + len(span)] = span[:max(0, len(b) - lead)]
    place = np.arange(width)
    row = np.zeros(width, np.int64)                        # a match may start on any diagonal
    for i, c in enumerate(passage.tolist()):
        new = row + (b[i:i + width] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)       # the passage's sign left out
        row = np.minimum.accumulate(new - place) + place   # signs of the text left out
        if row.min() > k:
            return None
    return int(row.min())


def index_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes of the benchmark, one block of bounded size after the other."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"),
                             F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        yield Index([(r.item_id, r.text) for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits): the passages found in each text."""
    body = texts(docs, id_col, text_col)
    out = None
    for index in index_blocks(benchmark, block_chars=block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def batch(ids, bodies, shared=shared):
            found = [(i, m) for i, t in zip(ids, bodies) for m in shared.value.matches(t)]
            return {"doc_id": [i for i, _ in found], "item_id": [m[0] for _, m in found],
                    "edits": [m[1] for _, m in found]}
        part = map_texts(body, batch, "doc_id long, item_id long, edits int")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                      block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with all its columns, without the rows that hold a passage."""
    for index in index_blocks(benchmark, block_chars=block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                bodies = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not shared.value.matches(t) for t in bodies], pa.bool_()))
        docs = docs.mapInArrow(keep, docs.schema)
    return docs
