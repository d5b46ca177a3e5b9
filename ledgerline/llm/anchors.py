"""Windows and their anchors, shared by the two exact substring operators.

A window is a fixed number of consecutive items (words or bytes) of one text.
Each window names one anchor inside it, chosen by the window's content alone
(the smallest hash among its candidates, the leftmost of equal ones). Equal
windows therefore have equal anchors at the same distance, so only texts that
share an anchor need comparing. Consecutive windows mostly choose the same
anchor: one row stands for all of them (its *context* is what they cover), and
every window belongs to exactly one row."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, written

BLOCK_BITS = 20                       # windows handled at once: bounds memory for huge texts
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Prefix:
    """Fingerprints of any stretch of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.up, self.down = _powers(max(12, int(n + 1).bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def fixed(self, width: int) -> np.ndarray:
        """All stretches of ``width`` values."""
        n = len(self.sums) - width
        return mix64((self.sums[width:] - self.sums[:n]) * self.down[:n])


def choose(candidates: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each ``width`` consecutive candidates (hashes, FAR where there is
    none) the position of the smallest; returned as runs (position, first
    window, number of windows)."""
    n = len(candidates) - width + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    low = np.uint64((1 << (BLOCK_BITS + 1)) - 1)
    packed = (candidates & ~low) | np.arange(len(candidates), dtype=np.uint64)
    packed[candidates == FAR] |= ~low
    span = 1
    while span * 2 <= width:
        packed = np.minimum(packed[:-span], packed[span:])
        span *= 2
    best = (np.minimum(packed[:n], packed[width - span:width - span + n]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    return best[first], first, np.diff(np.append(first, n))


def shared(anchors: DataFrame, who: str | None = None) -> DataFrame:
    """The rows of ``anchors`` (name, ctx, ...) whose name occurs more than
    once, or with more than one value of the column ``who`` if that is given;
    with ``contexts_differ``.

    Names are counted with partial aggregation, so a very frequent one costs a
    row for each task. The few that matter are written, so that the join that
    follows reads plain exchanges and Spark can split such a name."""
    names = (anchors.groupBy("name")
             .agg(*([F.min(who).alias("w0"), F.max(who).alias("w1")] if who else [F.count(F.lit(1)).alias("n")]),
                  F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
             .where("w0 <> w1" if who else "n > 1")
             .select("name", (F.col("c0") != F.col("c1")).alias("contexts_differ")))
    return anchors.join(written(names, "shared-names"), "name")


def covered(ranges: list[tuple[int, int]], n: int) -> np.ndarray:
    """Mask of the items inside any range [start, end)."""
    step = np.zeros(n + 1, np.int64)
    at = np.asarray(ranges, np.int64).reshape(-1, 2)
    np.add.at(step, at[:, 0], 1)
    np.add.at(step, np.minimum(at[:, 1], n), -1)
    return np.cumsum(step[:n]) > 0
