"""Best-fit packing by a configuration linear program.

1. Every document becomes token ids and the end id, cut into pieces of at most
   ``max_len`` ids. A piece keeps its length and the checksum of its ids, and
   the number it has among the pieces of that length in its task.
2. The histogram of piece lengths (at most ``max_len`` numbers, whatever the
   size of the input) goes to the driver. A configuration says how many pieces
   of which lengths share a sequence; the linear program asks for the fewest
   sequences whose configurations hold all pieces. It is solved by
   multiplicative weights: lengths that are short of room gain weight, and a
   knapsack dynamic program over the capacity finds the configurations of the
   greatest weight, one through each of the lengths that are furthest behind.
3. The fractional solution is rounded: whole multiples of its configurations
   first, then once more each as long as pieces for it remain; what is left of
   the histogram is placed by best fit.
4. The plan is a list of intervals over the pieces in the order of (length,
   number). A piece's place in that order is its number plus the counts of
   earlier tasks, so nothing is sorted and no length has to fit into one task;
   its interval gives sequence and offset.

Defined results: null and empty texts are one piece that holds the end id;
repeated rows are packed each; a null doc_id is an id like any other; an empty
table gives an empty table; extra columns are ignored; very long texts are
encoded in slices."""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, texts, written

MAX_LEN = 4096
TOKENIZER = "word_bpe_49k.json"
END = 1
SLICE = 1 << 20          # characters of a text worked on at once
CACHE = 400_000          # words, and pieces of words, kept by a worker
ROUNDS, BATCH, STEP = 60, 96, 0.5

# Fixed value: how word_bpe_49k.json cuts a normalised text.
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# What the library takes as white space; str.split() also splits at \x1c to \x1f.
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
# Words of these letters are the same in every version of Unicode and in every
# normal form; all others are left to the library as a whole.
PLAIN = regex.compile(r"[!-~\xa1-\u012f\u0131-\u017f]{1,64}")


def byte_letters() -> str:
    """Byte-level vocabularies write byte b as letter b of this string: as
    itself where that is visible, else as the next free letter from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in set(seen) else next(rest)) for b in range(256))


def packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=1)
def word_encoder(path: str) -> "WordEncoder":
    """One for all tasks of a worker, so that they share its bounded caches."""
    return WordEncoder(path)


class WordEncoder:
    """Ids of a text by a ``tokenizers`` file whose pieces never hold white
    space: each different word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.letters = {b: ord(c) for b, c in enumerate(byte_letters())}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def by_library(self, text: str) -> bytes:
        return packed(self.lib.encode(text, add_special_tokens=False).ids)

    def part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            body = part if part.isascii() else part.encode("utf-8").decode("latin-1").translate(self.letters)
            got = packed([t.id for t in self.model.tokenize(body)])
            self.parts[part] = got
        return got

    def word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and len(word) <= 64:
            return self.part(word.lower())
        if not PLAIN.fullmatch(word) or "<|" in word:      # odd letters, very long, or a special string
            return self.by_library(word)
        return b"".join(map(self.part, WORD_PIECES.findall(word.lower())))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        words = SPACE.split(text) if ODD_SPACE.search(text) else text.split()
        known = self.words
        new = set(words).difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.word(w) if w else b""
        return b"".join(map(known.__getitem__, words))

    def slices(self, text: str, size: int = SLICE) -> Iterator[bytes]:
        """The ids of a text, a slice that ends before white space at a time."""
        at = 0
        while at < len(text):
            end = SPACE.search(text, at + size) if at + size < len(text) else None
            stop = end.start() if end else len(text)
            yield self.encode(text[at:stop])
            at = stop


def token_pieces(docs: DataFrame, path: str, max_len: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth) of all texts."""
    width = 4 * max_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, np.int64)
        for batch in pieces(batches, 256):
            row, piece, length, crc = [], [], [], []

            def add(i: int, k: int, ids: bytes) -> None:
                row.append(i)
                piece.append(k)
                length.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))

            for i, text in enumerate(batch.column("text")):
                open_, k = b"", 0
                for ids in encoder.slices(text.as_py() or ""):
                    open_ += ids
                    whole = len(open_) // width                 # an end id is still to come
                    for at in range(0, whole * width, width):
                        add(i, k, open_[at:at + width])
                        k += 1
                    open_ = open_[whole * width:]
                add(i, k, open_ + END.to_bytes(4, "little"))
            nth = np.zeros(len(length), np.int64)
            for j, n in enumerate(length):
                nth[j] = seen[n]
                seen[n] += 1
            k = np.array(piece, np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(k),
                "start": pa.array(k.astype(np.int64) * max_len), "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array([task] * len(k), pa.int32()),
                "nth": pa.array(nth)})
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


# ---------------------------------------------------------------- the linear program, over the histogram

def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best value, last item or -1) for every capacity from 0 on, each item
    as often as wished; ``sizes`` ascending."""
    best = np.zeros(capacity + 1)
    item = np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], item[c] = best[c - 1], -1                 # -1: one place stays empty
        k = fits[c]
        if k:
            total = best[c - sizes[:k]] + values[:k]
            j = int(total.argmax())
            if total[j] > best[c]:
                best[c], item[c] = total[j], j
    return best, item


def through(i: int, sizes: np.ndarray, values: np.ndarray, counts: np.ndarray, best: np.ndarray, item: np.ndarray,
            capacity: int) -> dict[int, int]:
    """The best configuration that holds item ``i``; no more copies than there
    are (an item that is used up gives way to the next best)."""
    config = {i: 1}
    free = counts > 0
    free[i] = counts[i] > 1
    c = capacity - int(sizes[i])
    while c > 0:
        j = int(item[c])
        if j < 0:
            c -= 1
            continue
        if not free[j]:
            k = int(np.searchsorted(sizes, c, side="right"))
            total = np.where(free[:k], best[c - sizes[:k]] + values[:k], -1.0)
            j = int(total.argmax())
            if total[j] < 0:
                break
        config[j] = config.get(j, 0) + 1
        free[j] = config[j] < counts[j]
        c -= int(sizes[j])
    return config


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, batch: int = BATCH,
                   step: float = STEP) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often each is used, a fractional cover of the
    histogram, by multiplicative weights.

    The weight of a length falls as it is covered. Each round prices a room of
    ``s`` places at the share of weight it brings, starting from the value of
    the places themselves, and adds a step of the best configurations through
    the lengths that are covered least."""
    m = len(sizes)
    covered = np.zeros(m)
    used: dict[tuple, float] = {}
    for _ in range(rounds):
        behind = np.maximum(0.0, 1.0 - covered / counts)
        if not behind.any():
            break
        values = sizes * np.exp(-2.0 * covered / counts)
        best, item = knapsack(sizes, values, capacity)
        open_ = np.flatnonzero(behind > 0)
        # largest first where they are equally far behind: they have the fewest partners
        for i in open_[np.lexsort((-sizes[open_], -np.round(behind[open_], 2)))][:batch].tolist():
            if covered[i] >= counts[i]:
                continue
            config = through(i, sizes, values, counts, best, item, capacity)
            of, n = np.array(list(config)), np.array(list(config.values()), float)
            room = np.maximum(counts[of] - covered[of], step * counts[of] / 4)
            amount = min(step * counts[i] / config[i], float((room / n).min()))
            key = tuple(sorted(config.items()))
            used[key] = used.get(key, 0.0) + amount
            covered[of] += amount * n
    return [(dict(k), x) for k, x in used.items()]


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on a histogram: bins that are alike are kept
    together with their number."""
    by_gap: dict[int, list[tuple[tuple, int]]] = {}
    gaps = np.zeros(capacity + 1, np.int64)                 # bins by free places

    def put(gap: int, config: tuple, n: int) -> None:
        by_gap.setdefault(gap, []).append((config, n))
        gaps[gap] += n

    for i in np.argsort(-sizes, kind="stable").tolist():
        left, size = int(counts[i]), int(sizes[i])
        while left:
            fit = np.flatnonzero(gaps[size:])
            if not len(fit):
                each = capacity // size
                if left >= each:
                    put(capacity - each * size, ((i, each),), left // each)
                if left % each:
                    put(capacity - left % each * size, ((i, left % each),), 1)
                break
            gap = int(fit[0]) + size
            config, n = by_gap[gap].pop()
            gaps[gap] -= n
            each = min(gap // size, left)                   # the tightest bin stays the tightest until it is full
            bins = min(n, left // each)
            if bins < n:
                put(gap, config, n - bins)
            put(gap - each * size, config + ((i, each),), bins)
            left -= bins * each
    return [(dict(config), n) for held in by_gap.values() for config, n in held]


def rounded(found: list[tuple[dict[int, int], float]], sizes: np.ndarray, counts: np.ndarray, capacity: int,
            waste: float) -> list[tuple[dict[int, int], int]]:
    """Whole multiples of the configurations that leave at most ``waste``
    places empty, and best fit for the pieces that are left."""
    left = counts.astype(np.int64).copy()
    out = []
    for config, x in found:
        of, n = np.array(list(config)), np.array(list(config.values()))
        times = int(min(x, (left[of] // n).min()))
        if times > 0 and capacity - int(sizes[of] @ n) <= waste:
            left[of] -= times * n
            out.append((config, times))
    rest = np.flatnonzero(left)
    for config, times in best_fit(sizes[rest], left[rest], capacity):
        out.append(({int(rest[j]): n for j, n in config.items()}, times))
    return out


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(configuration, number of sequences): holds every piece exactly once.
    ``sizes`` ascending and different. Of the roundings that trust more or fewer
    configurations of the program's solution, the one with fewest sequences."""
    if not len(sizes):
        return []
    found = sorted(configurations(sizes, counts, capacity), key=lambda c: -c[1])
    volume = int(sizes @ counts)
    least = max(-(-volume // capacity), int(counts[2 * sizes > capacity].sum()))     # no packing has fewer
    choices = [rounded(found, sizes, counts, capacity, waste) for waste in (0, capacity - volume / least, capacity, -1)]
    return min(choices, key=lambda c: sum(n for _, n in c))


# ---------------------------------------------------------------- in Spark

def intervals(sizes: np.ndarray, counts: np.ndarray, sequences: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan as intervals over the pieces in the order of (length, number):
    where each starts, its copies in a sequence, first sequence, first offset."""
    of, copies, times, first, offset = [], [], [], [], []
    number = 0
    for config, n in sequences:
        at = 0
        for i, k in sorted(config.items(), reverse=True):
            of.append(i)
            copies.append(k)
            times.append(n)
            first.append(number)
            offset.append(at)
            at += k * int(sizes[i])
        number += n
    of, copies, times = np.array(of, np.int64), np.array(copies, np.int64), np.array(times, np.int64)
    turn = np.argsort(of, kind="stable")
    held = (copies * times)[turn]
    return {"start": np.cumsum(held) - held, "copies": copies[turn], "first": np.array(first, np.int64)[turn],
            "offset": np.array(offset, np.int64)[turn]}


def placed(numbered: DataFrame, slots: dict[str, np.ndarray]) -> DataFrame:
    """``numbered`` (with ``place``, the piece's place in the order) with its
    sequence and offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, length = batch.column("place").to_numpy(), batch.column("length").to_numpy()
            s = np.searchsorted(slots["start"], place, side="right") - 1
            inside = place - slots["start"][s]
            each = slots["copies"][s]
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {
                    "sequence_id": pa.array(slots["first"][s] + inside // each),
                    "offset": pa.array(slots["offset"][s] + inside % each * length)})
    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row
    for each piece."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    cut = written(token_pieces(texts(docs, id_col, text_col), path, max_len), "token-pieces")
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    hist = sorted((r.length, r.n) for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect())   # <= max_len rows
    sizes, counts = np.array([h[0] for h in hist], np.int64), np.array([h[1] for h in hist], np.int64)
    slots = intervals(sizes, counts, plan(sizes, counts, max_len))
    # of a length: all pieces of shorter ones come first, then those of earlier tasks
    shorter = dict(zip(sizes.tolist(), (np.cumsum(counts) - counts).tolist()))
    spark = docs.sparkSession
    lengths = spark.createDataFrame(list(shorter.items()), "length long, shorter long")                        # <= max_len rows
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = (per_task.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
             .join(F.broadcast(lengths), "length")
             .select("length", "task", (F.col("shorter") + F.col("earlier")).alias("base")))
    return placed(cut.join(bases, ["length", "task"]).withColumn("place", F.col("base") + F.col("nth")), slots)
