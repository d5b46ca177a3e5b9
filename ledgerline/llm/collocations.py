"""Mining of phrase collocations with weighted acyclic automata.

1. A task reads texts into shards of a few MB for each language and sorts the
   n-grams of a shard. From the sorted list a count transducer is built
   incrementally: in that order a state is complete as soon as an n-gram leaves
   its prefix, and a complete state that equals a frozen one is replaced by it.
   Arcs are words, and the weights along a path add up to the count; the least
   count below a state is pushed in front of it, so that more states are equal.
2. Transducers are cut by prefix ranges (their bounds come from a bounded sample
   of n-grams and only balance the work), and the pieces of a range are united:
   weights of equal paths are added. Paths below the least count are left out.
3. n-grams are counted by length. An n-gram can only be frequent if the two
   shorter ones in it are; those are known from the length before, as a Bloom
   filter of bounded size, whose false positives the exact counts remove.
4. The parts of the candidates of a range form an acceptor, which is cut by the
   ranges of the part's transducers and composed with them; the composed
   transducers return to the candidates' range, where all cuts are scored.

No step is keyed by a word: a range that holds a frequent word is as large as
any other, and a transducer asked by very many ranges is asked in several
tasks.

Defined results: null texts are empty and a null lang is ``und``; repeated rows
count again; very long texts are read in slices (n-grams across them count); an
empty table gives an empty table; extra columns are ignored. Words are compared
as UTF-8 bytes; only A-Z is lower-cased."""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, mix64, written

MAX_WORDS = 3
LEAST = 10
TOP = 2000
SHARD_BYTES = 5 << 19        # under 2^21 words
SLICE = 1 << 20
RANGE = 1 << 19              # paths of a prefix range, about
FAN = 2048                   # transducers united at once
SAMPLE = 200_000             # n-grams that bounds are taken from
FILTER_BITS = (1 << 15, 1 << 30)

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + SEPARATORS,
                        b"abcdefghijklmnopqrstuvwxyz " + b"." * len(SEPARATORS))
GAP = re.compile(rb"[ .]")
END = b"."                   # stands between pieces; no word has one


# ---------------------------------------------------------------- transducers

def distinct_rows(ids: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first) of the rows of ``ids``: how to sort them, and where a new
    row begins in that order."""
    key, top = ids[:, 0].astype(np.int64), n_words
    for c in range(1, ids.shape[1]):
        if top * n_words >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            top = len(key)
        key = key * n_words + ids[:, c]
        top *= n_words
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order


def frozen_states(first: np.ndarray, size: np.ndarray, labels: np.ndarray, weights: np.ndarray,
                  targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state of each, which are new): the states whose arcs begin at ``first``,
    in their order; one with the arcs of an earlier one becomes that one.
    Equal arcs are found by a hash and then compared."""
    arcs = mix64(labels.astype(np.uint64) + mix64(weights.astype(np.uint64) + mix64(targets.astype(np.uint64))))
    place = (np.arange(len(labels)) - np.repeat(first, size)).astype(np.uint64)
    key = np.add.reduceat(arcs * (place * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)), first)
    _, earliest, same = np.unique(key, return_index=True, return_inverse=True)
    twin = earliest[same]
    equal = size[twin] == size
    row = np.repeat(np.arange(len(first)), np.where(equal, size, 0))
    at = np.flatnonzero(np.repeat(equal, size))
    other = first[twin][row] + place[at].astype(np.int64)
    differs = (labels[at] != labels[other]) | (weights[at] != weights[other]) | (targets[at] != targets[other])
    equal[row[differs]] = False
    twin = np.where(equal, twin, np.arange(len(first)))
    new = twin == np.arange(len(first))
    return (np.cumsum(new) - 1)[twin].astype(np.int32), new


def small(numbers: np.ndarray) -> np.ndarray:
    """Non-negative numbers in as few bytes as hold them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max()) if len(numbers) else 0))


class Transducer:
    """A minimal acyclic automaton over words, all paths of one length, with
    weights. ``words`` are sorted and are the labels; ``levels[d]`` are the
    arcs of the states at depth d: where each state's arcs begin, labels,
    weights, and the states they lead to."""

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, ...]]):
        self.words, self.levels = words, levels

    @staticmethod
    def build(words: list[bytes] | pa.Array, ids: np.ndarray, counts: np.ndarray) -> "Transducer":
        """From sorted different n-grams (rows of ``ids``)."""
        used = np.zeros(len(words), bool)
        for c in range(ids.shape[1]):
            used[ids[:, c]] = True
        number = (np.cumsum(used) - 1).astype(np.int32)
        labels = [number[ids[:, c]] for c in range(ids.shape[1])]
        weights, targets = counts.astype(np.int64), np.zeros(len(ids), np.int32)
        begins = np.zeros(len(ids), bool)                # where a new prefix begins, for each length of it
        begins[0] = True
        prefixes = [begins.copy()]
        for column in labels[:-1]:
            begins[1:] |= column[1:] != column[:-1]
            prefixes.append(begins.copy())
        levels = []
        for depth in range(len(labels) - 1, -1, -1):
            first = np.flatnonzero(prefixes[depth])
            size = np.diff(np.append(first, len(weights)))
            least = np.minimum.reduceat(weights, first) if depth else np.zeros(1, np.int64)
            rest = weights - np.repeat(least, size)
            state, frozen = frozen_states(first, size, labels[depth], rest, targets)
            arcs = np.flatnonzero(np.repeat(frozen, size))
            levels.append((np.concatenate([[0], np.cumsum(size[frozen])]), labels[depth][arcs], rest[arcs], targets[arcs]))
            prefixes = [p[first] for p in prefixes[:depth]]
            labels = [c[first] for c in labels[:depth]]
            weights, targets = least, state
        kept = np.flatnonzero(used)
        kept = words.take(pa.array(kept)).to_pylist() if isinstance(words, pa.Array) else [words[i] for i in kept.tolist()]
        return Transducer(kept, levels[::-1])

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams in order (rows of word numbers) and their counts."""
        state, weight = np.zeros(1, np.int64), np.zeros(1, np.int64)
        ids = np.zeros((1, 0), np.int32)
        for starts, labels, weights, targets in self.levels:
            n = starts[state + 1] - starts[state]
            row = np.repeat(np.arange(len(state)), n)
            arc = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + starts[state][row]
            ids = np.column_stack([ids[row], labels[arc]])
            weight = weight[row] + weights[arc]
            state = targets[arc].astype(np.int64)
        return ids, weight

    def compose(self, asked: "Transducer") -> "Transducer":
        """The paths of ``asked`` that are also paths here, with the weights here."""
        ids, _ = asked.paths()
        found = self.weights(asked.words, ids)
        return Transducer.build(asked.words, ids[found > 0], found[found > 0]) if (found > 0).any() else EMPTY

    def weights(self, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        """The weight here of each n-gram of ``ids`` (over ``words``), 0 if it is no path."""
        known = pc.index_in(pa.array(words, pa.binary()), value_set=pa.array(self.words, pa.binary()))
        label = np.array(known.fill_null(-1)).astype(np.int64)
        state, weight = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        alive = np.ones(len(ids), bool) if self.levels else np.zeros(len(ids), bool)
        n = max(1, len(self.words))
        for depth, (starts, labels, weights, targets) in enumerate(self.levels):
            arcs = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * n + labels
            here = label[ids[:, depth]]
            alive &= here >= 0
            wanted = np.where(alive, state * n + here, 0)
            at = np.minimum(np.searchsorted(arcs, wanted), len(arcs) - 1)
            alive &= arcs[at] == wanted
            weight += np.where(alive, weights[at], 0)
            state = np.where(alive, targets[at], 0)
        return np.where(alive, weight, 0)

    @staticmethod
    def union(parts: list["Transducer"], least: int = 1) -> "Transducer":
        """Weights of equal paths added; paths under ``least`` left out."""
        parts = [p for p in parts if p.levels]
        if not parts:
            return EMPTY
        coded = pa.concat_arrays([pa.array(p.words, pa.binary()) for p in parts]).dictionary_encode()
        turn = pc.sort_indices(coded.dictionary)
        words = coded.dictionary.take(turn)
        label = np.empty(len(words), np.int32)
        label[np.array(turn)] = np.arange(len(words), dtype=np.int32)
        label = label[np.array(coded.indices)]
        ids, counts, at = [], [], 0
        for p in parts:
            i, c = p.paths()
            ids.append(label[at:at + len(p.words)][i])
            counts.append(c)
            at += len(p.words)
        rows, counts = np.concatenate(ids), np.concatenate(counts)
        order, first = distinct_rows(rows, len(words))
        counts = np.add.reduceat(counts[order], first)
        keep = counts >= least
        if not keep.any():
            return EMPTY
        return Transducer.build(words, rows[order[first[keep]]], counts[keep])

    def cut(self, bounds: list[tuple[bytes, ...]]) -> Iterator[tuple[int, "Transducer"]]:
        """(range, the paths inside it) of each range that has some; bound k is
        the first n-gram of range k + 1."""
        ids, counts = self.paths()
        if not bounds:
            yield 0, self
            return
        word = self.words
        at = [bisect_left(range(len(ids)), b, key=lambda r: tuple(word[i] for i in ids[r])) for b in bounds]
        for k, (lo, hi) in enumerate(zip([0, *at], [*at, len(ids)])):
            if lo < hi:
                yield k, Transducer.build(word, ids[lo:hi], counts[lo:hi])

    def phrases(self, rows: np.ndarray | None = None) -> list[bytes]:
        ids = self.paths()[0]
        return [b" ".join(self.words[i] for i in r) for r in (ids if rows is None else ids[rows]).tolist()]

    def to_bytes(self) -> bytes:
        return pickle.dumps((b"\n".join(self.words), [tuple(map(small, level)) for level in self.levels]), protocol=5)

    @staticmethod
    def of(blob: bytes) -> "Transducer":
        words, levels = pickle.loads(blob)
        return Transducer(words.split(b"\n") if levels else [],
                          [(s.astype(np.int64), a.astype(np.int32), w.astype(np.int64), t.astype(np.int32))
                           for s, a, w, t in levels])


EMPTY = Transducer([], [])


# ---------------------------------------------------------------- shards

class Filter:
    """A Bloom filter of n-grams with two bits each; None lets everything pass."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def places(hashes: np.ndarray, n_bits: int) -> list[np.ndarray]:
        mask = np.uint64(n_bits - 1)
        return [(hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes, len(self.bits) * 8):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def row_hashes(word_hash: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    out = mix64(word_hash[columns[0]])
    for c in columns[1:]:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word_hash[c])
    return out


def split_words(body: bytes) -> pa.Array:
    """The words of ``body``, which has no white space but blanks."""
    text = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(body)], np.int32)), pa.py_buffer(body)])
    words = pc.ascii_split_whitespace(text).values.cast(pa.binary())
    return words.filter(pc.greater(pc.binary_length(words), 0))


def shard(body: bytes, order: int, lang: str, known: Filter | None) -> tuple[Transducer, int, int, list[bytes]]:
    """The transducer of the n-grams of ``order`` words inside the pieces of
    ``body``, the numbers of its words and of its
    paths, and some of the n-grams. ``known`` says
    which n-grams one word shorter may be frequent."""
    coded = split_words(body).dictionary_encode()
    if not len(coded):
        return EMPTY, 0, 0, []
    turn = pc.sort_indices(coded.dictionary)
    words = coded.dictionary.take(turn)
    rank = np.empty(len(words), np.int32)
    rank[np.array(turn)] = np.arange(len(words), dtype=np.int32)
    ids = rank[np.array(coded.indices)]
    mark = pc.index(words, END).as_py()
    inside = ids != mark
    n_words = int(inside.sum())
    n = len(ids) - order + 1
    if order == 1:
        counts = np.bincount(ids, minlength=len(words))
        if mark >= 0:
            counts[mark] = 0
        rows = np.flatnonzero(counts)
        counts = counts[rows]
        rows = rows.astype(np.int32).reshape(-1, 1)
    elif n <= 0:
        return EMPTY, n_words, 0, []
    else:
        if known is None:
            ok = np.ones(n, bool)
        elif order == 2:
            one = known.holds(row_hashes(word_hashes(words.to_pylist(), lang), [np.arange(len(words))]))[ids]
            ok = one[:-1] & one[1:]
        else:
            hashes = word_hashes(words.to_pylist(), lang)
            ok = inside[:n].copy()
            for k in range(1, order):
                ok &= inside[k:n + k]
            at = np.flatnonzero(ok)
            ok[at] = known.holds(row_hashes(hashes, [ids[at + k] for k in range(order - 1)]))
            at = np.flatnonzero(ok)
            ok[at] = known.holds(row_hashes(hashes, [ids[at + k] for k in range(1, order)]))
        for k in range(order):
            ok &= inside[k:n + k]
        at = np.flatnonzero(ok)
        rows = np.column_stack([ids[at + k] for k in range(order)])
        turn, first = distinct_rows(rows, len(words))
        rows, counts = rows[turn[first]], np.diff(np.append(first, len(turn)))
    if not len(rows):
        return EMPTY, n_words, 0, []
    some = np.unique(np.linspace(0, len(rows) - 1, min(64, len(rows))).astype(np.int64))
    heads = [b" ".join(words[i].as_py() for i in r) for r in rows[some].tolist()]
    return Transducer.build(words, rows, counts), n_words, len(rows), heads


def shards(docs: DataFrame, order: int, known, shard_bytes: int) -> DataFrame:
    """(lang, shard, n_words, n_paths, heads, blob) of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        size = 0
        filter_ = Filter(np.frombuffer(known.value, np.uint8)) if known is not None else None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            give_back()
            for lang, bodies in held.items():
                t, n_words, n_paths, heads = shard(b"".join(bodies), order, lang, filter_)
                if not n_words:
                    continue
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang], pa.string()), "shard": pa.array([task << 32 | number], pa.int64()),
                    "n_words": pa.array([n_words], pa.int64()), "n_paths": pa.array([n_paths], pa.int64()),
                    "heads": pa.array([heads], pa.list_(pa.binary())),
                    "blob": pa.array([t.to_bytes()], pa.binary())})
                number += 1

        for batch in batches:
            for lang, raw in zip(batch.column("lang"), batch.column("text")):
                lang, body = lang.as_py(), raw.as_py().translate(PLAIN)
                at = 0
                while at < len(body):
                    stop = GAP.search(body, at + SLICE) if at + SLICE < len(body) else None
                    to = stop.start() if stop else len(body)
                    part = body[at:to].replace(END, b" . ")
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    at = to
                    if size >= shard_bytes:
                        # n-grams that go on in the next slice start again with the words in front of it
                        more = order > 1 and at < len(body)
                        tail = b" ".join(b"".join(held[lang]).split()[1 - order:]) if more else b""
                        yield from flush()
                        held, size = ({lang: [tail]} if tail else {}), len(tail)
                if lang in held:
                    held[lang].append(b" . ")
        yield from flush()
        give_back()
    return docs.mapInArrow(run, "lang string, shard long, n_words long, n_paths long, heads array<binary>, blob binary")


# ---------------------------------------------------------------- ranges

def range_bounds(found: DataFrame, paths: int) -> dict[str, list[tuple[bytes, ...]]]:
    """First n-grams of the ranges after the first, by language, for languages
    with more than ``paths`` paths; from a sample of at most about SAMPLE."""
    large = {r.lang: r.paths for r in found.groupBy("lang").agg(F.sum("n_paths").alias("paths"))
             .where(F.col("paths") > paths).collect()}
    if not large:
        return {}
    heads = found.where(F.col("lang").isin(list(large))).select(
        "lang", "shard", (F.col("n_paths") / F.size("heads")).alias("weight"), F.posexplode("heads").alias("k", "head"))
    thin = -(-heads.count() // SAMPLE)
    by_lang: dict[str, list] = {lang: [] for lang in large}
    for r in heads.where(F.pmod(F.xxhash64("shard", "k"), F.lit(thin)) == 0).select("lang", "weight", "head").collect():
        by_lang[r.lang].append((tuple(bytes(r["head"]).split(b" ")), r.weight))
    out = {}
    for lang, some in by_lang.items():
        some.sort()
        reached = np.cumsum([w for _, w in some])
        parts = -(-large[lang] // paths)
        at = np.searchsorted(reached, reached[-1] * np.arange(1, parts) / parts) if some else []
        out[lang] = sorted({some[min(int(k), len(some) - 1)][0] for k in at})
    return out


def in_ranges(found: DataFrame, bounds: dict) -> DataFrame:
    """(lang, range, shard, blob): the transducers cut by the bounds."""
    if not bounds:
        return found.select("lang", F.lit(0).alias("range"), "shard", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, number, blob in zip(*(batch.column(c) for c in ("lang", "shard", "blob"))):
                cut = list(Transducer.of(blob.as_py()).cut(bounds.get(lang.as_py(), [])))
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang.as_py()] * len(cut), pa.string()),
                    "range": pa.array([k for k, _ in cut], pa.int32()),
                    "shard": pa.array([number.as_py()] * len(cut), pa.int64()),
                    "blob": pa.array([t.to_bytes() for _, t in cut], pa.binary())})
    return found.select("lang", "shard", "blob").mapInArrow(run, "lang string, range int, shard long, blob binary")


def united(cut: DataFrame, n_shards: int, least: int, fan: int) -> DataFrame:
    """(lang, range, n_paths, blob): per range the union of all transducers,
    ``fan`` at a time, without paths under ``least``."""
    def union(at_least: int, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            t = Transducer.union([Transducer.of(b) for b in pdf["blob"]], at_least)
            give_back()
            out = {"lang": pdf["lang"].iloc[:1], "range": pdf["range"].iloc[:1], "shard": pdf["shard"].iloc[:1],
                   "n_paths": len(t.paths()[0]) if t.levels else 0, "blob": t.to_bytes()}
            return pd.DataFrame(out)[["lang", "range", "n_paths" if last else "shard", "blob"]]
        return run

    groups = -(-n_shards // fan)
    while groups > 1:
        cut = (cut.groupBy("lang", "range", F.pmod(F.xxhash64("shard"), F.lit(groups)))
               .applyInPandas(union(1, False), "lang string, range int, shard long, blob binary"))
        groups = -(-groups // fan)
    return (cut.groupBy("lang", "range").applyInPandas(union(least, True), "lang string, range int, n_paths long, blob binary")
            .where("n_paths > 0"))


def frequent_filter(frequent: DataFrame):
    """The frequent n-grams as a broadcast Bloom filter: 16 bits for each, at
    most 128 MB."""
    spark = frequent.sparkSession
    n = frequent.agg(F.sum("n_paths")).first()[0] or 0
    n_bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * int(n)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob in zip(batch.column("lang"), batch.column("blob")):
                t = Transducer.of(blob.as_py())
                ids, _ = t.paths()
                hashes = row_hashes(word_hashes(t.words, lang.as_py()), list(ids.T))
                yield pa.RecordBatch.from_pydict({"bit": pa.array(np.concatenate(Filter.places(hashes, n_bits)) + 1)})

    places = frequent.select("lang", "blob").mapInArrow(run, "bit long")
    bits = np.zeros(n_bits // 8, np.uint8)
    for r in places.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).toLocalIterator():
        bits[(r.bucket - 1) * 4096:][:4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return spark.sparkContext.broadcast(bits.tobytes())


# ---------------------------------------------------------------- parts of candidates

def sub_grams(ids: np.ndarray, size: int) -> list[np.ndarray]:
    return [ids[:, k:k + size] for k in range(ids.shape[1] - size + 1)]


def questions(frequent: DataFrame, bounds: dict[int, dict]) -> DataFrame:
    """The shorter n-grams inside the candidates of a range, as acceptors cut
    by the ranges of their length: (lang, of, at, order, range, n_paths, blob)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["lang", "order", "range"]).to_pylist():
                t = Transducer.of(batch.column("blob")[0].as_py())
                batch = batch.slice(1)
                ids, _ = t.paths()
                for of in range(1, row["order"]):
                    rows = np.concatenate(sub_grams(ids, of))
                    turn, first = distinct_rows(rows, len(t.words))
                    acceptor = Transducer.build(t.words, rows[turn[first]], np.ones(len(first), np.int64))
                    for at, part in acceptor.cut(bounds[of].get(row["lang"], [])):
                        yield pa.RecordBatch.from_pydict({
                            "lang": pa.array([row["lang"]], pa.string()), "of": pa.array([of], pa.int32()),
                            "at": pa.array([at], pa.int32()), "order": pa.array([row["order"]], pa.int32()),
                            "range": pa.array([row["range"]], pa.int32()),
                            "n_paths": pa.array([len(part.paths()[0])], pa.int64()),
                            "blob": pa.array([part.to_bytes()], pa.binary())})
    return (frequent.where("order > 1").select("lang", "order", "range", "blob")
            .mapInArrow(run, "lang string, of int, at int, order int, range int, n_paths long, blob binary"))


def answers(frequent: DataFrame, asked: DataFrame, paths: int) -> DataFrame:
    """(lang, order, range, of, blob): the acceptors composed with the count
    transducers. A transducer that is asked for many paths is copied to as many
    tasks as keep the questions of each at the size of a range."""
    held = {r.order: r.n for r in frequent.groupBy("order").agg(F.count(F.lit(1)).alias("n")).collect()}
    copies = {r.of: max(1, -(-r.n // (paths * held.get(r.of, 1))))
              for r in asked.groupBy("of").agg(F.sum("n_paths").alias("n")).collect()}
    if not copies:
        copies = {1: 1}
    n = F.lit(1)
    for of, c in copies.items():
        n = F.when(F.col("of") == of, c).otherwise(n)
    none = F.lit(None).cast("int")
    tables = (frequent.select("lang", F.col("order").alias("of"), F.col("range").alias("at"), "blob")
              .where(F.col("of").isin(list(copies)))
              .select("lang", "of", "at", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("copy"),
                      none.alias("order"), none.alias("range"), "blob"))
    parts = asked.select("lang", "of", "at", F.pmod(F.xxhash64("order", "range"), n).cast("int").alias("copy"),
                         "order", "range", "blob")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["order"].isna()
        out = pdf[~own]
        tables = [Transducer.of(b) for b in pdf.loc[own, "blob"]]
        table = tables[0] if tables else EMPTY
        return pd.DataFrame({"lang": out["lang"], "order": out["order"].astype("int32"),
                             "range": out["range"].astype("int32"), "of": out["of"],
                             "blob": [table.compose(Transducer.of(b)).to_bytes() for b in out["blob"]]})
    return (tables.unionByName(parts).groupBy("lang", "of", "at", "copy")
            .applyInPandas(run, "lang string, order int, range int, of int, blob binary"))


def scored(frequent: DataFrame, answered: DataFrame, share: int) -> DataFrame:
    """(lang, phrase, a, l, r, score, drops): all candidates, and the shorter
    phrases each of them drops."""
    own = frequent.where("order > 1").select("lang", "order", "range", F.lit(0).alias("of"), "blob")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts: dict[int, list[Transducer]] = {}
        for of, blob in zip(pdf["of"], pdf["blob"]):
            parts.setdefault(of, []).append(Transducer.of(blob))
        t = parts[0][0]
        ids, a = t.paths()
        k = ids.shape[1]

        def count(rows: np.ndarray) -> np.ndarray:
            return sum(p.weights(t.words, rows) for p in parts[rows.shape[1]]).astype(object)

        many = a.astype(object)                     # Python's numbers: products may pass 64 bits
        best = None
        for cut in range(1, k):
            left, right = count(ids[:, :cut]), count(ids[:, cut:])
            score = 1_000_000 * many * many // (left * right)
            if best is None:
                best = [left, right, score]
            else:
                lower = score < best[2]
                best = [np.where(lower, new, old) for new, old in zip((left, right, score), best)]
        drops: list[list[str]] = [[] for _ in a]
        for size in range(2, k):
            for rows in sub_grams(ids, size):
                for i in np.flatnonzero(100 * many >= share * count(rows)).tolist():
                    drops[i].append(b" ".join(t.words[w] for w in rows[i].tolist()).decode("utf-8"))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "phrase": [p.decode("utf-8") for p in t.phrases()],
                             "a": a, "l": best[0].astype(np.int64), "r": best[1].astype(np.int64),
                             "score": best[2].astype(np.int64), "drops": drops})
    return (own.unionByName(answered).groupBy("lang", "order", "range")
            .applyInPandas(run, "lang string, phrase string, a long, l long, r long, score long, drops array<string>"))


def mine(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, share: int = 50,
         text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES, paths: int = RANGE,
         fan: int = FAN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to
    ``max_words`` words of each language."""
    docs = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    known, bounds, frequent, words = None, {}, None, None
    for order in range(1, max_words + 1):
        found = written(shards(docs, order, known, shard_bytes), f"grams-{order}")
        if known is not None:
            known.destroy()
        if order == 1:
            words = found.groupBy("lang").agg(F.sum("n_words").alias("n"))
        found = found.where("n_paths > 0")
        bounds[order] = range_bounds(found, paths)
        kept = written(united(in_ranges(found, bounds[order]), found.count(), least, fan)
                       .withColumn("order", F.lit(order)), f"frequent-{order}")
        frequent = kept if frequent is None else frequent.unionByName(kept)
        known = frequent_filter(kept) if order < max_words else None
    asked = written(questions(frequent, bounds), "asked-parts")
    candidates = written(scored(frequent, answers(frequent, asked, paths), share), "candidates")
    dropped = candidates.select("lang", F.explode("drops").alias("phrase")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = candidates.drop("drops").join(dropped, ["lang", "phrase"], "left_anti").withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                           "n", "score")


# The same in SQL: pieces, words, their n-grams, cuts, drops and ranks.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[.,;:!?
-
]') AS parts FROM documents),
piece AS (SELECT lang, regexp_extract_all(unnest(parts), '[^ 	]+') AS w FROM pieces),
n_words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (SELECT unnest([1, 2, 3]) AS k))
  GROUP BY lang, k, phrase),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM grams WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, l.f AS l, r.f AS r,
         ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN grams l ON l.lang = c.lang AND l.k = c.j AND l.phrase = array_to_string(c.w[1:c.j], ' ')
  JOIN grams r ON r.lang = c.lang AND r.k = c.k - c.j AND r.phrase = array_to_string(c.w[c.j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
dropped AS (
  SELECT s.lang, s.phrase FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
    FROM cand WHERE k = 3) t
  JOIN cand s ON s.lang = t.lang AND s.phrase = t.phrase AND s.k = 2 WHERE 100 * t.a >= 50 * s.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM best b WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = b.lang AND d.phrase = b.phrase))
SELECT ranked.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM ranked JOIN n_words ON n_words.lang = ranked.lang WHERE rank <= 2000
"""
