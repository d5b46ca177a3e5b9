"""Removal of repeated byte strings by suffix arrays built with induced sorting.

One suffix array over all text cannot be built in one place, so the text is
cut into shards that can be solved alone: every 200-byte string names an anchor
inside itself (see ``anchors``), equal strings name equal anchors, and a shard
holds all contexts of its anchors. Per shard, induced sorting gives the suffix
array in linear time: suffixes are classed as smaller or larger than the next,
the leftmost-smaller substrings are sorted recursively, and the order of all
others is induced from them. The permuted common-prefix array then tells for
each suffix how much it shares with its neighbour in the order.

Before that, equal contexts are merged: a context that occurs twice is repeated
as a whole, and only one of its copies goes into a shard (as a partner for
others). Anchors that occur once, or whose contexts are all equal and repeated,
need no shard. An anchor with more than ``HOT`` different contexts is replaced
by narrower ones: its strings are grouped by their distance to it, and a group
is named by the bytes all its strings share. Groups inside a common text become
equal contexts and merge, groups outside it lose their partners; what is open is
narrowed again, down to single strings, so no anchor has to fit into one task.

Defined results: null texts count as empty; matches never cross documents;
repeated rows repeat each other, also with equal ids; a null doc_id is an id
like any other here; an empty table gives an empty table; extra columns are
ignored."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as an
from .common import give_back, mix64, pieces, texts, unused, written

LENGTH = 200
GRAM = 32
SHARD_BYTES = 1 << 19
HOT = 2_000
LAST = (1 << 63) - 1


# ---------------------------------------------------------------- one shard

def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it; the last is."""
    step = np.sign(np.diff(t)).astype(np.int8)
    n = len(t)
    known = np.where(step != 0, np.arange(n - 1), n)       # equal letters take over what comes next
    nearest = np.minimum.accumulate(known[::-1])[::-1]
    out = np.ones(n, bool)
    inner = nearest < n
    out[:-1][inner] = step[nearest[inner]] > 0
    return out


def induce(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of all suffixes, given leftmost-smaller ones in their order (or
    any order of them by first letter): larger suffixes from left to right,
    then smaller ones from right to left.

    Each pass walks the order while it fills it. What a position feeds is
    looked up in one list: the letter in front of it, or -1 where that one is
    of the other class (also at the start and, as index -1, in empty places)."""
    n = len(t)
    ends = np.cumsum(sizes)
    placed = np.full(n, -1, np.int64)
    first = t[seeds]
    turn = np.argsort(first, kind="stable")
    count = np.bincount(first, minlength=len(sizes))
    c = first[turn]
    placed[(ends - count)[c] + np.arange(len(c)) - (np.cumsum(count) - count)[c]] = seeds[turn]
    order = placed.tolist()
    feeds = np.full(n + 1, -1, np.int64)
    feeds[1:n] = np.where(smaller[:-1], -1, t[:-1])
    into = feeds.tolist()
    head = (ends - sizes).tolist()
    for p in order:
        c = into[p]
        if c >= 0:
            at = head[c]
            order[at] = p - 1
            head[c] = at + 1
    feeds[1:n] = np.where(smaller[:-1], t[:-1], -1)
    into = feeds.tolist()
    tail = ends.tolist()
    for p in reversed(order):
        c = into[p]
        if c >= 0:
            tail[c] = at = tail[c] - 1
            order[at] = p - 1
    return np.array(order)


def induce_by_bucket(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same order as ``induce``, a bucket at a time in numpy; for texts
    with few letters. A bucket feeds itself while it holds runs of its letter,
    and each round of that is one step."""
    kinds = len(sizes)
    letters = t.astype(np.uint16)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    order = np.full(len(t), -1, np.int64)

    def by_letter(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        c = letters[p]
        turn = np.argsort(c, kind="stable")
        c = c[turn]
        count = np.bincount(c, minlength=kinds)
        return p[turn], c, count, np.arange(len(c)) - (np.cumsum(count) - count)[c]

    p, c, n_seeds, rank = by_letter(seeds)
    order[(ends - n_seeds)[c] + rank] = p
    head = starts.copy()

    def larger(q: np.ndarray) -> None:
        q = q[q >= 0]
        q = q[~smaller[q]]
        if len(q):
            q, c, count, rank = by_letter(q)
            order[head[c] + rank] = q
            head[:] += count

    for b in np.flatnonzero(sizes).tolist():
        at = starts[b]
        while at < head[b]:
            at, now = head[b], order[at:head[b]] - 1
            larger(now)
        larger(order[ends[b] - n_seeds[b]:ends[b]] - 1)
    tail = ends.copy()

    def less(q: np.ndarray) -> None:
        q = q[q >= 0]
        q = q[smaller[q]]
        if len(q):
            q, c, count, rank = by_letter(q)
            order[tail[c] - 1 - rank] = q
            tail[:] -= count

    for b in np.flatnonzero(sizes)[::-1].tolist():
        at = ends[b]
        while at > tail[b]:
            at, now = tail[b], order[tail[b]:at][::-1] - 1
            less(now)
        less(order[starts[b]:head[b]][::-1] - 1)
    return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative numbers; the last one must be the
    only smallest."""
    n = len(t)
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    small = smaller_than_next(t)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1      # leftmost-smaller positions
    sizes = np.bincount(t)
    by = induce_by_bucket if len(sizes) * 150 < n and len(sizes) < 1 << 16 else induce
    rough = by(t, small, left, sizes)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    ordered = rough[is_left[rough]]
    # name the leftmost-smaller substrings (up to and with the next such position)
    end = np.zeros(n, np.int64)
    end[left[:-1]] = left[1:]
    end[left[-1]] = n - 1
    a, b = ordered[:-1], ordered[1:]
    length = end[b] - b
    alike = np.flatnonzero(end[a] - a == length)
    off = 0
    equal = np.zeros(len(b), bool)
    while len(alike):
        alike = alike[t[a[alike] + off] == t[b[alike] + off]]
        done = length[alike] == off
        equal[alike[done]] = True
        alike = alike[~done]
        off += 1
    names = np.concatenate([[0], np.cumsum(~equal)])
    if names[-1] + 1 < len(left):
        name_at = np.zeros(n, np.int64)
        name_at[ordered] = names
        ordered = left[suffix_array(name_at[left])]
    return by(t, small, ordered, sizes)


def common_prefixes(t: np.ndarray, order: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, plcp) by text position: the suffix before it in the order (-1
    for the first) and how many letters they share, at most ``room`` of either.

    Where the letters in front of both agree, the value is one less than that
    of the position before; only the other positions are compared, eight
    letters at a time."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    p = np.arange(n)
    q = np.maximum(before, 0)
    follows = (p > 0) & (before > 0) & (t[p - 1] == t[q - 1]) & (room[p - 1] > 0)
    here = np.flatnonzero(~follows & (before >= 0))
    padded = np.concatenate([t, np.zeros(8, t.dtype)]).astype(np.uint64) & np.uint64(0xFF)
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight |= padded[k:k + n] << np.uint64(8 * k)
    limit = np.minimum(room[here], room[before[here]])
    got = np.zeros(len(here), np.int64)
    active = np.flatnonzero(limit > 0)
    while len(active):
        x = eight[here[active] + got[active]] ^ eight[before[here[active]] + got[active]]
        bits = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))    # zero bits below the first one
        got[active] += np.where(x == 0, 8, bits.astype(np.int64) // 8)
        active = active[(x == 0) & (got[active] < limit[active])]
    plcp = np.zeros(n, np.int64)
    plcp[here] = np.minimum(got, limit)
    base = np.maximum.accumulate(np.where(follows, 0, p))
    return before, np.where(follows, plcp[base] - (p - base), plcp)


def repeated_strings(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all ``length``-byte strings inside the bodies: (body, offset, repeated)."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\x00".join(bodies) + b"\x00", np.uint8).astype(np.int64) + 2
    ends = starts + sizes
    raw[ends] = 1                                    # ends of bodies sort before all bytes
    t = np.append(raw, 0)
    body = np.repeat(np.arange(len(bodies)), sizes + 1)
    room = np.append(ends[body] - np.arange(len(raw)), 0)
    order = suffix_array(t)
    before, plcp = common_prefixes(t - 2, order, room)
    joined = plcp >= length
    again = joined.copy()
    again[before[joined]] = True
    valid = np.flatnonzero(room >= length)
    return body[valid], valid - starts[body[valid]], again[valid]


# ---------------------------------------------------------------- in Spark

def text_anchors(raw: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(name, context fingerprint, first string, strings) in blocks."""
    n = len(raw) - length + 1
    for at in range(0, n, 1 << an.BLOCK_BITS):
        some = min(1 << an.BLOCK_BITS, n - at)
        values = np.frombuffer(raw, np.uint8, some + length - 1, at).astype(np.uint64) + np.uint64(1)
        prefix = an.Prefix(values)
        grams = prefix.fixed(gram)
        pos, first, count = an.choose(grams, length - gram + 1)
        ctx = prefix.of(first, first + count - 1 + length)
        ctx = mix64(ctx + (pos - first).astype(np.uint64) * an.BASE + count.astype(np.uint64))
        yield grams[pos], ctx, at + first, count


def scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Per document one row with n_bytes and digest, and its anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, digests, found = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = (text or "").encode("utf-8")
                sizes.append(len(raw))
                digests.append(hashlib.sha256(raw).hexdigest())
                found += [(i, *a) for a in text_anchors(raw, length, gram)]
            keys = {c: batch.column(c) for c in ("doc_id", "id", "th")}
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_pydict(keys | {
                "n_bytes": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.string()),
                "name": none, "ctx": none, "lo": none.cast(pa.int32()), "cnt": none.cast(pa.int32())})
            if found:
                of = pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]))
                name, ctx, lo, cnt = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3, 4))
                yield pa.RecordBatch.from_pydict({c: v.take(of) for c, v in keys.items()} | {
                    "n_bytes": pa.nulls(len(of), pa.int64()), "digest": pa.nulls(len(of), pa.string()),
                    "name": pa.array(name.view(np.int64)), "ctx": pa.array(ctx.view(np.int64)),
                    "lo": pa.array(lo.astype(np.int32)), "cnt": pa.array(cnt.astype(np.int32))})
    return docs.select("doc_id", "id", "th", "text").mapInArrow(
        run, "doc_id long, id long, th long, n_bytes long, digest string, name long, ctx long, lo int, cnt int")


def context_bodies(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The bytes of each place (id, th, lo, cnt, name, alone)."""
    per_doc = places.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "cnt", "name", "alone")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for i, (text, spans) in enumerate(zip(batch.column("text"), batch.column("spans").to_pylist())):
                raw = text.as_py().encode("utf-8")
                n = len(spans)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([batch.column("id")[i].as_py()] * n, pa.int64()),
                    "th": pa.array([batch.column("th")[i].as_py()] * n, pa.int64()),
                    "lo": pa.array([s["lo"] for s in spans], pa.int32()),
                    "name": pa.array([s["name"] for s in spans], pa.int64()),
                    "alone": pa.array([s["alone"] for s in spans], pa.bool_()),
                    "body": pa.array([raw[s["lo"]:s["lo"] + s["cnt"] - 1 + length] for s in spans], pa.binary())})
    return (docs.join(per_doc, ["id", "th"]).select("id", "th", "text", "spans").mapInArrow(
        run, "id long, th long, lo int, name long, alone boolean, body binary"))


def solve_shards(bodies: DataFrame, length: int) -> DataFrame:
    """(id, th, lo, hi): ranges of strings repeated inside a shard."""
    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "th", "lo", "name"]).sort_values(["id", "th", "lo", "name"], ignore_index=True)
        body, offset, again = repeated_strings(pdf["body"].tolist(), length)
        at = pdf["lo"].to_numpy()[body] + offset
        hit = again & pdf["alone"].to_numpy(bool)[body]
        b, x = body[hit], at[hit]
        first = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (x[1:] != x[:-1] + 1)])[:len(b)])
        last = np.append(first[1:], len(x))[:len(first)] - 1
        out = pd.DataFrame({"id": pdf["id"].to_numpy()[b[first]], "th": pdf["th"].to_numpy()[b[first]],
                            "lo": x[first], "hi": x[last] + length})
        give_back()
        return out.astype({"id": "int64", "th": "int64", "lo": "int32", "hi": "int32"})

    return bodies.groupBy("shard").applyInPandas(solve, "id long, th long, lo int, hi int")


def narrower(bodies: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """The contexts of anchors, cut into groups of ``width`` strings by their
    distance to the anchor: (id, th, lo, cnt, off, alone, name, ctx, body).

    The bytes that all strings of a group share are part of each of them, also
    where a context holds only some of the group: equal strings have equal
    names. ``off`` is the distance of the first string to the anchor; it is
    found from the bytes where it is not known yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[tuple] = []
            for i, (name, lo, off, body) in enumerate(zip(*(batch.column(c).to_pylist()
                                                            for c in ("name", "lo", "off", "body")))):
                prefix = an.Prefix(np.frombuffer(body, np.uint8).astype(np.uint64) + np.uint64(1))
                n = len(body) - length + 1
                if off is None:
                    off = int(an.choose(prefix.fixed(gram), length - gram + 1)[0][0])
                for group in range((off - n + 1) // width, off // width + 1):
                    first = max(0, off - group * width - width + 1)          # strings of this group
                    last = min(n - 1, off - group * width)
                    share = off - group * width                              # shared bytes: from here ...
                    core = prefix.of(np.array([share]), np.array([share - width + 1 + length]))[0]
                    out.append((i, lo + first, last - first + 1, off - first, name, group, core, body[first:last + length]))
            if not out:
                continue
            of, lo, cnt, off, name, group, core, body = zip(*out)
            names = mix64(np.array(name, np.int64).view(np.uint64) + mix64(
                np.array(core, np.uint64) + np.array(group, np.int64).view(np.uint64) * an.BASE + np.uint64(width)))
            prints = np.array([an.Prefix(np.frombuffer(b, np.uint8).astype(np.uint64) + np.uint64(1))
                               .of(np.array([0]), np.array([len(b)]))[0] for b in body], np.uint64)
            ctx = mix64(prints + np.array(off, np.uint64) * an.BASE + np.array(cnt, np.uint64))
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_pydict({c: batch.column(c).take(at) for c in ("id", "th", "alone")} | {
                "lo": pa.array(lo, pa.int32()), "cnt": pa.array(cnt, pa.int32()), "off": pa.array(off, pa.int32()),
                "name": pa.array(names.view(np.int64)), "ctx": pa.array(ctx.view(np.int64)),
                "body": pa.array(body, pa.binary())}).select(
                    ["id", "th", "lo", "cnt", "off", "alone", "name", "ctx", "body"])
    return bodies.select("id", "th", "lo", "name", "alone", "off", "body").mapInArrow(
        run, "id long, th long, lo int, cnt int, off int, alone boolean, name long, ctx long, body binary")


def narrowed(bodies: DataFrame, length: int, gram: int, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(ranges, contexts for shards) of anchors with too many contexts: groups
    of fewer and fewer strings, until none has more than ``hot`` contexts."""
    ranges, small = [], []
    width = length
    while width > 1:
        width = -(-width // 4)
        rows = written(narrower(bodies, length, gram, width), f"narrow-{width}")
        kinds = written(rows.groupBy("name", "ctx").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "lo", "cnt", "off", "alone", "body")).alias("place")),
            f"narrow-contexts-{width}")
        # rows whose whole group of strings has an equal
        ranges.append(rows.where("alone").join(kinds.where("n > 1").select("name", "ctx"), ["name", "ctx"])
                      .select("id", "th", "lo", (F.col("lo") + F.col("cnt") - 1 + length).alias("hi")))
        names = written(kinds.groupBy("name").agg(
            F.count(F.lit(1)).alias("contexts"), F.max(F.when(F.col("n") == 1, F.col("place.alone"))).alias("open"))
            .where("contexts > 1 and open"), f"narrow-open-{width}")
        left = kinds.join(names, "name").select(
            "place.id", "place.th", "place.lo", "place.off", "name", "contexts",
            ((F.col("n") == 1) & F.col("place.alone")).alias("alone"), "place.body")
        small.append(left.where(F.col("contexts") <= hot).drop("contexts", "off"))
        bodies = left.where(F.col("contexts") > hot).drop("contexts")
        if names.where(F.col("contexts") > hot).isEmpty():
            break
    return ranges, small


def repeated_ranges(docs: DataFrame, found: DataFrame, length: int, gram: int, shard_bytes: int, hot: int) -> DataFrame:
    """(id, th, lo, hi): byte ranges covered by repeated strings."""
    rows = written(an.shared(found), "shared-anchors")
    kinds = written(rows.groupBy("name", "ctx").agg(
        F.count(F.lit(1)).alias("n"), F.first("contexts_differ").alias("contexts_differ"),
        F.min(F.struct("id", "th", "lo", "cnt")).alias("place")), "contexts")
    whole = (rows.join(kinds.where("n > 1").select("name", "ctx"), ["name", "ctx"])
             .select("id", "th", "lo", (F.col("lo") + F.col("cnt") - 1 + length).alias("hi")))
    mixed = kinds.where("contexts_differ")
    names = written(mixed.groupBy("name").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("contexts"))
                    .where("least = 1"), "open-anchors")
    columns = ["id", "th", "lo", "name", "alone", "body"]

    def contexts(of: DataFrame) -> DataFrame:
        places = mixed.join(of, "name").select("place.*", "name", (F.col("n") == 1).alias("alone"))
        return context_bodies(docs, places, length).select(*columns)

    ranges, bodies = [whole], [contexts(names.where(F.col("contexts") <= hot))]
    crowded = names.where(F.col("contexts") > hot)
    if not crowded.isEmpty():
        first = written(contexts(crowded).withColumn("off", F.lit(None).cast("int")), "crowded-contexts")
        more, small = narrowed(first, length, gram, hot)
        ranges += more
        bodies += [b.select(*columns) for b in small]
    bodies = written(reduce(DataFrame.unionByName, bodies), "shard-contexts")
    size = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    if size:
        shards = max(1, math.ceil(size / shard_bytes))
        ranges.append(written(solve_shards(bodies.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards))), length),
                              "solved-shards"))
    return reduce(DataFrame.unionByName, ranges)


def cut(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, th, n_removed, n_spans, kept) of the documents in ``ranges``."""
    per_doc = ranges.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            removed, runs, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = np.frombuffer(text.encode("utf-8"), np.uint8)
                gone = an.covered([(s["lo"], s["hi"]) for s in spans], len(raw))
                removed.append(int(gone.sum()))
                runs.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                kept.append(raw[~gone].tobytes())
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "th": batch.column("th"), "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(kept, pa.binary())})
    return (docs.join(per_doc, ["id", "th"]).select("id", "th", "text", "spans")
            .mapInArrow(run, "id long, th long, n_removed long, n_spans long, kept binary"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
                   hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept is null
    where nothing was removed, else the remaining bytes."""
    docs = (texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
            .withColumn("id", F.coalesce("doc_id", F.lit(LAST))))
    scanned = written(scan(docs, length, gram), "byte-anchors")
    ranges = repeated_ranges(docs, scanned.where("name is not null").drop("doc_id", "n_bytes", "digest"),
                             length, gram, shard_bytes, hot)
    changed = cut(docs, ranges).dropDuplicates(["id", "th"])
    zero = F.lit(0).cast("long")
    return (scanned.where("name is null").select("doc_id", "id", "th", "n_bytes", "digest")
            .join(changed, ["id", "th"], "left")
            .select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
                    F.coalesce("n_spans", zero).alias("n_spans"),
                    F.coalesce(F.sha2("kept", 256), "digest").alias("kept_sha256"), "kept"))


def rewrite(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
            hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and the repeated bytes cut out of the
    text; what is left of a character cut in two goes as well."""
    body = (texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
            .withColumn("id", F.coalesce("doc_id", F.lit(LAST))))
    found = written(scan(body, length, gram).where("name is not null").drop("doc_id", "n_bytes", "digest"),
                    "byte-anchors")
    ranges = repeated_ranges(body, found, length, gram, shard_bytes, hot)

    key, digest, text = (unused(docs, c) for c in ("cut_id", "cut_digest", "cut_text"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_pydict({
                key: batch.column("id"), digest: batch.column("th"),
                text: pa.array([b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()], pa.string())})

    changed = (cut(body, ranges).select("id", "th", "kept")
               .mapInArrow(decode, f"{key} long, {digest} long, {text} string")
               .dropDuplicates([key, digest]))
    keyed = (docs.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)))
             .withColumn(digest, F.xxhash64(F.col(f"`{text_col}`").cast("string"))))
    return (keyed.join(changed, [key, digest], "left")
            .withColumn(text_col, F.coalesce(F.col(text), F.col(f"`{text_col}`")))
            .select([F.col(f"`{c}`") for c in docs.columns]))
