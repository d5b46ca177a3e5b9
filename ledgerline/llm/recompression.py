"""Removal of long repeated word sequences, found by recompression.

Every text is rewritten in rounds that name runs of equal symbols and then
pairs of adjacent symbols. Names are 64-bit hashes of what they stand for, so
a round needs no exchange to be globally consistent: equal runs and pairs get
equal names in all documents. A pair is replaced if its symbols fall on the
left and the right side of a partition of all symbols that the round's hash
gives. A symbol covers at most ``CAP`` words; longer runs stay single symbols.
What a round does at a place depends on few words around it, so equal word
sequences get the same symbols except within ``margin`` words of their ends.

1. In each window of 50 words the smallest interior high-level symbol is the
   window's anchor; a row (name, context fingerprint, position) stands for the
   consecutive windows with the same anchor.
2. Spark finds the names that occur in several documents. Contexts equal to a
   context of a smaller doc_id are repeats as a whole. Only names with
   different contexts need more: there, one context of each kind is read again
   and its windows are fingerprinted.
3. A window is a repeat if its sequence occurs in a document with a smaller
   doc_id; the words it covers are removed in a last pass over the texts.

Windows are compared by 64-bit fingerprints over 64-bit word hashes (two
different ones among a billion agree with a chance of about 3 in 100).

Defined results: null texts count as empty (0 words, digest of no bytes);
texts under 50 words are never cut; rows with the same doc_id do not make each
other repeats; a null doc_id counts as larger than all others; an empty table
gives an empty table; extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as an
from .common import mix64, pieces, texts, written

WINDOW = 50
CAP = 4
PAIR_ROUNDS = 2
LAST = (1 << 63) - 1          # stands for a null id


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()      # ASCII white space, as for bytes


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def name_runs(names: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each maximal run of equal symbols that covers at most CAP words."""
    n = len(names)
    if n < 2:
        return names, lengths
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    count = np.diff(np.append(first, n))
    words = np.add.reduceat(lengths, first)
    merge = (count > 1) & (words <= CAP)
    if not merge.any():
        return names, lengths
    keep = np.ones(n, bool)
    inside = np.repeat(merge, count)
    keep[inside] = False
    keep[first[merge]] = True
    names, lengths = names.copy(), lengths.copy()
    names[first[merge]] = mix64(names[first[merge]] * np.uint64(3) + count[merge].astype(np.uint64))
    lengths[first[merge]] = words[merge]
    return names[keep], lengths[keep]


def name_pairs(names: np.ndarray, lengths: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace each pair of a left and a right symbol that covers at most CAP words."""
    side = (mix64(names + np.uint64(level * 0x1000193 + 1)) & np.uint64(1)).astype(bool)
    at = np.flatnonzero(~side[:-1] & side[1:] & (lengths[:-1] + lengths[1:] <= CAP))
    if not len(at):
        return names, lengths
    names, lengths = names.copy(), lengths.copy()
    names[at] = mix64(names[at] * an.BASE + mix64(names[at + 1]) + np.uint64(level))
    lengths[at] += lengths[at + 1]
    keep = np.ones(len(names), bool)
    keep[at + 1] = False
    return names[keep], lengths[keep]


def recompress(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(names, words covered, margin) after all rounds. margin: how many words
    beyond a symbol decide that it is formed. To see a run to both ends takes
    CAP words; each pair round adds one neighbour of at most CAP words."""
    names, lengths = name_runs(words, np.ones(len(words), np.int64))
    for level in range(PAIR_ROUNDS):
        names, lengths = name_pairs(names, lengths, level)
    return names, lengths, CAP * (1 + PAIR_ROUNDS)


def text_anchors(names: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(name, context fingerprint, first window, windows) in blocks."""
    n_windows = len(names) - window + 1
    if n_windows <= 0:
        return
    symbols, lengths, margin = recompress(names)
    # a symbol that starts at least ``margin`` after the window's start and ends, whatever its
    # length, that much before its end; any CAP places in a row hold the start of one
    width = window - 2 * margin - CAP + 1
    if width < CAP:
        raise ValueError("the window is too short for this many rounds")
    starts = np.full(len(names), an.FAR, np.uint64)
    starts[np.cumsum(lengths) - lengths] = symbols
    for at in range(0, n_windows, 1 << an.BLOCK_BITS):
        some = min(1 << an.BLOCK_BITS, n_windows - at)
        part = starts[at + margin:at + margin + some + width - 1]
        pos, first, count = an.choose(np.where(part == an.FAR, an.FAR, mix64(part)), width)
        prefix = an.Prefix(names[at:at + some + window - 1])
        ctx = prefix.of(first, first + count - 1 + window) + (pos - first).astype(np.uint64)
        # every window with this anchor holds the words around it: they are part of its name, so that
        # a short symbol which unrelated texts share by chance does not bring them together
        around = prefix.of(pos, pos + window - width + 1)
        yield mix64(part[pos] + around), mix64(ctx), at + first, count


def scan(docs: DataFrame, window: int) -> DataFrame:
    """Per document one row with n_words and digest, and its anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, sizes, digests, found = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = split_words(text)
                rows.append(i)
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found += [(i, *a) for a in text_anchors(word_names(words), window)]
            keys = {c: batch.column(c) for c in ("doc_id", "th")}
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_pydict(keys | {
                "n_words": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.string()),
                "name": none, "ctx": none, "lo": none.cast(pa.int32()), "cnt": none.cast(pa.int32())})
            if found:
                of = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                name, ctx, lo, cnt = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3, 4))
                yield pa.RecordBatch.from_pydict({c: v.take(pa.array(of)) for c, v in keys.items()} | {
                    "n_words": pa.nulls(len(of), pa.int64()), "digest": pa.nulls(len(of), pa.string()),
                    "name": pa.array(name.view(np.int64)), "ctx": pa.array(ctx.view(np.int64)),
                    "lo": pa.array(lo.astype(np.int32)), "cnt": pa.array(cnt.astype(np.int32))})
    return docs.mapInArrow(run, "doc_id long, th long, n_words long, digest string, "
                                "name long, ctx long, lo int, cnt int")


def window_prints(docs: DataFrame, ranges: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, id, at, print) of each window in ``ranges`` (doc_id, th, id, lo, cnt)."""
    per_doc = ranges.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "cnt")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for i, (text, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())):
                names = word_names(split_words(text))
                at = np.concatenate([np.arange(s["lo"], s["lo"] + s["cnt"]) for s in spans])
                prints = np.empty(len(at), np.uint64)
                order = np.argsort(at, kind="stable")
                for block in np.split(order, np.flatnonzero(np.diff(at[order] >> an.BLOCK_BITS)) + 1):
                    base = int(at[block[0]]) >> an.BLOCK_BITS << an.BLOCK_BITS
                    prefix = an.Prefix(names[base:base + (1 << an.BLOCK_BITS) + window])
                    prints[block] = prefix.of(at[block] - base, at[block] - base + window)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(np.full(len(at), batch.column("id")[i].as_py())),
                    "th": pa.array(np.full(len(at), batch.column("th")[i].as_py())),
                    "at": pa.array(at.astype(np.int32)), "print": pa.array(prints.view(np.int64))})
    return (docs.join(per_doc, ["id", "th"]).select("id", "th", "text", "spans")
            .mapInArrow(run, "id long, th long, at int, print long"))


def cut(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, th, n_removed, kept) of the documents in ``ranges`` (id, th, lo, hi)."""
    per_doc = ranges.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            removed, kept = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = split_words(text)
                gone = an.covered([(s["lo"], s["hi"]) for s in spans], len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode("utf-8"))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "th": batch.column("th"),
                "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})
    return (docs.join(per_doc, ["id", "th"]).select("id", "th", "text", "spans")
            .mapInArrow(run, "id long, th long, n_removed long, kept string"))


def repeated_ranges(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(id, th, lo, hi): word ranges covered by repeated windows."""
    found = found.withColumn("id", F.coalesce("doc_id", F.lit(LAST)))
    rows = written(an.shared(found.select("id", "th", "name", "ctx", "lo", "cnt"), "id"), "shared-symbols")
    first = written(rows.groupBy("name", "ctx").agg(F.min("id").alias("first_id")), "first-contexts")
    rows = rows.join(first, ["name", "ctx"])
    whole = rows.where("first_id < id").select("id", "th", "lo", (F.col("lo") + F.col("cnt") - 1 + window).alias("hi"))
    ours = rows.where("first_id = id and contexts_differ").select("id", "th", "lo", "cnt")
    prints = written(window_prints(docs, ours, window), "window-prints")
    least = written(prints.groupBy("print").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b"),
                    "first-windows")
    single = prints.join(least, "print").where("a < id").select(
        "id", "th", F.col("at").alias("lo"), (F.col("at") + window).alias("hi"))
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                   text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and kept_text if asked for:
    the kept words joined by one space."""
    docs = (texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
            .withColumn("id", F.coalesce("doc_id", F.lit(LAST))))
    scanned = written(scan(docs.select("doc_id", "th", "text"), window), "recompressed")
    base = scanned.where("name is null").select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), "th", "n_words", "digest")
    ranges = repeated_ranges(docs, scanned.where("name is not null"), window)
    changed = cut(docs, ranges).select(
        "id", "th", "n_removed", F.sha2("kept", 256).alias("new_digest"), *(["kept"] if with_text else []))
    changed = changed.dropDuplicates(["id", "th"])
    out = base.join(changed, ["id", "th"], "left")
    if with_text:
        plain = docs.dropDuplicates(["id", "th"]).select("id", "th", F.array_join(F.filter(
            F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ").alias("plain"))
        out = out.join(plain, ["id", "th"], "left").withColumn(
            "kept_text", F.coalesce("kept", "plain", F.lit("")))
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce("new_digest", "digest").alias("kept_sha256"), *(["kept_text"] if with_text else []))
