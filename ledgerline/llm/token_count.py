"""Exact token counts, with huge documents encoded in overlapping chunks.

A document up to ``chunk`` characters is encoded whole. A longer one becomes
overlapping chunks, one row each, so that its chunks spread over the tasks.
Every chunk reports its piece boundaries (offset, tokens so far) inside the
zones it shares with its neighbours. Neighbours are joined and spliced at a
boundary both of them report:

* A byte-level BPE tokenizer first cuts text into pieces, scanning left to
  right; what it cuts from an offset on depends only on the text after that
  offset. If the left chunk and the right chunk both have a piece boundary at
  an offset, the right chunk's pieces from there on are those of the whole
  text.
* The left chunk's pieces up to there are those of the whole text as long as
  its end cannot have changed them. Pieces look ahead by one character, so the
  last ``margin`` characters of a chunk that does not end the document are not
  used. A special string is shorter than the margin, so a string cut in two by
  a chunk's end lies in the unused part.

Where two chunks share no such boundary, the overlaps are doubled for the
documents concerned and their chunks encoded again, until all align; once an
overlap spans a whole document, it is encoded in one piece.

Within a chunk, equal pieces are encoded by the library once per worker and
looked up afterwards (bounded cache); merges never cross pieces.

Defined results: null counts as empty (0 tokens, 0 bytes); repeated rows are
counted separately, also with equal ids; an empty table gives an empty table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, texts, written

CHUNK = 1 << 16          # characters
OVERLAP = 256
MARGIN = 32
TOKENIZER = "byte_bpe_50k.json"
CACHE = 400_000          # pieces kept in each worker

# Fixed value: the piece pattern that byte-level BPE vocabularies of this
# family are defined with.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

_ENCODERS: dict[str, "PieceEncoder"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class PieceEncoder:
    """Counts of a tokenizers file, by piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.is_special = set(added)
        if self.is_special and max(map(len, added)) > MARGIN:
            raise ValueError("a special string is longer than the chunk margin")
        self.counts: dict[str, int] = {}

    @staticmethod
    def of(path: str) -> "PieceEncoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = PieceEncoder(path)
        return _ENCODERS[path]

    def pieces(self, text: str) -> list[str]:
        if self.special is None:
            return PIECES.findall(text)
        parts = self.special.split(text)
        if len(parts) == 1:
            return PIECES.findall(text)
        out: list[str] = []
        for part in parts:
            if part in self.is_special:
                out.append(part)
            else:
                out += PIECES.findall(part)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Have the library encode the pieces it has not seen yet."""
        new = [p for p in pieces if p not in self.counts]
        if len(self.counts) + len(new) > CACHE:
            self.counts, new = {}, list(pieces)
        for at in range(0, len(new), 4096):
            part = new[at:at + 4096]
            self.counts.update(zip(part, map(len, self.lib.encode_batch(part, add_special_tokens=False))))

    def count(self, text: str) -> int:
        pieces = self.pieces(text)
        self.learn(set(pieces))
        return sum(map(self.counts.__getitem__, pieces))

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(offset, tokens before it) of every piece boundary, both ends included."""
        pieces = self.pieces(text)
        self.learn(set(pieces))
        n = len(pieces)
        at = np.zeros(n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, pieces), np.int64, n), out=at[1:])
        tokens = np.zeros(n + 1, np.int64)
        np.cumsum(np.fromiter(map(self.counts.__getitem__, pieces), np.int64, n), out=tokens[1:])
        return at, tokens


def spans(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks [start, end): the cores tile the text, each starts ``overlap``
    early."""
    return [(max(0, at - overlap), min(length, at + chunk)) for at in range(0, length, chunk)] or [(0, 0)]


def whole_counts(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """(row, doc_id, n_bytes, n_chars, n_tokens); n_tokens is null for texts
    that have to be chunked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder.of(path)
        for batch in pieces(batches):
            bodies = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_bytes": pa.array([len(t.encode("utf-8")) for t in bodies], pa.int64()),
                "n_chars": pa.array([len(t) for t in bodies], pa.int64()),
                "n_tokens": pa.array([enc.count(t) if len(t) <= chunk else None for t in bodies], pa.int64())})
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_chars long, n_tokens long")


def chunk_rows(long_docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """One row for each chunk (key, k, start, last, body), dealt out evenly."""
    n = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    start = F.greatest(F.lit(0), F.col("k") * chunk - overlap)
    end = F.least(F.length("text"), (F.col("k") + 1) * chunk)
    return (long_docs.select("key", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
            .select("key", "k", start.cast("long").alias("start"), (end == F.length("text")).alias("last"),
                    F.substring("text", start + 1, (end - start).cast("int")).alias("body"))
            .repartition("key", "k"))


def encode_chunks(chunks: DataFrame, path: str, chunk: int, overlap: int, margin: int) -> DataFrame:
    """(key, k, last, total, left_at, left_n, right_at, right_n): document
    offsets and token counts of the boundaries in the zones shared with the
    chunk before and the chunk after."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder.of(path)
        for batch in pieces(batches):
            out = {c: [] for c in ("total", "left_at", "left_n", "right_at", "right_n")}
            for k, start, last, body in zip(*(batch.column(c).to_pylist() for c in ("k", "start", "last", "body"))):
                at, n = enc.boundaries(body)
                at = at + start
                first, end = k * chunk, (k + 1) * chunk
                left = (at > start) & (at <= first) if k else at == start
                right = (at == at[-1]) if last else (at > end - overlap) & (at <= end - margin)
                out["total"].append(int(n[-1]))
                for side, keep in (("left", left), ("right", right)):
                    out[f"{side}_at"].append(at[keep])
                    out[f"{side}_n"].append(n[keep])
            yield pa.RecordBatch.from_pydict(
                {"key": batch.column("key"), "k": batch.column("k"), "last": batch.column("last"),
                 "total": pa.array(out["total"], pa.int64())}
                | {c: pa.array(out[c], kind) for c in ("left_at", "left_n", "right_at", "right_n")})
    return chunks.mapInArrow(run, "key string, k int, last boolean, total long, left_at array<long>, "
                                  "left_n array<long>, right_at array<long>, right_n array<long>")


def spliced(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens): n_tokens is null where two chunks do not align.

    Chunk k is joined to chunk k + 1 of the same document; the splice is the
    last offset both know. A chunk then counts from its left to its right
    splice."""
    left = encoded.select("key", (F.col("k") - 1).alias("k"), F.col("left_at").alias("next_at"),
                          F.col("left_n").alias("next_n"))
    both = encoded.join(left, ["key", "k"], "left")
    at = F.array_max(F.array_intersect("right_at", "next_at"))
    # array_position is 0 without a match and null for a null offset: then no count
    pick = lambda counts, offsets, x: F.get(counts, (F.array_position(offsets, x) - 1).cast("int"))
    both = both.withColumn("splice", F.when(~F.col("last"), at))
    gain = F.when(F.col("last"), F.col("total")).otherwise(
        pick("right_n", "right_at", F.col("splice")) - pick("next_n", "next_at", F.col("splice")))
    return both.groupBy("key").agg(F.when(F.count(F.lit(1)) == F.count(gain), F.sum(gain)).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP,
                 margin: int = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row for each input row."""
    if not margin < overlap <= chunk:
        raise ValueError("margin < overlap <= chunk is needed")
    path = path or tokenizer_path()
    docs = texts(docs, id_col, text_col)
    whole = written(whole_counts(docs, path, chunk), "token-counts")
    done = whole.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens")
    if whole.where("n_tokens is null").isEmpty():
        return done
    # equal texts of huge documents are encoded once: the key is the text's digest
    keyed = docs.where(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    ids = written(keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes")), "long-ids")
    first = Window.partitionBy("key").orderBy("doc_id")
    chosen = ids.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    bodies = written(keyed.join(chosen, ["key", "doc_id"], "left_semi")
                     .withColumn("n", F.row_number().over(first)).where("n = 1").select("key", "text"), "long-texts")
    found, todo = [], bodies
    while True:
        got = written(spliced(encode_chunks(chunk_rows(todo, chunk, overlap), path, chunk, overlap, margin)),
                      "spliced")
        found.append(got.where("n_tokens is not null"))
        open_keys = got.where("n_tokens is null")
        if open_keys.isEmpty():
            break
        overlap *= 2
        chunk = max(chunk, 2 * overlap)
        todo = todo.join(open_keys.select("key"), "key", "left_semi")
    counts = found[0]
    for more in found[1:]:
        counts = counts.unionByName(more)
    return done.unionByName(ids.join(counts, "key").select("doc_id", "n_bytes", "n_tokens"))
