"""Packing into optimal length buckets.

1. Every document's tokens are counted; documents over ``max_len`` become
   several sequences, so that no token is dropped.
2. The histogram of sequence lengths (at most ``max_len + 1`` numbers) goes to
   the driver, where dynamic programming picks the bucket boundaries with the
   least padding among all choices of that many buckets.
3. Inside each bucket, sequences are batched up to a token budget (counted with
   padding). A bucket that holds many sequences is dealt into parts of bounded
   size by a hash, and each part numbers its own batches; so a bucket with most
   of the rows costs many tasks, and at most one batch a part is not full.

Defined results: null and empty texts are one sequence of length 0 in the
first bucket; repeated rows are packed each; an empty table gives an empty
table; extra columns are ignored."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, texts, written

MAX_LEN = 2048
BUCKETS = 12
BUDGET = 16_384
PART = 20_000
RANKS = "byte_bpe_50k.tiktoken"

_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer for a file of ranks, one for each worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                            special_tokens={})
    return _ENCODERS[path]


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) of every text."""
    def run(batches):
        count = encoder(path).encode_ordinary
        for batch in pieces(batches):
            n = [len(count(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64())})
    return docs.mapInArrow(run, "doc_id long, n_tokens long")


def best_boundaries(sizes: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets over the distinct
    ``sizes`` (ascending) with the least padding in total."""
    n = len(sizes)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    # best[j]: least sum of padded lengths of the first j sizes; the sum of true lengths is the same for all
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    choices = []
    for _ in range(min(buckets, n)):
        new, pick = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        for j in range(1, n + 1):
            cost = best[:j] + (rows[j] - rows[:j]) * float(sizes[j - 1])
            pick[j] = int(cost.argmin())
            new[j] = cost[pick[j]]
        best = new
        choices.append(pick)
    out, j = [], n
    for pick in reversed(choices):
        if j == 0:
            break
        out.append(int(sizes[j - 1]))
        j = int(pick[j])
    return out[::-1]


def sequences(counted: DataFrame, max_len: int) -> DataFrame:
    """(doc_id, copy, segment, n_tokens): one row for each sequence."""
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.lit(max_len))).cast("int")
    return (counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("segment"))
            .withColumn("n_tokens", F.least(F.lit(max_len), F.col("n_tokens") - F.col("segment") * max_len)))


def pack_lengths(counted: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET,
                 part: int = PART) -> DataFrame:
    """``counted``: (doc_id, n_tokens). Returns (doc_id, segment, n_tokens,
    bucket, batch): the bucket is its boundary, the length its sequences are
    padded to; the batch is named by bucket, part and number."""
    seqs = written(sequences(counted, max_len), "sequences")
    hist = sorted((r.n_tokens, r["count"]) for r in seqs.groupBy("n_tokens").count().collect())   # <= max_len + 1 rows
    sizes, counts = np.array([h[0] for h in hist], np.int64), np.array([h[1] for h in hist], np.int64)
    bounds = best_boundaries(sizes, counts, buckets)
    if not bounds:
        return seqs.select("doc_id", "segment", "n_tokens", F.lit(0).alias("bucket"), F.lit("").alias("batch"))
    bucket, parts, capacity = F.lit(None).cast("int"), F.lit(1), F.lit(1)
    low = -1
    for bound in bounds:
        rows = int(counts[(sizes > low) & (sizes <= bound)].sum())
        here = (F.col("n_tokens") > low) & (F.col("n_tokens") <= bound)
        bucket = F.when(here, F.lit(bound)).otherwise(bucket)
        parts = F.when(here, F.lit(-(-rows // part))).otherwise(parts)
        capacity = F.when(here, F.lit(max(1, budget // max(1, bound)))).otherwise(capacity)
        low = bound
    spread = F.xxhash64("doc_id", "segment", F.lit("pack"))
    dealt = (seqs.withColumn("bucket", bucket).withColumn("capacity", capacity)
             .withColumn("part", F.pmod(spread, parts)))
    number = F.row_number().over(Window.partitionBy("bucket", "part").orderBy(spread, "doc_id", "segment")) - 1
    return (dealt.withColumn("slot", number)
            .select("doc_id", "segment", "n_tokens", "bucket", F.concat_ws(
                "-", "bucket", "part", F.floor(F.col("slot") / F.col("capacity"))).alias("batch")))


def pack(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN, buckets: int = BUCKETS,
         budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(RANKS)
    return pack_lengths(lengths(texts(docs, id_col, text_col), path), max_len, buckets, budget)
