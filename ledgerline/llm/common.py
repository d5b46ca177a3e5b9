"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import ensure_checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    This is how lineage is cut: a lost executor costs no recomputation beyond
    its running tasks, and each call gets a new folder."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerline-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
         "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
         "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with marks behind it so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every operator needs, under fixed names; other columns
    (whatever they are called) are dropped before any join."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def give_back() -> None:
    """Hand memory that is free, but kept by a worker's allocators, back to the
    system: workers are used again for other tasks, and an executor counts all
    its workers hold."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):                # not glibc
        return None


_TRIM = _trim()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, of at most ``rows`` rows and about ``size``
    bytes of strings (a longer single text is a slice of its own), so that few
    texts are Python objects at once."""
    for batch in batches:
        width = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                width += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        end = np.cumsum(width)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(end, end[at] - width[at] + size, side="right"))
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
        give_back()


def map_texts(docs: DataFrame, per_batch: Callable[[list, list], dict], schema: str) -> DataFrame:
    """Run ``per_batch(ids, texts) -> {column: values}`` over Arrow batches of
    (doc_id, text). Spark cuts the batches by rows and bytes, so a task holds
    one batch at a time."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    out_schema = pa.schema([(name, ARROW[kind.strip()]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = per_batch(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type, from_pandas=True) for f in out_schema],
                schema=out_schema)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out(mod: int, rest: int):
    """True where crc32 of the id as text leaves ``rest`` modulo ``mod``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each ``width`` consecutive values, the
    leftmost of equal ones (sparse-table doubling, all in numpy)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(len(values), dtype=np.int64)
    span = 1
    while span * 2 <= width:
        left, right = best[:len(best) - span], best[span:]
        best = np.where(values[right] < values[left], right, left)
        span *= 2
    left, right = best[:n], best[width - span:width - span + n]
    return np.where(values[right] < values[left], right, left)
