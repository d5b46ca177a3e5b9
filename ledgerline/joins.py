"""What keeps rows out of exchanges: sides measured to be small, and bitmaps of
fixed size that say which keys can find a partner at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_BYTES = 32 << 20
BITS = 24  # a bitmap has 2 to the power of so many bits (2 MB)
WORD = 6   # 64 of them in a number


def small_side(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted now, take less than
    ``limit`` bytes in memory. A larger one is left to AQE's choice of a join."""
    per_row = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"),
                  F.lit(32 + 8 * len(df.columns)))
    size = df.agg(F.sum(per_row)).first()[0]
    return F.broadcast(df) if (size or 0) < limit else df


def _place(h: Column) -> tuple[Column, Column]:
    """Number of the word and of the bit in it that a 64-bit hash has."""
    p = F.pmod(h, F.lit(1 << BITS))
    return F.shiftright(p, WORD).cast("int"), F.pmod(p, F.lit(1 << WORD)).cast("int")


def hash_bits(hashes: DataFrame) -> Column:
    """The hashes (the only column of ``hashes``) as one bitmap, a scalar
    subquery: it is as large for a few as for many, which only make more
    hashes look contained that are not."""
    word, bit = _place(F.col(hashes.columns[0]))
    words = hashes.select(word.alias("_w"), bit.alias("_p")).select("_w", F.expr("shiftleft(1L, _p)").alias("_b"))
    empty = hashes.sparkSession.range(0, 1 << (BITS - WORD), 1, 1).select(F.col("id").cast("int").alias("_w"),
                                                                         F.lit(0).cast("bigint").alias("_b"))
    full = words.unionByName(empty).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    return full.agg(F.array_sort(F.collect_list(F.struct("_w", "_b")))["_b"].alias("bits")).scalar()


def may_have(bits: Column, h: Column) -> Column:
    """False if the hash is none of those in the bitmap; else nearly always that it is."""
    word, bit = _place(h)
    return F.coalesce(F.getbit(F.get(bits, word), bit) == 1, F.lit(False))
