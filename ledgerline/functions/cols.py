"""Small column-expression helpers shared by the operators."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(c: Column) -> Column:
    """Python truthiness of an optional string: NULL or ''."""
    return c.isNull() | (c == "")


def present(c: Column) -> Column:
    return ~missing(c)


def dec(value, precision: int = 18, scale: int | None = None) -> Column:
    """An exact decimal literal."""
    d = Decimal(str(value))
    if scale is None:
        scale = max(0, -d.as_tuple().exponent)
    return F.lit(str(d)).cast(f"decimal({precision},{scale})")


def units(value, scale: int) -> int:
    """A decimal constant in whole units of its last of ``scale`` places."""
    return int(Decimal(str(value)).scaleb(scale).quantize(Decimal(1), ROUND_HALF_UP))


def conf(value) -> Column:
    """A confidence constant as DECIMAL(4,2): sums of these stay exact."""
    return dec(value, 4, 2)


def thousandths(c: Column) -> Column:
    """Exact decimal with at most 3 decimals -> the nearest DOUBLE (k / 1000.0)."""
    return (c * 1000).cast("bigint").cast("double") / F.lit(1000.0)


def first_non_null(arr: Column) -> Column:
    """First element of an array, NULL if empty."""
    return F.try_element_at(arr, F.lit(1))


def compact(*items: Column) -> Column:
    """The items that are not NULL, in order. As ``array_compact``, whose filter
    takes all it reads out of the generated code."""
    return F.concat(*[F.when(x.isNotNull(), F.array(x)).otherwise(F.array()) for x in items])


def stable_id(*parts: Column) -> Column:
    """Deterministic row id (replaces random UUIDs): md5 of the '|'-joined parts."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
