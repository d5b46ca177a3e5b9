"""Skew-safe running counts ("how many earlier rows share my group / my
group and key?") for groups that are few and large.

A window ``partitionBy(group).orderBy(ts)`` would put a whole group into one
task; with six review flags that is six tasks however big the cluster is.
Here time is cut into buckets: days, and where a day holds too many rows of a
group, hours, minutes and so on. A partial aggregate counts rows by (group,
key, bucket); a window over those few rows gives the totals of all earlier
buckets; inside a bucket a window over (group, bucket) counts the rest. Every
step depends on column values only, so re-running a task changes nothing. The
input is planned once: its rows are written and read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_table


CROWDED = 200_000
# characters of a timestamp's text: day, hour, minute, second, and parts of it
LEVELS = (10, 13, 16, 19, 22, 24, 26)


def time_buckets(src: DataFrame, at: str, crowded: int) -> DataFrame:
    """Adds ``_b``: the beginning of the time's text, as long as is needed for
    at most ``crowded`` rows of a group ``_g`` in a bucket. Rows of one moment
    stay together; rows without a time come first."""
    text = F.coalesce(F.col(at).cast("timestamp_ntz").cast("string"), F.lit(""))
    src = src.withColumn("_b", F.substring(text, 1, LEVELS[0]))
    for level in LEVELS[1:]:
        full = (src.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > crowded) & (F.col("_b") != ""))
                .select("_g", "_b", F.lit(True).alias("_full")))
        if full.isEmpty():
            break
        src = (src.join(full, ["_g", "_b"], "left")
               .withColumn("_b", F.when(F.col("_full"), F.substring(text, 1, level)).otherwise(F.col("_b"))).drop("_full"))
    return src


def prior_counts(df: DataFrame, group: str, key: str, order: list[str],
                 bucket: Column | None = None, crowded: int = CROWDED) -> DataFrame:
    """Adds ``prior_n`` (earlier rows with the same ``group``) and ``prior_same``
    (earlier rows with the same ``group`` and ``key``); ``order`` must be a
    total order (end it with a unique id). ``bucket`` must not fall along
    ``order``; by default it is cut from the first order column, a time."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = shared_table(df.withColumns({"_g": text(group), "_k": text(key)}), "prior-counts")
    src = (time_buckets(src, order[0], crowded) if bucket is None
           else src.withColumn("_b", F.coalesce(bucket.cast("string"), F.lit(""))))
    totals = src.groupBy("_g", "_k", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off_k = totals.select("_g", "_k", "_b", F.coalesce(
        F.sum("_c").over(before.partitionBy("_g", "_k")), F.lit(0)).alias("_ok"))
    off_g = totals.groupBy("_g", "_b").agg(F.sum("_c").alias("_c")).select("_g", "_b", F.coalesce(
        F.sum("_c").over(before.partitionBy("_g")), F.lit(0)).alias("_og"))
    here = Window.orderBy(*order)
    local = src.withColumns({"_lg": F.row_number().over(here.partitionBy("_g", "_b")) - 1,
                             "_lk": F.row_number().over(here.partitionBy("_g", "_b", "_k")) - 1})
    out = local.join(off_k, ["_g", "_k", "_b"]).join(off_g, ["_g", "_b"])
    return (out.withColumns({"prior_n": (F.col("_lg") + F.col("_og")).cast("bigint"),
                             "prior_same": (F.col("_lk") + F.col("_ok")).cast("bigint")})
            .drop("_g", "_k", "_b", "_lg", "_lk", "_og", "_ok"))


def ratio_half_even(num, den, places: int):
    """num/den rounded half-to-even at ``places`` decimals, exactly, as DOUBLE
    (num >= 0, den > 0; integer columns)."""
    scale = 10 ** places
    n = num.cast("bigint") * F.lit(scale)
    r = F.pmod(n, den)
    q = ((n - r) / den).cast("bigint")  # exact: n - r is a multiple of den
    up = (r * 2 > den) | ((r * 2 == den) & (q % 2 == 1))
    return (q + up.cast("bigint")).cast("double") / F.lit(float(scale))


def ratio_half_even_sql(num: str, den: str, places: int) -> str:
    """The same rounding for the DuckDB oracle."""
    s = 10 ** places
    n = f"(CAST({num} AS BIGINT) * {s})"
    q = f"({n} // ({den}))"
    r = f"({n} - {q} * ({den}))"
    return (f"(CAST({q} + CASE WHEN 2 * {r} > ({den}) OR (2 * {r} = ({den}) AND {q} % 2 = 1) "
            f"THEN 1 ELSE 0 END AS DOUBLE) / {float(s)})")
