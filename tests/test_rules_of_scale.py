"""Caps are off by default, bad limits are refused, junk amounts become NULL,
running counts do not depend on exchange reuse."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgerline.functions import text as T
from ledgerline.operators import prefix, registry, retrieval


def test_page_refuses_bad_limits(spark):
    df = spark.range(1)
    for limit, offset in ((0, 0), (501, 0), (10, -1)):
        with pytest.raises(ValueError):
            registry.page(df, None, limit, offset)


def test_exceptions_cap_is_a_parameter(spark):
    df = spark.range(30).selectExpr("cast(id AS string) invoice_id", "'on_hold' AS status", "id AS created_at")
    assert registry.exceptions(df).count() == 30
    assert registry.exceptions(df, cap=4).count() == 4


@pytest.mark.parametrize("digits", [17, 20, 29, 40, 400])
def test_long_amounts_are_null(spark, digits):
    df = spark.createDataFrame([("9" * digits,)], "x string")
    assert df.select(T.parse_amount(F.col("x")).alias("a")).first().a is None
    line = f"Some article here   1   {'9' * digits}.00   {'9' * digits}.00"
    assert spark.createDataFrame([(line,)], "x string").select(T.line_items(F.col("x")).alias("i")).first().i == []


def test_amounts_stay_on_their_line(spark):
    df = spark.createDataFrame([("Total Due: \n1234 Main Street\nTax: \n55 Elm",)], "x string")
    raw = T.extract_raw(F.col("x"))
    got = df.select(raw["total"].alias("total"), raw["tax"].alias("tax")).first()
    assert got.total is None and got.tax is None


def test_index_adds_chunks_beside_stale_ids(spark):
    old = spark.range(10).selectExpr("concat('stale', id) AS chunk_id")
    new = spark.range(3).selectExpr("concat('new', id) AS chunk_id")
    assert retrieval.index_chunks(old, new).where("inserted").count() == 3


def test_running_counts_without_exchange_reuse(spark, sf_dir):
    def rows():
        return sorted(map(tuple, E.queries()["consistency_scores"](spark, sf_dir).collect()))
    with_reuse = rows()
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert rows() == with_reuse and with_reuse
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_one_day_that_holds_all_rows_is_split(spark):
    """Nearly all rows on one day, half of these in one second; some without a time."""
    df = spark.range(3000).selectExpr(
        "id AS seq", "concat('f', id % 2) AS flag", "concat('d', id % 3) AS decision",
        """CASE WHEN id % 100 = 7 THEN NULL WHEN id % 50 = 3 THEN timestamp_ntz'2024-01-01 08:00:00'
           WHEN id % 2 = 0 THEN timestamp_ntz'2024-05-05 10:20:30' + make_dt_interval(0, 0, 0, pmod(id * 7919, 1000) / 1000.0)
           ELSE timestamp_ntz'2024-05-05 00:00:00' + make_dt_interval(0, 0, 0, pmod(id * 7919, 86000)) END AS at""")
    rows = sorted(df.collect(), key=lambda r: (r.at is not None, r.at or 0, r.seq))
    seen, want = {}, {}
    for r in rows:
        want[r.seq] = (seen.get(r.flag, 0), seen.get((r.flag, r.decision), 0))
        seen[r.flag] = seen.get(r.flag, 0) + 1
        seen[r.flag, r.decision] = seen.get((r.flag, r.decision), 0) + 1
    for crowded in (20, 10**6):
        got = prefix.prior_counts(df, "flag", "decision", ["at", "seq"], crowded=crowded)
        assert {r.seq: (r.prior_n, r.prior_same) for r in got.collect()} == want
    buckets = prefix.time_buckets(df.withColumn("_g", F.col("flag")), "at", 20).where("at is not null")
    largest = buckets.groupBy("_g", "_b").agg(F.count("*").alias("n"), F.countDistinct("at").alias("moments"))
    assert largest.where("n > 20 AND moments > 1").isEmpty()
