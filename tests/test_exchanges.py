"""What keeps rows out of exchanges, and exchanges off the disk; on rows written here."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F
from test_golden_rows import ORDERS, POLICY, SCHEMA, VENDORS, invoice

import __spark_entry__ as E
from ledgerline.joins import hash_bits, may_have, small_side
from ledgerline.operators import audit, ledger
from ledgerline.operators.enrich import duplicate_history, match_vendors
from ledgerline.plans.scoring import score
from ledgerline.session import shared_table
from ledgerline.streaming import gates


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_a_bitmap_has_all_its_hashes_and_hardly_others(spark):
    rows = spark.range(4000).select("id", F.xxhash64("id").alias("h"))
    bits = hash_bits(rows.where("id % 4 = 0").select("h"))
    got = rows.select("id", may_have(bits, F.col("h")).alias("in"))
    assert got.where("id % 4 = 0 AND NOT in").isEmpty()
    assert got.where("id % 4 <> 0 AND in").count() < 10
    none = hash_bits(rows.where("id < 0").select("h"))
    assert rows.where(may_have(none, F.col("h"))).isEmpty()


def test_only_a_small_side_is_broadcast(spark, capsys):
    vendors = spark.createDataFrame(VENDORS, "vendor_id string, name string, approved boolean")
    inv = spark.createDataFrame([invoice("a"), invoice("b", vendor=None)], SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(match_vendors(inv, vendors), capsys)
        assert "Broadcast" not in plan(inv.join(small_side(vendors, limit=40), inv.vendor_name == vendors.name, "left"), capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_a_key_that_occurs_once_are_not_exchanged(spark, capsys):
    inv = spark.createDataFrame([invoice("a", number="x"), invoice("b", number="y"), invoice("c", number="y", days=3)], SCHEMA)
    df = duplicate_history(inv)
    # the rows of these keys, without a join, beside the others
    alone = plan(df, capsys).split("SortMergeJoin")[0]
    assert "Union" in alone and "getbit" in alone and "_k1" not in alone
    assert [(r.invoice_id, r.duplicate_of) for r in df.where("is_duplicate").collect()] == [("c", "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_the_plain_search(spark, seed):
    r = random.Random(seed)
    first = datetime.datetime(2024, 1, 1)
    rows = [(f"i{r.randrange(250) if n % 9 == 0 else n + 1000}", r.choice(["", None, "n1", "n2", f"u{n}"]), r.choice(["", None, "Acme", "ACME", "Bolt"]),
             None if n % 31 == 0 else first + datetime.timedelta(days=r.randrange(700), hours=r.randrange(3)), n % 5 != 0)
            for n in range(300)]
    inv = spark.createDataFrame(rows, "invoice_id string, invoice_number string, vendor_name string, created_at timestamp_ntz, ok boolean")
    got = duplicate_history(inv, witness=F.col("ok"))
    assert got.count() == len(rows)
    want = set()
    for a in rows:
        if a[1] and a[2] and a[3]:
            for b in rows:
                if (b[1] == a[1] and b[2] and b[2].lower() == a[2].lower() and b[3] and b[4]
                        and (b[3], b[0]) < (a[3], a[0]) and a[3] - b[3] <= datetime.timedelta(days=90)):
                    want.add((a[0], a[3]))
    assert {(x.invoice_id, x.created_at) for x in got.where("is_duplicate").collect()} == want and want


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))


def test_exchanges_of_a_stored_table_are_dropped(spark):
    before = shuffle_files(spark)
    kept = shared_table(spark.range(1000).repartition(7, "id").groupBy(F.col("id") % 10).agg(F.count("id").alias("n")), "test")
    assert shuffle_files(spark) <= before
    assert sorted(r.n for r in kept.collect()) == [100] * 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_events_by_month_are_written_without_an_exchange_or_sort(spark, tmp_path, capsys):
    rows = [invoice("a"), invoice("b", vendor=None), invoice("c", number="n", days=40), invoice("d", number="n", days=45)]
    scored = score(spark.createDataFrame(rows, SCHEMA),
                   spark.createDataFrame(VENDORS, "vendor_id string, name string, approved boolean"),
                   spark.createDataFrame(ORDERS, "po_number string, amount decimal(18,2)"), POLICY)
    placed = audit.lifecycle_events(scored, policy=POLICY, place=audit.by_month)
    assert "Exchange" not in plan(placed, capsys)
    audit.append_rows(placed, f"{tmp_path}/log", "lifecycle", placed=True)
    columns = ["entry_id", "event_type", "description", "metadata", "after_state", "ord"]
    back = spark.read.parquet(f"{tmp_path}/log")
    assert sorted(map(str, back.select(*columns).collect())) == sorted(
        map(str, audit.lifecycle_events(scored, policy=POLICY).select(*columns).collect()))


def test_exchanges_of_a_micro_batch_and_of_a_merge_are_dropped(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("i"), F.col("id")).alias("invoice_id"), (F.col("id") % 3).alias("part"),
                                   F.lit("processing").alias("status"))
    before = shuffle_files(spark)
    gates.write(rows.repartition("part"), f"{tmp_path}/rows", "part")
    assert shuffle_files(spark) <= before
    ledger.create_ledger(rows.drop("part"), f"{tmp_path}/ledger", "invoice_id", buckets=4)
    assert shuffle_files(spark) <= before
    assert spark.read.parquet(f"{tmp_path}/rows").count() == ledger.read_ledger(spark, f"{tmp_path}/ledger").count() == 200


def test_checks_do_not_compute_the_history(spark, sf_dir, capsys):
    for name in ("validation_overall", "validation_report", "po_variance"):
        assert "getbit" not in plan(E.queries()[name](spark, sf_dir), capsys)
