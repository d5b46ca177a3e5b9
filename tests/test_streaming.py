"""K1 and K2 equal the batch plans however the input is split into files and
in whatever order the files arrive; a named stream goes on after a restart."""

from __future__ import annotations

import os
import shutil
import uuid

import __spark_entry__ as E
from ledgerline.sources.tables import TABLES
from ledgerline.streaming import gates


def split_input(spark, sf_dir, path, files):
    """The tables, with the line items dealt over files by a hash (no order)."""
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{sf_dir}/{t}.parquet", f"{path}/{t}.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.repartition(files, "l_partkey", "l_shipdate", "l_linenumber").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_duplicates_and_gates_over_four_files(spark, sf_dir, tmp_path):
    path = split_input(spark, sf_dir, tmp_path, 4)
    name = f"test_{uuid.uuid4().hex}"
    got = {r.invoice_id for r in gates.stream_duplicates(spark, path, name=name).where("is_duplicate").collect()}
    want = {r.invoice_id for r in E.queries()["duplicates_90d"](spark, sf_dir).collect()}
    assert got == want and want


def test_statuses_follow_late_files_over_restarts(spark, sf_dir, tmp_path):
    """Shuffled files one at a time, a restart after each: the statuses are
    those of the batch plan, row by row, also of invoices scored before."""
    path = split_input(spark, sf_dir, tmp_path, 4)
    folder = f"{path}/lineitem.parquet"
    files = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    for f in files[1:]:
        shutil.move(f"{folder}/{f}", f"{path}/{f}")
    name = f"test_{uuid.uuid4().hex}"
    statuses = []
    for f in files:
        if f != files[0]:
            shutil.move(f"{path}/{f}", f"{folder}/{f}")
        statuses.append(dict((r[0], r) for r in rows_of(gates.stream_gates(spark, path, name=name, registry_dir=sf_dir))))
    assert sorted(statuses[-1].values()) == rows_of(E.queries()["final_status"](spark, sf_dir))
    changed = [i for i, r in statuses[0].items() if statuses[-1][i] != r]
    assert changed                                      # some earlier status had to be taken back


def test_a_batch_run_again_replaces_itself(spark, sf_dir):
    base = gates.stream_folder(spark, f"test_{uuid.uuid4().hex}")
    inv = gates.storable(gates.domain.invoices(spark, sf_dir)).select(
        "invoice_id", "invoice_number", "vendor_name", "created_at", "valid")
    step = gates.duplicates_step(base)
    first, second = inv.where("order_key % 2 = 0"), inv.where("order_key % 2 = 1")
    step(first, 0)
    step(second, 1)
    once = rows_of(gates.latest_flags(spark, base))
    n = spark.read.parquet(f"{base}/rows").count()
    step(second, 1)
    assert rows_of(gates.latest_flags(spark, base)) == once and spark.read.parquet(f"{base}/rows").count() == n


def test_a_batch_reads_only_its_buckets_and_quarters(spark):
    """Ten years of history: what a batch of one quarter reads does not grow."""
    base = gates.stream_folder(spark, f"test_{uuid.uuid4().hex}")
    rows = (spark.range(2000).selectExpr(
        "cast(id AS string) AS invoice_id", "concat('N', id % 50) AS invoice_number", "'Acme' AS vendor_name",
        "cast(date_add(DATE'2010-01-01', cast(id * 1.8 AS int)) AS timestamp_ntz) AS created_at", "true AS valid"))
    read = []
    for number in range(10):
        batch = rows.where(f"year(created_at) = {2010 + number} AND quarter(created_at) = 2")
        touched = gates.add_to_history(batch, base, number, gates.BUCKETS)
        near = gates.history_near(spark, batch.schema, base, number, touched, 91)
        read.append(len(near.inputFiles()))
        rest = rows.where(f"year(created_at) = {2010 + number} AND quarter(created_at) <> 2")
        gates.add_to_history(rest, base, 100 + number, gates.BUCKETS)
    assert max(read) <= 2 * read[0] and len(spark.read.parquet(f"{base}/rows").inputFiles()) > 5 * max(read)


def test_watermark_join(spark, sf_dir, tmp_path):
    path = split_input(spark, sf_dir, tmp_path, 2)
    want = {r.invoice_id for r in E.queries()["duplicates_90d"](spark, sf_dir).collect()}
    found, late = gates.watermarked_duplicates(spark, path)
    assert {r.invoice_id for r in found.collect()} == want and late.count() == 0
    found, late = gates.watermarked_duplicates(spark, path, delay="100 days")
    assert {r.invoice_id for r in found.collect()} <= want
    # files are shuffled: nearly all of the second file lies behind the first one's newest row
    newest = late.selectExpr("count(*) AS n", "count(DISTINCT invoice_id) AS ids").first()
    assert newest.n == newest.ids > 1000


def test_restart_goes_on(spark, sf_dir, tmp_path):
    """Two of three files first, the third after a restart under the same name."""
    path = split_input(spark, sf_dir, tmp_path, 3)
    held = [f for f in sorted(os.listdir(f"{path}/lineitem.parquet")) if f.startswith("part-")][0]
    shutil.move(f"{path}/lineitem.parquet/{held}", f"{path}/{held}")
    name = f"test_{uuid.uuid4().hex}"
    first = {r.invoice_id for r in gates.stream_duplicates(spark, path, name=name).where("is_duplicate").collect()}
    shutil.move(f"{path}/{held}", f"{path}/lineitem.parquet/{held}")
    second = {r.invoice_id for r in gates.stream_duplicates(spark, path, name=name).where("is_duplicate").collect()}
    want = {r.invoice_id for r in E.queries()["duplicates_90d"](spark, sf_dir).collect()}
    assert second == want and first != want
