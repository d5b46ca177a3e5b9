"""Merges into a stored ledger: the right rows, and only touched buckets written."""

from __future__ import annotations

import glob
import hashlib

import pytest

from ledgerline.operators.ledger import create_ledger, merge_ledger, read_ledger

COLS = "id string, status string, document_type string, created_at long"


def files(path):
    return {f: hashlib.md5(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def now(spark, path):
    return sorted(tuple(r) for r in read_ledger(spark, path).select("id", "status", "document_type", "created_at").collect())


def test_merges(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = {f"i{n}": ("processing", "invoice", n) for n in range(200)}
    create_ledger(spark.createDataFrame([(k, *v) for k, v in rows.items()], COLS), path, "id", buckets=16)
    assert now(spark, path) == sorted((k, *v) for k, v in rows.items())
    before = files(path)
    new = spark.createDataFrame([("i3", "rejected", "x", 9), ("i4", "approved", "x", 9), ("new", "on_hold", "x", 9)], COLS)
    assert 1 <= merge_ledger(new, path, "id", "first") <= 3
    rows |= {"i3": ("rejected", "invoice", 3), "i4": ("approved", "invoice", 4), "new": ("on_hold", "x", 9)}
    assert now(spark, path) == sorted((k, *v) for k, v in rows.items())
    after = files(path)
    assert before.items() <= after.items()          # nothing changed, touched buckets added
    assert len({f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys()}) <= 3
    # the same merge again, an empty one, and a status change that names fewer columns
    assert merge_ledger(new, path, "id", "first") == 0
    assert merge_ledger(new.limit(0), path, "id", "none") == 0
    assert files(path) == after
    merge_ledger(spark.createDataFrame([("i5", "flagged")], "id string, status string"), path, "id", "second")
    rows["i5"] = ("flagged", "invoice", 5)
    assert now(spark, path) == sorted((k, *v) for k, v in rows.items())


def test_a_merge_that_failed_leaves_the_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    create_ledger(spark.createDataFrame([("a", "processing", "invoice", 1)], COLS), path, "id", buckets=4)
    before = now(spark, path)
    bad = spark.createDataFrame([("a", "approved", "x", 2)], COLS)

    def fails(old, new, key):
        return old.selectExpr("id", "status", "document_type", "CAST(raise_error('lost') AS LONG) AS created_at")

    with pytest.raises(Exception, match="lost"):
        merge_ledger(bad, path, "id", "m", fails)
    assert now(spark, path) == before
    assert merge_ledger(bad, path, "id", "m") == 1
    assert now(spark, path) == [("a", "approved", "invoice", 1)]
