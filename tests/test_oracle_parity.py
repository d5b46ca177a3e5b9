"""Every registered query that has an oracle: Spark result == DuckDB result
(row count, column names, order-insensitive value hash)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from ledgerline.plans.compare import digest

ORACLE = E.oracle_sql()
# test_streaming.py compares the streams with the batch plans
KEYS = sorted(k for k in ORACLE if not k.startswith("stream_"))


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(ORACLE) <= set(qs)
    assert all(callable(f) for f in qs.values())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, sf_dir, key):
    sdf = E.queries()[key](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLE[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    hs, ls = digest(sdf.columns, srows)
    ho, lo = digest(ocols, orows)
    if hs != ho:
        a, b = set(ls), set(lo)
        pytest.fail(f"spark-only {sorted(a - b)[:3]} duck-only {sorted(b - a)[:3]}")


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns
    assert df.count() >= 0
