"""The checkpoint folder comes from the session when it is set, and is stable."""

from __future__ import annotations

from ledgerline.session import ensure_checkpoint_dir


def test_checkpoint_dir_from_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    first = ensure_checkpoint_dir(spark)
    if configured:
        assert first == configured
    assert ensure_checkpoint_dir(spark) == first
