"""Streaming queries (K1, K2): driven to completion with availableNow, then
compared with the batch plans' oracles (stream = batch when nothing is late)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import gates as K
from .catalog import query
from .oracle_base import SCORED


@query("stream_gates", f"""{SCORED} SELECT invoice_id, status, escalation_level, n_decisions, validation_status,
  risk_score FROM scored""")
def stream_gates(spark, sf):
    return K.stream_gates(spark, sf)


@query("stream_duplicates", f"{SCORED} SELECT invoice_id FROM scored WHERE is_duplicate")
def stream_duplicates(spark, sf):
    return K.stream_duplicates(spark, sf).where(F.col("is_duplicate")).select("invoice_id")
