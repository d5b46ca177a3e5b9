"""Enrichment: registry lookups and the 90-day duplicate history, computed once
per invoice and reused by every check, detector and gate.

The vendor registry is broadcast if it is counted to be small (``joins.small_side``);
else, and for the POs, the choice of a join is left to AQE, which converts one to a
broadcast only after the registry side has been materialised and measured under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and otherwise keeps the
sort-merge join (with skew-split of hot keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cols import missing
from ..joins import hash_bits, may_have, small_side
from ..policy import DEFAULT_POLICY, Policy


def _spread_key(key: Column, row_id: Column) -> Column:
    """Join key that never matches when ``key`` is missing, and spreads those
    rows over all partitions instead of sending every NULL to one task."""
    return F.when(missing(key), F.concat(F.lit("\u0000"), row_id)).otherwise(key)


def vendor_registry(vendors: DataFrame) -> DataFrame:
    """Registry deduplicated on lower(name): one row per lookup key."""
    return (vendors.groupBy(F.lower("name").alias("_vkey"))
            .agg(F.min(F.struct("vendor_id", "name", "approved")).alias("_v"))
            .select("_vkey",
                    F.col("_v.vendor_id").alias("matched_vendor_id"),
                    F.col("_v.name").alias("registry_name"),
                    F.col("_v.approved").alias("registry_approved")))


def match_vendors(inv: DataFrame, vendors: DataFrame) -> DataFrame:
    """Case-insensitive vendor lookup; adds vendor_found, vendor_approved."""
    reg = small_side(vendor_registry(vendors))
    key = _spread_key(F.lower("vendor_name"), F.col("invoice_id"))
    j = inv.withColumn("_vkey", key).join(reg, "_vkey", "left").drop("_vkey")
    return (j.withColumn("vendor_found", F.col("matched_vendor_id").isNotNull())
             .withColumn("vendor_approved",
                         F.coalesce(F.col("registry_approved"), F.lit(False))))


def match_pos(inv: DataFrame, pos: DataFrame) -> DataFrame:
    """Exact PO-number lookup; adds po_found, po_amount."""
    p = pos.select(F.col("po_number").alias("_pkey"), F.col("amount").alias("po_amount"))
    key = _spread_key(F.col("po_number"), F.col("invoice_id"))
    j = inv.withColumn("_pkey", key).join(p, "_pkey", "left").drop("_pkey")
    return j.withColumn("po_found", F.col("po_amount").isNotNull())


def duplicate_history(inv: DataFrame, policy: Policy = DEFAULT_POLICY,
                      history: DataFrame | None = None, witness: Column | None = None) -> DataFrame:
    """Is there an earlier invoice (by created_at, then invoice_id) with the
    same invoice_number and lower(vendor_name) no more than N days older?

    Skew-safe formulation (a single key may hold a large share of the rows):
      * keys that occur once have no earlier invoice: only rows of keys whose hash
        is counted twice, found again by a bitmap, go any further;
      * per (number, vendor, day) only the first and last row are kept
        (a partial aggregate, combined map-side);
      * a running window over those daily rows (at most one row per key and day)
        gives the newest row of earlier days;
      * a row is a duplicate if it is not the first of its day (an earlier
        same-day row exists, within N days by construction, N >= 1), or the
        newest row of earlier days is at most N days older.
    The witness is the first row of the same day, else that newest earlier row.
    Only days with several rows or a witness near enough are joined to the rows.
    ``history`` adds already-stored invoices as possible witnesses; ``witness``
    says which rows of ``inv`` may be one (those that get stored; default all).
    Rows missing the number or the vendor are never duplicates and join nothing.
    """
    cols = ["invoice_id", "invoice_number", "vendor_name", "created_at"]
    src = inv.select(*cols, (F.lit(True) if witness is None else witness).alias("_w"))
    if history is not None:
        src = src.unionByName(history.select(*cols, F.lit(True).alias("_w")))
    has_key = ~missing(F.col("invoice_number")) & ~missing(F.col("vendor_name"))
    key = F.xxhash64("invoice_number", F.lower("vendor_name"))
    hashes = src.where(has_key).groupBy(key.alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    several = has_key & may_have(hash_bits(hashes.where("_n > 1").select("_h")), key)

    keyed = (src.where(several)
             .select(F.col("invoice_number").alias("_k1"), F.lower("vendor_name").alias("_k2"),
                     F.to_date("created_at").alias("_day"),
                     F.when(F.col("_w"), F.struct("created_at", "invoice_id")).alias("_r")))
    daily = keyed.groupBy("_k1", "_k2", "_day").agg(F.min("_r").alias("_first"), F.max("_r").alias("_last"),
                                                     F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_k1", "_k2").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.withColumn("_prev", F.last("_last", ignorenulls=True).over(w)).drop("_last")
    near = F.datediff("_day", F.to_date("_prev.created_at")) <= int(policy.duplicate_days)
    daily = daily.where((F.col("_n") > 1) | near).drop("_n")

    left = inv.where(several).withColumns({"_k1": F.col("invoice_number"), "_k2": F.lower("vendor_name"),
                                           "_day": F.to_date("created_at")})
    j = left.join(daily, ["_k1", "_k2", "_day"], "left")
    me = F.struct("created_at", "invoice_id")
    same_day = F.col("_first").isNotNull() & (F.col("_first") < me)
    earlier = (F.col("_prev").isNotNull()
               & (F.col("_prev.created_at")
                  >= F.col("created_at") - F.expr(f"INTERVAL {int(policy.duplicate_days)} DAYS")))
    found = (j.withColumn("is_duplicate", F.coalesce(same_day | earlier, F.lit(False)))
             .withColumn("duplicate_of",
                         F.when(same_day, F.col("_first.invoice_id"))
                          .when(earlier, F.col("_prev.invoice_id")))
             .withColumn("duplicate_of_created_at",
                         F.when(same_day, F.col("_first.created_at"))
                          .when(earlier, F.col("_prev.created_at")))
             .drop("_k1", "_k2", "_day", "_first", "_prev"))
    alone = inv.where(~several).withColumns({
        "is_duplicate": F.lit(False),
        "duplicate_of": F.lit(None).cast(inv.schema["invoice_id"].dataType),
        "duplicate_of_created_at": F.lit(None).cast(inv.schema["created_at"].dataType)})
    return alone.unionByName(found)


def enrich(inv: DataFrame, vendors: DataFrame, pos: DataFrame,
           policy: Policy = DEFAULT_POLICY, history: DataFrame | None = None,
           witness: Column | None = None) -> DataFrame:
    """All lookups an invoice needs, each done once (the reference repeats
    them per check: 4 PO, 4 vendor, 2 duplicate lookups per invoice)."""
    # the history first: its rows are read a second time, without the lookups
    return match_pos(match_vendors(duplicate_history(inv, policy, history, witness), vendors), pos)
