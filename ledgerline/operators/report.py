"""Reconciliation and dashboard (G1-G6), plus the per-stage agent rows
that the confidence KPI averages. Every report is one aggregate pass with
conditional counts/sums (map-side partial aggregation, no per-status scans)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import (DEFAULT_POLICY, ROLE_ANOMALY, ROLE_EXTRACTION, ROLE_INTAKE,
                      ROLE_RECONCILIATION, ROLE_VALIDATION, Policy)
from .governance import materiality_level

D38 = "decimal(38,2)"


def _count_if(cond) -> F.Column:
    return F.count(F.when(cond, F.lit(1)))


def reconciliation_items(scored: DataFrame) -> DataFrame:
    """G1: one item per invoice."""
    return scored.select("invoice_id", "vendor_name", "invoice_number", "total", "status",
                         F.col("anomaly_types").alias("anomaly_flags"), "escalation_level", "notes")


def batch_items(scored: DataFrame, bad: Column) -> DataFrame:
    """G1 + B11 in one pass: an item for each invoice; a ``bad`` row (one that
    violates a row constraint) becomes a rejected error item."""
    def unless_bad(c, error) -> Column:
        return F.when(bad, error).otherwise(F.col(c))

    null = F.lit(None)
    return scored.select(
        "invoice_id", unless_bad("vendor_name", null).alias("vendor_name"),
        unless_bad("invoice_number", null).alias("invoice_number"), unless_bad("total", null).alias("total"),
        unless_bad("status", F.lit("rejected")).alias("status"),
        unless_bad("anomaly_types", F.array(F.lit("processing_error"))).alias("anomaly_flags"),
        unless_bad("escalation_level", F.lit("none")).alias("escalation_level"),
        unless_bad("notes", F.concat(F.lit("Not stored, breaks: "), F.array_join("violations", ", "))).alias("notes"))


def batch_report(scored: DataFrame, bad: Column | None = None) -> DataFrame:
    """Batch tallies in one aggregate; ``bad`` rows (errors) count as
    rejected, and are not values."""
    bad = F.lit(False) if bad is None else bad
    st = F.when(bad, F.lit("error")).otherwise(F.col("status"))
    value = F.when(~bad, F.col("total"))
    return scored.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        _count_if(st == "approved").alias("approved"),
        _count_if(~st.isin("flagged", "on_hold", "rejected", "error")).alias("matched"),
        _count_if(st.isin("flagged", "on_hold")).alias("flagged"),
        _count_if(st.isin("rejected", "error")).alias("rejected"),
        _count_if(st == "on_hold").alias("on_hold"),
        F.coalesce(F.sum(value), F.lit(0)).cast(D38).alias("total_value"),
        F.coalesce(F.sum(F.when(st.isin("flagged", "on_hold"), value)), F.lit(0)).cast(D38).alias("flagged_value"))


def batch_stage_event(batch: DataFrame) -> DataFrame:
    """The reconciliation stage's event row."""
    return batch.select(F.lit("reconciliation").alias("stage"), F.lit(ROLE_RECONCILIATION).alias("actor"),
                        F.when(F.col("rejected") == 0, F.lit(0.95)).otherwise(F.lit(0.85)).alias("confidence"),
                        "total_invoices", "matched", "flagged", "rejected")


def ledger_by_status(stored: DataFrame) -> DataFrame:
    """G3 by status (NULL status reported as 'unknown')."""
    return (stored.groupBy(F.coalesce(F.col("status"), F.lit("unknown")).alias("status"))
            .agg(F.count(F.lit(1)).alias("n_invoices"), F.sum("total").cast(D38).alias("total_value")))


def ledger_totals(stored: DataFrame, cap: int | None = None) -> DataFrame:
    """G3 totals; ``cap`` (newest N invoices) is off by default."""
    src = stored
    if cap is not None:
        src = stored.orderBy(F.col("created_at").desc(), F.col("invoice_id")).limit(cap)
    st = F.col("status")
    return src.agg(F.count(F.lit(1)).alias("total_invoices"),
                   F.coalesce(F.sum("total"), F.lit(0)).cast(D38).alias("total_value"),
                   F.coalesce(F.sum(F.when(st.isin("flagged", "on_hold", "rejected"), F.col("total"))),
                              F.lit(0)).cast(D38).alias("flagged_value"))


def agent_decision_rows(stored: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Four stage rows per invoice (intake, extraction, validation, anomaly).
    Intake confidence = min(ocr, classification + 0.2); structured rows are
    classified as invoices with confidence 1.0."""
    stages = agent_stages()
    t = float(policy.agent_threshold)
    return (stored.select("invoice_id", "created_at", F.posexplode(stages).alias("stage_no", "s"))
            .select(F.md5(F.concat_ws("|", "invoice_id", F.col("s.agent_role"))).alias("decision_id"),
                    "invoice_id", "stage_no", F.col("s.agent_role").alias("agent_role"),
                    F.col("s.confidence").alias("confidence"),
                    (F.col("s.gated") & (F.col("s.confidence") < F.lit(t))).alias("escalated"),
                    F.col("created_at").alias("timestamp")))


def agent_stages():
    """The four stage results of one scored invoice, as an array of
    (agent_role, confidence, gated) structs."""
    intake = F.least(F.col("ocr_confidence"), F.lit(1.2))
    return F.array(
        F.struct(F.lit(ROLE_INTAKE).alias("agent_role"), intake.alias("confidence"), F.lit(False).alias("gated")),
        F.struct(F.lit(ROLE_EXTRACTION).alias("agent_role"), F.col("extraction_confidence").alias("confidence"),
                 F.lit(True).alias("gated")),
        F.struct(F.lit(ROLE_VALIDATION).alias("agent_role"), F.col("validation_confidence").alias("confidence"),
                 F.lit(True).alias("gated")),
        F.struct(F.lit(ROLE_ANOMALY).alias("agent_role"), F.col("anomaly_confidence").alias("confidence"),
                 F.lit(True).alias("gated")))


def governance_kpis(stored: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The twelve dashboard numbers as one single-row aggregate over the
    scored rows: decision counts come from the gates' booleans and the
    confidence mean from the four stage confidences, so the scoring plan is
    read once (partial aggregates per task, one row shuffled per task)."""
    st, level = F.col("status"), materiality_level(policy)
    # stage confidences in exact integer thousandths; a NULL confidence is
    # skipped by the sum but still counted, as a row of the stage table
    stages = [F.least(F.col("ocr_confidence"), F.lit(1.2)), F.col("extraction_confidence"),
              F.col("validation_confidence"), F.col("anomaly_confidence")]
    sums = [F.sum(F.round(c * 1000).cast("bigint")) for c in stages]
    total = sum((F.coalesce(x, F.lit(0)) for x in sums), F.lit(0))

    def tier(name: str) -> Column:  # only materiality escalates to a tier
        return _count_if(F.col("g_materiality_on") & (level == name))

    agg = stored.agg(
        F.count(F.lit(1)).alias("total_processed"),
        _count_if(st.isin("pending", "on_hold", "flagged")).alias("pending_review"),
        _count_if(st == "approved").alias("auto_approved"),
        _count_if(F.col("ocr_confidence") < F.lit(0.85)).alias("ocr_failures"),
        tier("l1_manager").alias("escalated_l1"), tier("l2_controller").alias("escalated_l2"),
        tier("l3_vp_cfo").alias("escalated_l3"),
        _count_if(F.col("g_dup_on")).alias("blocked"),  # the only blocking gate
        _count_if(F.col("g_dup_on")).alias("duplicate_flags"),
        _count_if(F.col("g_vendor_on")).alias("unknown_vendor_flags"),
        _count_if(F.col("g_variance_on")).alias("amount_variance_flags"),
        F.when(F.coalesce(*sums).isNotNull(), total).alias("_s"),
        (F.count(F.lit(1)) * len(stages)).alias("_n"))
    counts = ["escalated_l1", "escalated_l2", "escalated_l3", "blocked", "duplicate_flags",
              "unknown_vendor_flags", "amount_variance_flags"]
    return agg.select(
        "total_processed", "pending_review", "auto_approved", "ocr_failures",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.when(F.col("_n") == 0, F.lit(0.0))
        .otherwise(F.expr("(2 * _s + _n) div (2 * _n)").cast("double") / F.lit(1000.0))
        .alias("avg_confidence"))


def dashboard_series(kpis: DataFrame) -> DataFrame:
    """Status slices (only those > 0) and escalation bars."""
    long = kpis.select(F.expr(
        "stack(6, 'status', 1, 'Auto-Approved', auto_approved, 'status', 2, 'Pending', pending_review, "
        "'status', 3, 'Blocked', blocked, 'escalation', 1, 'L1 Manager', escalated_l1, "
        "'escalation', 2, 'L2 Controller', escalated_l2, 'escalation', 3, 'L3 VP/CFO', escalated_l3) "
        "AS (series, pos, name, value)"))
    return long.where((F.col("series") == "escalation") | (F.col("value") > 0))
