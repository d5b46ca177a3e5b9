"""Queries over the scored invoices: validation (D), anomalies (E),
governance (F), reconciliation and dashboard (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..operators.anomaly import (analyze, detect_amount_outlier, detect_date_anomaly, detect_missing_fields,
                                 detect_round_number, detect_unknown_vendor, missing_field_list)
from ..operators.enrich import duplicate_history, match_pos, match_vendors
from ..operators.governance import decision_audit_rows, decision_rows, gate_decisions
from ..operators.validate import check_arithmetic, check_currency, check_date, check_po, check_vendor, validate
from ..policy import DEFAULT_POLICY
from ..sources import domain
from .catalog import query
from .oracle_base import SCORED, VARIANCE_TENTHS
from ..operators.registry import invoice_violations, no_violations
from .scoring import normalise_currency, score, scored_from_tables

ALLOWED = "('USD','CAD','EUR','GBP','AUD','JPY','CHF')"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return scored_from_tables(spark, sf)


def validated(spark: SparkSession, sf: str) -> DataFrame:
    """As ``scored``, for queries of the checks alone: no check reads the duplicate history."""
    return score(domain.invoices(spark, sf), domain.vendors(spark, sf), domain.po_amounts(spark, sf), duplicates=False)


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices that pass the row constraints (B8) and are persisted."""
    return scored(spark, sf).where(no_violations())


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices without lookups: enough for checks on their own fields."""
    return invoice_violations(normalise_currency(domain.invoices(spark, sf)))


def with_vendors(spark: SparkSession, sf: str) -> DataFrame:
    return match_vendors(invoices(spark, sf), domain.vendors(spark, sf))


def with_pos(spark: SparkSession, sf: str) -> DataFrame:
    return match_pos(invoices(spark, sf), domain.po_amounts(spark, sf))


def with_duplicates(inv: DataFrame) -> DataFrame:
    return duplicate_history(inv, witness=no_violations())


def _check(frame, check):
    """One field check on the frame that holds just its lookups."""
    def run(spark, sf):
        s = frame(spark, sf).select("invoice_id", check().alias("r"))
        return s.select("invoice_id", F.col("r.field_name").alias("field_name"), F.col("r.status").alias("status"),
                        F.col("r.confidence").cast("double").alias("confidence"))
    return run


def _check_sql(name: str, field: str) -> str:
    return f"""{SCORED} SELECT invoice_id, '{field}' AS field_name, {name}_status AS status,
      CAST({name}_conf AS DOUBLE) AS confidence FROM scored"""


for _key, _n, _f, _frame, _fn in [("validate_vendor", "vendor", "vendor_name", with_vendors, check_vendor),
                                  ("validate_po", "po", "po_number", with_pos, check_po),
                                  ("validate_date", "date", "invoice_date", invoices, check_date),
                                  ("validate_arithmetic", "arith", "total", invoices, check_arithmetic),
                                  ("validate_currency", "currency", "currency", invoices, check_currency)]:
    query(_key, _check_sql(_n, _f))(_check(_frame, _fn))


@query("validation_field_results", f"""{SCORED}
SELECT invoice_id, pos, field_name, status, confidence FROM (
  SELECT invoice_id, 1 AS pos, 'vendor_name' AS field_name, vendor_status AS status, CAST(vendor_conf AS DOUBLE) AS confidence FROM scored
  UNION ALL SELECT invoice_id, 2, 'po_number', po_status, CAST(po_conf AS DOUBLE) FROM scored
  UNION ALL SELECT invoice_id, 3, 'invoice_date', date_status, CAST(date_conf AS DOUBLE) FROM scored
  UNION ALL SELECT invoice_id, 4, 'total', arith_status, CAST(arith_conf AS DOUBLE) FROM scored
  UNION ALL SELECT invoice_id, 5, 'currency', currency_status, CAST(currency_conf AS DOUBLE) FROM scored)""")
def validation_field_results(spark, sf):
    s = validated(spark, sf).select("invoice_id", F.posexplode("field_results").alias("p", "r"))
    return s.select("invoice_id", (F.col("p") + 1).alias("pos"), F.col("r.field_name").alias("field_name"),
                    F.col("r.status").alias("status"), F.col("r.confidence").cast("double").alias("confidence"))


@query("validation_overall", f"{SCORED} SELECT invoice_id, validation_status FROM scored")
def validation_overall(spark, sf):
    return validated(spark, sf).select("invoice_id", "validation_status")


@query("validation_confidence", f"{SCORED} SELECT invoice_id, validation_confidence FROM scored")
def validation_confidence(spark, sf):
    return validated(spark, sf).select("invoice_id", "validation_confidence")


@query("po_variance", f"{SCORED} SELECT invoice_id, po_variance_pct, po_match FROM scored")
def po_variance(spark, sf):
    return validated(spark, sf).select("invoice_id", "po_variance_pct", "po_match")


@query("validation_report", f"""{SCORED} SELECT invoice_id, validation_status, po_match, po_variance_pct,
  vendor_approved, validation_confidence, true AS budget_ok FROM scored""")
def validation_report(spark, sf):
    return validated(spark, sf).select("invoice_id", "validation_status", "po_match", "po_variance_pct",
                                    "vendor_approved", "validation_confidence", "budget_ok")


@query("validation_summary", f"{SCORED} SELECT validation_status, count(*) AS n FROM scored GROUP BY 1")
def validation_summary(spark, sf):
    return validated(spark, sf).groupBy("validation_status").agg(F.count(F.lit(1)).alias("n"))


@query("duplicates_90d", f"""{SCORED} SELECT invoice_id, invoice_number, lower(vendor_name) AS vendor_key,
  duplicate_of FROM scored WHERE is_duplicate""")
def duplicates_90d(spark, sf):
    return (with_duplicates(invoices(spark, sf)).where("is_duplicate")
            .select("invoice_id", "invoice_number", F.lower("vendor_name").alias("vendor_key"), "duplicate_of"))


def _flagged(frame: DataFrame, flag) -> DataFrame:
    """The invoices with the flag ``a``, on the frame that holds just its lookups."""
    return frame.withColumn("a", flag).where(F.col("a").isNotNull())


@query("amount_outliers", f"""{SCORED} SELECT invoice_id, sev_outlier AS severity,
  CASE WHEN total > po_amount THEN 'exceeds' ELSE 'is below' END AS direction
  FROM scored WHERE sev_outlier IS NOT NULL""")
def amount_outliers(spark, sf):
    s = _flagged(with_pos(spark, sf), detect_amount_outlier())
    return s.select("invoice_id", F.col("a.severity").alias("severity"),
                    F.when(F.col("total") > F.col("po_amount"), "exceeds").otherwise("is below").alias("direction"))


@query("unknown_vendors", f"""{SCORED} SELECT invoice_id, vendor_anomaly AS anomaly_type, 'high' AS severity
  FROM scored WHERE vendor_anomaly IS NOT NULL""")
def unknown_vendors(spark, sf):
    s = _flagged(with_vendors(spark, sf), detect_unknown_vendor())
    return s.select("invoice_id", F.col("a.anomaly_type").alias("anomaly_type"), F.col("a.severity").alias("severity"))


@query("date_anomalies", f"""{SCORED} SELECT invoice_id, date_anomaly_type AS anomaly_type, sev_date AS severity,
  CASE WHEN date_anomaly_type = 'stale_invoice' THEN CAST(DATE '2000-06-01' - invoice_date AS INTEGER) END AS age_days
  FROM scored WHERE date_anomaly_type IS NOT NULL""")
def date_anomalies(spark, sf):
    s = _flagged(invoices(spark, sf), detect_date_anomaly())
    return s.select("invoice_id", F.col("a.anomaly_type").alias("anomaly_type"), F.col("a.severity").alias("severity"),
                    F.when(F.col("a.anomaly_type") == "stale_invoice",
                           F.datediff(F.lit(DEFAULT_POLICY.as_of), "invoice_date")).alias("age_days"))


@query("round_numbers", f"SELECT invoice_id, total FROM ({SCORED} SELECT * FROM scored) WHERE is_round")
def round_numbers(spark, sf):
    return _flagged(invoices(spark, sf), detect_round_number()).select("invoice_id", "total")


@query("missing_fields", f"""{SCORED} SELECT invoice_id, missing_list AS missing_fields, sev_missing AS severity
  FROM scored WHERE n_missing > 0""")
def missing_fields(spark, sf):
    s = _flagged(invoices(spark, sf), detect_missing_fields())
    return s.select("invoice_id", F.array_join(missing_field_list(), ", ").alias("missing_fields"),
                    F.col("a.severity").alias("severity"))


@query("anomaly_report", f"{SCORED} SELECT invoice_id, anomaly_types, risk_score FROM scored")
def anomaly_report(spark, sf):
    return scored(spark, sf).select("invoice_id", F.array_join("anomaly_types", ",").alias("anomaly_types"),
                                    "risk_score")


@query("anomaly_flags", f"""{SCORED} SELECT invoice_id, sev_dup IS NOT NULL AS is_duplicate,
  sev_outlier IS NOT NULL AS amount_outlier, vendor_anomaly IS NOT NULL AS unknown_vendor,
  date_anomaly_type IS NOT NULL AS date_anomaly,
  (sev_dup IS NOT NULL OR coalesce(sev_outlier = 'critical', false)) AS has_critical FROM scored""")
def anomaly_flags(spark, sf):
    return scored(spark, sf).select("invoice_id", F.col("is_duplicate_flag").alias("is_duplicate"),
                                    "amount_outlier", "unknown_vendor", "date_anomaly", "has_critical")


@query("anomaly_confidence", f"{SCORED} SELECT invoice_id, anomaly_confidence FROM scored")
def anomaly_confidence(spark, sf):
    return scored(spark, sf).select("invoice_id", "anomaly_confidence")


@query("anomalies_by_severity", f"""{SCORED} SELECT severity, count(*) AS n FROM (
  SELECT sev_dup AS severity FROM scored UNION ALL SELECT sev_outlier FROM scored
  UNION ALL SELECT sev_vendor FROM scored UNION ALL SELECT sev_date FROM scored
  UNION ALL SELECT sev_round FROM scored UNION ALL SELECT sev_missing FROM scored)
  WHERE severity IS NOT NULL GROUP BY severity""")
def anomalies_by_severity(spark, sf):
    s = scored(spark, sf).select(F.explode("anomalies").alias("a"))
    return s.groupBy(F.col("a.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


# --- governance ---------------------------------------------------------------

DEC_COLS = "invoice_id, seq, rule_triggered, decision, escalation_level, actor, threshold_value, actual_value"


def decisions(spark, sf) -> DataFrame:
    return decision_rows(scored(spark, sf))


def _dup_frame(spark, sf) -> DataFrame:
    return with_duplicates(invoices(spark, sf))


def _vendor_frame(spark, sf) -> DataFrame:
    return with_duplicates(with_vendors(spark, sf))


def _lookup_frame(spark, sf) -> DataFrame:
    return with_duplicates(match_pos(with_vendors(spark, sf), domain.po_amounts(spark, sf)))


def _full_frame(spark, sf) -> DataFrame:
    return analyze(validate(_lookup_frame(spark, sf)))


def _gate(frame, gates):
    """The decisions of some gates, on the frame that holds what these and the
    gates before them read (the position in the list counts those)."""
    def run(spark, sf):
        return gate_decisions(frame(spark, sf), gates).select(*DEC_COLS.split(", "))
    return run


for _key, _rule, _frame, _gates in [
        ("gate_ocr", "ocr_confidence_gate", invoices, ["g_ocr"]),
        ("gate_duplicate", "duplicate_detection", _dup_frame, ["g_dup"]),
        ("gate_unknown_vendor", "unknown_vendor", _vendor_frame, ["g_vendor"]),
        ("gate_variance", "variance_threshold", _lookup_frame, ["g_variance"]),
        ("gate_materiality", "materiality_gate", _full_frame, ["g_materiality"]),
        ("gate_confidence", "agent_confidence_gate", _full_frame,
         ["g_conf_extract", "g_conf_validate", "g_conf_anomaly"])]:
    query(_key, f"{SCORED} SELECT {DEC_COLS} FROM decisions WHERE rule_triggered = '{_rule}'")(_gate(_frame, _gates))


@query("governance_decisions", f"{SCORED} SELECT {DEC_COLS} FROM decisions")
def governance_decisions(spark, sf):
    return decisions(spark, sf).select(*DEC_COLS.split(", "))


@query("final_status", f"""{SCORED} SELECT invoice_id, status, escalation_level, n_decisions, validation_status,
  risk_score FROM scored""")
def final_status(spark, sf):
    return scored(spark, sf).select("invoice_id", "status", "escalation_level", "n_decisions",
                                    "validation_status", "risk_score")


@query("escalation_level", f"{SCORED} SELECT invoice_id, escalation_level FROM scored")
def escalation_level(spark, sf):
    return scored(spark, sf).select("invoice_id", "escalation_level")


# reason text; percentages of constants have at most one place, the variance is rounded half-even in cents.
def _percent_sql(value: str) -> str:
    return f"printf('%.1f%%', {value} * 100)"


def _confidence_note_sql(place: int, gate: str, value: str, actor: str) -> str:
    return (f"SELECT invoice_id, {place}, '{actor} is only ' || {_percent_sql(value)} "
            f"|| ' sure, 70% are asked for; a person decides.' FROM s0 WHERE {gate}")


NOTES_SQL = f"""{SCORED},
reasons AS (
  SELECT invoice_id, 1 AS ord, 'Text recognition is only ' || {_percent_sql("ocr_confidence")}
    || ' sure, 85% are asked for; check by hand.' AS reason FROM s0 WHERE g_ocr
  UNION ALL SELECT invoice_id, 2, 'Number ' || invoice_number || ' of ''' || vendor_name || ''' came as ' || duplicate_of
    || ' in the last 90 days.' FROM s0 WHERE g_dup
  UNION ALL {_confidence_note_sql(3, "g_conf_extract", "extraction_confidence", "data_extraction_analyst")}
  UNION ALL SELECT invoice_id, 4, CASE WHEN vendor_anomaly = 'missing_vendor' THEN 'Held for review: no vendor could be read.'
    ELSE 'Held until ''' || vendor_name || ''' is an approved vendor.' END FROM s0 WHERE g_vendor
  UNION ALL SELECT invoice_id, 5, 'Total ' || CAST(total AS VARCHAR) || ' against order ' || po_number || ' of '
    || CAST(po_amount AS VARCHAR) || ': off by ' || {_percent_sql(VARIANCE_TENTHS)} || ', 10% are tolerated.'
    FROM s0 WHERE g_variance
  UNION ALL {_confidence_note_sql(6, "g_conf_validate", "validation_confidence", "validation_officer")}
  UNION ALL SELECT invoice_id, 7, 'Total ' || CAST(total AS VARCHAR) || ' needs approval at ' || CASE materiality_level
    WHEN 'l3_vp_cfo' THEN '$100,000 L3 VP/CFO' WHEN 'l2_controller' THEN '$25,000 L2 Controller'
    ELSE '$5,000 L1 Manager' END || '.' FROM s0 WHERE materiality_level IS NOT NULL
  UNION ALL {_confidence_note_sql(8, "g_conf_anomaly", "anomaly_confidence", "anomaly_detection_specialist")}),
notes AS (SELECT invoice_id, string_agg(reason, '; ' ORDER BY ord) AS notes FROM reasons GROUP BY invoice_id)
SELECT scored.invoice_id, scored.n_decisions, coalesce(notes.notes, '') AS notes
FROM scored LEFT JOIN notes USING (invoice_id)"""


@query("decision_notes", NOTES_SQL)
def decision_notes(spark, sf):
    return scored(spark, sf).select("invoice_id", "n_decisions", "notes")


@query("governance_audit_rows", f"""{SCORED} SELECT md5(md5(invoice_id || '|' || CAST(seq - 1 AS VARCHAR) || '|' || rule_triggered)
  || '|audit') AS entry_id, invoice_id, 'governance.' || rule_triggered AS event_type, actor FROM decisions""")
def governance_audit_rows(spark, sf):
    return decision_audit_rows(decisions(spark, sf)).select("entry_id", "invoice_id", "event_type", "actor")


# --- reconciliation / dashboard --------------------------------------------------

STORED = f"{SCORED}, stored AS (SELECT * FROM scored WHERE currency IN {ALLOWED})"


@query("reconciliation_items", f"""{STORED} SELECT invoice_id, vendor_name, invoice_number, total, status,
  anomaly_types, escalation_level FROM stored""")
def reconciliation_items(spark, sf):
    return report.reconciliation_items(stored(spark, sf)).select(
        "invoice_id", "vendor_name", "invoice_number", "total", "status",
        F.array_join("anomaly_flags", ",").alias("anomaly_types"), "escalation_level")


BATCH_SQL = f"""{STORED}, errs AS (SELECT count(*) AS n FROM scored WHERE currency NOT IN {ALLOWED})
SELECT CAST(count(*) + (SELECT n FROM errs) AS BIGINT) AS total_invoices,
  CAST(count(*) FILTER (WHERE status = 'approved') AS BIGINT) AS approved,
  CAST(count(*) FILTER (WHERE status NOT IN ('flagged','on_hold','rejected')) AS BIGINT) AS matched,
  CAST(count(*) FILTER (WHERE status IN ('flagged','on_hold')) AS BIGINT) AS flagged,
  CAST(count(*) FILTER (WHERE status = 'rejected') + (SELECT n FROM errs) AS BIGINT) AS rejected,
  CAST(count(*) FILTER (WHERE status = 'on_hold') AS BIGINT) AS on_hold,
  CAST(coalesce(sum(total), 0) AS DECIMAL(38,2)) AS total_value,
  CAST(coalesce(sum(total) FILTER (WHERE status IN ('flagged','on_hold')), 0) AS DECIMAL(38,2)) AS flagged_value
FROM stored"""


@query("batch_report", BATCH_SQL)
def batch_report(spark, sf):
    return report.batch_report(scored(spark, sf), ~no_violations())


@query("ledger_by_status", f"""{STORED} SELECT coalesce(status, 'unknown') AS status, count(*) AS n_invoices,
  CAST(sum(total) AS DECIMAL(38,2)) AS total_value FROM stored GROUP BY 1""")
def ledger_by_status(spark, sf):
    return report.ledger_by_status(stored(spark, sf))


@query("ledger_totals", f"""{STORED} SELECT count(*) AS total_invoices,
  CAST(coalesce(sum(total), 0) AS DECIMAL(38,2)) AS total_value,
  CAST(coalesce(sum(total) FILTER (WHERE status IN ('flagged','on_hold','rejected')), 0) AS DECIMAL(38,2)) AS flagged_value
FROM stored""")
def ledger_totals(spark, sf):
    return report.ledger_totals(stored(spark, sf))


KPI_SQL = f"""{STORED},
sd AS (SELECT d.* FROM decisions d JOIN stored USING (invoice_id)),
ag AS (SELECT CAST(round(ocr_confidence * 1000) AS BIGINT) AS k FROM stored
       UNION ALL SELECT CAST(round(extraction_confidence * 1000) AS BIGINT) FROM stored
       UNION ALL SELECT CAST(round(validation_confidence * 1000) AS BIGINT) FROM stored
       UNION ALL SELECT CAST(round(anomaly_confidence * 1000) AS BIGINT) FROM stored),
k1 AS (SELECT count(*) AS total_processed,
         count(*) FILTER (WHERE status IN ('pending','on_hold','flagged')) AS pending_review,
         count(*) FILTER (WHERE status = 'approved') AS auto_approved,
         count(*) FILTER (WHERE ocr_confidence < 0.85) AS ocr_failures FROM stored),
k2 AS (SELECT count(*) FILTER (WHERE escalation_level = 'l1_manager') AS escalated_l1,
         count(*) FILTER (WHERE escalation_level = 'l2_controller') AS escalated_l2,
         count(*) FILTER (WHERE escalation_level = 'l3_vp_cfo') AS escalated_l3,
         count(*) FILTER (WHERE decision = 'block') AS blocked,
         count(*) FILTER (WHERE rule_triggered = 'duplicate_detection') AS duplicate_flags,
         count(*) FILTER (WHERE rule_triggered = 'unknown_vendor') AS unknown_vendor_flags,
         count(*) FILTER (WHERE rule_triggered = 'variance_threshold') AS amount_variance_flags FROM sd),
k3 AS (SELECT CASE WHEN count(*) = 0 THEN 0.0 ELSE
         CAST((2 * sum(k) + count(*)) // (2 * count(*)) AS DOUBLE) / 1000.0 END AS avg_confidence FROM ag),
kpis AS (SELECT * FROM k1, k2, k3)"""


@query("governance_kpis", KPI_SQL + " SELECT * FROM kpis")
def governance_kpis(spark, sf):
    st = stored(spark, sf)
    return report.governance_kpis(st)


@query("dashboard_series", KPI_SQL + """
SELECT * FROM (
  SELECT 'status' AS series, 1 AS pos, 'Auto-Approved' AS name, auto_approved AS value FROM kpis
  UNION ALL SELECT 'status', 2, 'Pending', pending_review FROM kpis
  UNION ALL SELECT 'status', 3, 'Blocked', blocked FROM kpis) WHERE value > 0
UNION ALL SELECT 'escalation', 1, 'L1 Manager', escalated_l1 FROM kpis
UNION ALL SELECT 'escalation', 2, 'L2 Controller', escalated_l2 FROM kpis
UNION ALL SELECT 'escalation', 3, 'L3 VP/CFO', escalated_l3 FROM kpis""")
def dashboard_series(spark, sf):
    return report.dashboard_series(governance_kpis(spark, sf))


@query("batch_stage_event", f"""SELECT 'reconciliation' AS stage, 'reconciliation_manager' AS actor,
  CASE WHEN rejected = 0 THEN 0.95 ELSE 0.85 END AS confidence, total_invoices, matched, flagged, rejected
FROM ({BATCH_SQL}) b""")
def batch_stage_event(spark, sf):
    return report.batch_stage_event(batch_report(spark, sf))
