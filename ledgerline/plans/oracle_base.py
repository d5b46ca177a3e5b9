"""Independent SQL formulation of the domain tables and the scored invoices,
for DuckDB over the same parquet tables. Used only as the correctness oracle:
plain windows (lag / first_value) and CASE chains, no shared code with the
Spark plans."""

from __future__ import annotations

from ..operators.prefix import ratio_half_even_sql

AS_OF = "DATE '2000-06-01'"
# half-even in whole cents
VARIANCE = ratio_half_even_sql("abs(total - po_amount) * 100", "CAST(po_amount * 100 AS BIGINT)", 4)
VARIANCE_TENTHS = ratio_half_even_sql("abs(total - po_amount) * 100", "CAST(po_amount * 100 AS BIGINT)", 3)  # of a percent

DOMAIN = f"""
vendors AS (
  SELECT 'VND' || CAST(s_suppkey AS VARCHAR) AS vendor_id, s_name AS name, n_name AS category,
         s_acctbal >= 0 AS approved, 30 AS payment_terms_days
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
pos AS (
  SELECT 'PO-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS po_number,
         'VND' || CAST(min(l_suppkey) AS VARCHAR) AS vendor_id,
         CAST(CAST(min(l_extendedprice) AS DECIMAL(12,2))
              * CAST(0.55 + 0.15 * (l_linenumber - 1) AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS amount,
         'USD' AS currency, CAST(any_value(o_orderdate) AS DATE) AS issued_date, 'open' AS status
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
  GROUP BY l_orderkey, l_linenumber),
inv0 AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d')) AS invoice_id,
         l_orderkey AS order_key,
         CASE WHEN l_partkey % 37 = 0 THEN '' ELSE 'INV-' || CAST(l_partkey AS VARCHAR) END AS invoice_number,
         CASE WHEN l_suppkey % 29 = 0 THEN NULL WHEN l_suppkey % 17 = 0 THEN 'Unlisted ' || CAST(l_suppkey AS VARCHAR)
              ELSE upper(s_name) END AS vendor_name,
         CASE WHEN l_quantity = 13 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS invoice_date,
         CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 'PO-NONE'
              ELSE 'PO-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS po_number,
         CASE l_suppkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'CAD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'gbp' ELSE 'XXX' END AS currency_raw,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS subtotal,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2))
              * CAST(1 + l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS total,
         l_linenumber AS line_no,
         l_returnflag = 'R' AS ocr_used,
         CAST(CAST(1 - 3 * l_discount AS DECIMAL(4,2)) AS DOUBLE) AS ocr_confidence,
         l_shipdate AS created_at
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey),
inv AS (
  SELECT invoice_id, order_key, invoice_number, vendor_name, invoice_date, po_number, currency_raw,
         upper(coalesce(currency_raw, 'USD')) AS currency, subtotal,
         CAST(total - subtotal + CASE WHEN line_no = 6 THEN 2.00 ELSE 0.00 END AS DECIMAL(18,2)) AS tax,
         total, ocr_used, ocr_confidence, created_at,
         CAST((CASE WHEN vendor_name IS NULL OR vendor_name = '' THEN 0 ELSE 1 END
             + CASE WHEN invoice_number IS NULL OR invoice_number = '' THEN 0 ELSE 1 END
             + CASE WHEN invoice_date IS NULL THEN 0 ELSE 1 END
             + CASE WHEN total IS NULL THEN 0 ELSE 1 END
             + CASE WHEN po_number IS NULL OR po_number = '' THEN 0 ELSE 1 END) AS DOUBLE) / 5.0
           AS extraction_confidence
  FROM inv0)"""

ENRICHED = f"""
reg AS (
  SELECT lower(name) AS vkey, min(vendor_id) AS matched_vendor_id, arg_min(name, vendor_id) AS registry_name,
         arg_min(approved, vendor_id) AS registry_approved
  FROM vendors GROUP BY lower(name)),
dup AS (
  SELECT invoice_id,
         last_value(good_ts IGNORE NULLS) OVER w AS prev_ts, last_value(good_id IGNORE NULLS) OVER w AS prev_id,
         first_value(good_id IGNORE NULLS) OVER wd AS day_first_id
  FROM (SELECT *, CASE WHEN currency IN ('USD','CAD','EUR','GBP','AUD','JPY','CHF') THEN created_at END AS good_ts,
               CASE WHEN currency IN ('USD','CAD','EUR','GBP','AUD','JPY','CHF') THEN invoice_id END AS good_id FROM inv)
  WHERE invoice_number <> '' AND vendor_name <> ''
  WINDOW w AS (PARTITION BY invoice_number, lower(vendor_name) ORDER BY created_at, invoice_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         wd AS (PARTITION BY invoice_number, lower(vendor_name), CAST(created_at AS DATE)
                ORDER BY created_at, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (
  SELECT i.*, r.matched_vendor_id, r.registry_name,
         r.matched_vendor_id IS NOT NULL AS vendor_found,
         coalesce(r.registry_approved, false) AS vendor_approved,
         p.amount AS po_amount, p.amount IS NOT NULL AS po_found,
         coalesce(d.day_first_id IS NOT NULL
                  OR d.prev_ts >= i.created_at - INTERVAL 90 DAY, false) AS is_duplicate,
         CASE WHEN d.day_first_id IS NOT NULL THEN d.day_first_id
              WHEN d.prev_ts >= i.created_at - INTERVAL 90 DAY THEN d.prev_id END AS duplicate_of
  FROM inv i
  LEFT JOIN reg r ON r.vkey = lower(i.vendor_name) AND i.vendor_name <> ''
  LEFT JOIN pos p ON p.po_number = i.po_number AND i.po_number <> ''
  LEFT JOIN dup d ON d.invoice_id = i.invoice_id)"""

CHECKS = f"""
c AS (
  SELECT e.*,
    CASE WHEN vendor_name IS NULL OR vendor_name = '' THEN 'fail' WHEN NOT vendor_found THEN 'fail'
         WHEN NOT vendor_approved THEN 'fail' ELSE 'pass' END AS vendor_status,
    CASE WHEN vendor_name IS NULL OR vendor_name = '' THEN 0.00 WHEN NOT vendor_found THEN 0.90
         WHEN NOT vendor_approved THEN 0.90 ELSE 1.00 END AS vendor_conf,
    CASE WHEN po_number IS NULL OR po_number = '' THEN 'warning' WHEN NOT po_found THEN 'fail'
         WHEN total IS NULL THEN 'warning'
         WHEN po_amount <> 0 AND abs(total - po_amount) > po_amount * 0.10 THEN 'fail' ELSE 'pass' END AS po_status,
    CASE WHEN po_number IS NULL OR po_number = '' THEN 0.50 WHEN NOT po_found THEN 0.90
         WHEN total IS NULL THEN 0.60
         WHEN po_amount <> 0 AND abs(total - po_amount) > po_amount * 0.10 THEN 0.80 ELSE 1.00 END AS po_conf,
    CASE WHEN invoice_date IS NULL THEN 'warning' WHEN invoice_date > {AS_OF} + 7 THEN 'fail' ELSE 'pass' END AS date_status,
    CASE WHEN invoice_date IS NULL THEN 0.50 WHEN invoice_date > {AS_OF} + 7 THEN 0.95 ELSE 1.00 END AS date_conf,
    CASE WHEN subtotal IS NULL OR tax IS NULL OR total IS NULL THEN 'skipped'
         WHEN abs(subtotal + tax - total) > 1.00 THEN 'fail' ELSE 'pass' END AS arith_status,
    CASE WHEN subtotal IS NULL OR tax IS NULL OR total IS NULL THEN 0.50
         WHEN abs(subtotal + tax - total) > 1.00 THEN 0.90 ELSE 1.00 END AS arith_conf,
    CASE WHEN currency IN ('USD','CAD','EUR','GBP','AUD','JPY','CHF') THEN 'pass' ELSE 'fail' END AS currency_status,
    CASE WHEN currency IN ('USD','CAD','EUR','GBP','AUD','JPY','CHF') THEN 1.00 ELSE 0.90 END AS currency_conf,
    (po_number <> '' AND total IS NOT NULL AND total <> 0 AND po_found AND po_amount <> 0) AS po_ok,
    (po_number <> '' AND total IS NOT NULL AND po_found AND po_amount <> 0) AS outlier_ok
  FROM e),
v AS (
  SELECT c.*,
    CASE WHEN 'fail' IN (vendor_status, po_status, date_status, arith_status, currency_status) THEN 'fail'
         WHEN 'warning' IN (vendor_status, po_status, date_status, arith_status, currency_status) THEN 'warning'
         ELSE 'pass' END AS validation_status,
    CAST(vendor_conf + po_conf + date_conf + arith_conf + currency_conf AS DECIMAL(8,2)) AS conf_sum,
    CAST(CAST((vendor_conf + po_conf + date_conf + arith_conf + currency_conf) * 200 AS BIGINT) AS DOUBLE) / 1000.0
      AS validation_confidence,
    CASE WHEN po_ok THEN {VARIANCE} END AS po_variance_pct,
    coalesce(po_ok AND abs(total - po_amount) <= po_amount * 0.10, false) AS po_match,
    CASE WHEN is_duplicate AND invoice_number <> '' AND vendor_name <> '' THEN 'critical' END AS sev_dup,
    CASE WHEN outlier_ok AND abs(total - po_amount) > po_amount * 0.10 THEN
      CASE WHEN abs(total - po_amount) > po_amount * 0.50 THEN 'critical'
           WHEN abs(total - po_amount) > po_amount * 0.30 THEN 'high'
           WHEN abs(total - po_amount) > po_amount * 0.15 THEN 'medium' ELSE 'low' END END AS sev_outlier,
    CASE WHEN vendor_name IS NULL OR vendor_name = '' THEN 'missing_vendor'
         WHEN NOT vendor_approved THEN 'unknown_vendor' END AS vendor_anomaly,
    CASE WHEN invoice_date > {AS_OF} + 7 THEN 'future_dated_invoice'
         WHEN invoice_date < {AS_OF} - 180 THEN 'stale_invoice' END AS date_anomaly_type,
    (total >= 1000 AND total % 1 = 0) AS is_round,
    (CASE WHEN invoice_number IS NULL OR invoice_number = '' THEN 1 ELSE 0 END
     + CASE WHEN vendor_name IS NULL OR vendor_name = '' THEN 1 ELSE 0 END
     + CASE WHEN total IS NULL THEN 1 ELSE 0 END
     + CASE WHEN invoice_date IS NULL THEN 1 ELSE 0 END) AS n_missing,
    concat_ws(', ',
      CASE WHEN invoice_number IS NULL OR invoice_number = '' THEN 'invoice_number' END,
      CASE WHEN vendor_name IS NULL OR vendor_name = '' THEN 'vendor_name' END,
      CASE WHEN total IS NULL THEN 'total' END,
      CASE WHEN invoice_date IS NULL THEN 'invoice_date' END) AS missing_list
  FROM c),
a AS (
  SELECT v.*,
    CASE WHEN n_missing >= 2 THEN 'high' WHEN n_missing = 1 THEN 'medium' END AS sev_missing,
    CASE WHEN vendor_anomaly IS NOT NULL THEN 'high' END AS sev_vendor,
    CASE WHEN date_anomaly_type = 'future_dated_invoice' THEN 'high'
         WHEN date_anomaly_type = 'stale_invoice' THEN 'medium' END AS sev_date,
    CASE WHEN is_round THEN 'low' END AS sev_round
  FROM v),
r AS (
  SELECT a.*,
    least(CAST(
      (CASE sev_dup WHEN 'critical' THEN 0.40 ELSE 0 END)
      + (CASE sev_outlier WHEN 'critical' THEN 0.40 WHEN 'high' THEN 0.25 WHEN 'medium' THEN 0.10 WHEN 'low' THEN 0.05 ELSE 0 END)
      + (CASE WHEN sev_vendor IS NOT NULL THEN 0.25 ELSE 0 END)
      + (CASE sev_date WHEN 'high' THEN 0.25 WHEN 'medium' THEN 0.10 ELSE 0 END)
      + (CASE WHEN sev_round IS NOT NULL THEN 0.05 ELSE 0 END)
      + (CASE sev_missing WHEN 'high' THEN 0.25 WHEN 'medium' THEN 0.10 ELSE 0 END) AS DECIMAL(6,2)), 1.00) AS risk_dec,
    concat_ws(',',
      CASE WHEN sev_dup IS NOT NULL THEN 'duplicate_invoice' END,
      CASE WHEN sev_outlier IS NOT NULL THEN 'amount_outlier' END,
      vendor_anomaly, date_anomaly_type,
      CASE WHEN is_round THEN 'round_number_amount' END,
      CASE WHEN n_missing > 0 THEN 'missing_critical_fields' END) AS anomaly_types
  FROM a),
s0 AS (
  SELECT r.*,
    CAST(CAST(risk_dec * 1000 AS BIGINT) AS DOUBLE) / 1000.0 AS risk_score,
    CAST(CAST((1.000 - risk_dec / 2) * 1000 AS BIGINT) AS DOUBLE) / 1000.0 AS anomaly_confidence,
    (ocr_used AND ocr_confidence < 0.85) AS g_ocr,
    (sev_dup IS NOT NULL) AS g_dup,
    (extraction_confidence < 0.7) AS g_conf_extract,
    (vendor_anomaly IS NOT NULL) AS g_vendor,
    (outlier_ok AND abs(total - po_amount) > po_amount * 0.10) AS g_variance,
    (conf_sum < 3.50) AS g_conf_validate,
    CASE WHEN total >= 100000 THEN 'l3_vp_cfo' WHEN total >= 25000 THEN 'l2_controller'
         WHEN total >= 5000 THEN 'l1_manager' END AS materiality_level,
    (risk_dec > 0.60) AS g_conf_anomaly
  FROM r),
gd AS (
  SELECT invoice_id, 1 AS ord, 'ocr_confidence_gate' AS rule_triggered, 'escalate' AS decision, 'human_review' AS escalation_level,
         'document_intake_specialist' AS actor, 0.85 AS threshold_value, ocr_confidence AS actual_value FROM s0 WHERE g_ocr
  UNION ALL SELECT invoice_id, 2, 'duplicate_detection', 'block', 'human_review', 'anomaly_detection_specialist', NULL, NULL FROM s0 WHERE g_dup
  UNION ALL SELECT invoice_id, 3, 'agent_confidence_gate', 'escalate', 'human_review', 'data_extraction_analyst', 0.7, extraction_confidence FROM s0 WHERE g_conf_extract
  UNION ALL SELECT invoice_id, 4, 'unknown_vendor', 'escalate', 'human_review', 'validation_officer', NULL, NULL FROM s0 WHERE g_vendor
  UNION ALL SELECT invoice_id, 5, 'variance_threshold', 'flag', 'human_review', 'validation_officer', 0.1,
         CAST(abs(total - po_amount) AS DOUBLE) / CAST(po_amount AS DOUBLE) FROM s0 WHERE g_variance
  UNION ALL SELECT invoice_id, 6, 'agent_confidence_gate', 'escalate', 'human_review', 'validation_officer', 0.7, validation_confidence FROM s0 WHERE g_conf_validate
  UNION ALL SELECT invoice_id, 7, 'materiality_gate', 'escalate', materiality_level, 'reconciliation_manager',
         CASE materiality_level WHEN 'l3_vp_cfo' THEN 100000.0 WHEN 'l2_controller' THEN 25000.0 ELSE 5000.0 END,
         CAST(total AS DOUBLE) FROM s0 WHERE materiality_level IS NOT NULL
  UNION ALL SELECT invoice_id, 8, 'agent_confidence_gate', 'escalate', 'human_review', 'anomaly_detection_specialist', 0.7, anomaly_confidence FROM s0 WHERE g_conf_anomaly),
decisions AS (
  SELECT invoice_id, CAST(row_number() OVER (PARTITION BY invoice_id ORDER BY ord) AS INTEGER) AS seq, ord,
         rule_triggered, decision, escalation_level, actor,
         CAST(threshold_value AS DOUBLE) AS threshold_value, CAST(actual_value AS DOUBLE) AS actual_value
  FROM gd),
dsum AS (
  SELECT invoice_id, count(*) AS n_decisions, bool_or(decision = 'block') AS has_block,
         bool_or(decision IN ('escalate','flag')) AS has_esc, arg_min(escalation_level, ord) AS first_level
  FROM decisions GROUP BY invoice_id),
s AS (
  SELECT s0.*, CAST(coalesce(dsum.n_decisions, 0) AS INTEGER) AS n_decisions,
    CASE WHEN coalesce(dsum.n_decisions, 0) = 0 THEN 'validated' WHEN has_block THEN 'rejected'
         WHEN has_esc THEN 'on_hold' ELSE 'validated' END AS gate_status,
    coalesce(first_level, 'none') AS escalation_level
  FROM s0 LEFT JOIN dsum USING (invoice_id)),
scored AS (
  SELECT s.*, CASE WHEN validation_status = 'fail' AND risk_dec > 0.25 AND gate_status = 'validated'
                   THEN 'flagged' ELSE gate_status END AS status
  FROM s)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts)


SCORED = with_ctes(DOMAIN, ENRICHED, CHECKS)
