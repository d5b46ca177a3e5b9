"""Queries of the human review loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review as R
from ..operators.prefix import ratio_half_even_sql
from ..policy import CURRENCIES
from ..sources import domain
from .catalog import query
from .q_scoring import ALLOWED, STORED, scored, stored

HD = f"""{STORED},
first_inv AS (SELECT order_key, min(invoice_id) AS inv FROM inv WHERE currency IN {ALLOWED} GROUP BY order_key),
hd AS (
  SELECT CAST(event_id AS VARCHAR) AS decision_id,
         coalesce(f.inv, 'ORPHAN-' || CAST(event_id AS VARCHAR)) AS invoice_id,
         CAST(user_id AS VARCHAR) AS reviewer_id, 'Reviewer ' || CAST(user_id AS VARCHAR) AS reviewer_name,
         CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'signup' THEN 'adjust_and_approve'
              WHEN 'error' THEN 'reject' WHEN 'click' THEN 'escalate_further' WHEN 'view' THEN 'maybe' END AS decision,
         CASE event_id % 9 WHEN 0 THEN 'amount_within_variance' WHEN 1 THEN 'vendor_confirmed_correction'
              WHEN 2 THEN 'po_mismatch_resolved' WHEN 3 THEN 'duplicate_confirmed_void'
              WHEN 4 THEN 'anomaly_is_legitimate' WHEN 5 THEN 'requires_senior_review'
              WHEN 6 THEN 'policy_exception_granted' WHEN 7 THEN 'other' ELSE 'bogus' END AS rationale_category,
         CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 WHEN 0 THEN 'ocr_confidence_gate'
              WHEN 1 THEN 'duplicate_detection' WHEN 2 THEN 'agent_confidence_gate' WHEN 3 THEN 'unknown_vendor'
              WHEN 4 THEN 'variance_threshold' ELSE 'materiality_gate' END AS original_flag,
         value AS resolution_time_hours, ts AS timestamp, event_id AS seq
  FROM events LEFT JOIN first_inv f ON f.order_key = events.event_id),
saved AS (
  SELECT * FROM hd WHERE invoice_id NOT LIKE 'ORPHAN-%'
    AND decision IN ('approve','adjust_and_approve','reject','escalate_further')
    AND rationale_category IN ('amount_within_variance','vendor_confirmed_correction','po_mismatch_resolved',
        'duplicate_confirmed_void','anomaly_is_legitimate','requires_senior_review','policy_exception_granted','other')),
cs0 AS (
  SELECT *, count(*) OVER (PARTITION BY original_flag ORDER BY timestamp, seq
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_n,
            count(*) OVER (PARTITION BY original_flag, decision ORDER BY timestamp, seq
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_same
  FROM saved),
cs AS (
  SELECT *, CASE WHEN prior_n < 3 THEN -1.0 ELSE {ratio_half_even_sql('prior_same', 'prior_n', 3)} END
    AS consistency_score FROM cs0)"""


def reviews(spark, sf):
    return domain.human_decisions(spark, sf)


def saved(spark, sf):
    inv = domain.invoices(spark, sf).where(F.upper("currency").isin(*CURRENCIES))
    return R.saved_reviews(reviews(spark, sf), inv)


def scores(spark, sf):
    return R.consistency_scores(saved(spark, sf))


@query("pending_reviews", f"""{HD} SELECT d.invoice_id, d.seq, d.rule_triggered, d.escalation_level
FROM decisions d JOIN stored s ON s.invoice_id = d.invoice_id
WHERE s.status IN ('flagged','on_hold') AND d.escalation_level <> 'none'
  AND d.invoice_id NOT IN (SELECT invoice_id FROM saved)""")
def pending_reviews(spark, sf):
    return R.pending_reviews(stored(spark, sf), saved(spark, sf)).select(
        "invoice_id", "seq", "rule_triggered", "escalation_level")


@query("pending_reviews_simple", f"""{STORED} SELECT invoice_id, status FROM stored
WHERE status IN ('pending_review','on_hold','escalated')""")
def pending_reviews_simple(spark, sf):
    return stored(spark, sf).where(F.col("status").isin("pending_review", "on_hold", "escalated")).select(
        "invoice_id", "status")


@query("latest_escalation", f"""{HD},
last AS (SELECT invoice_id, arg_max(rule_triggered, seq) AS flag, arg_max(actor, seq) AS agent
         FROM decisions WHERE escalation_level <> 'none' GROUP BY invoice_id)
SELECT s.decision_id, s.invoice_id, coalesce(l.flag, 'unknown') AS original_flag,
       coalesce(l.agent, 'unknown') AS original_agent
FROM saved s LEFT JOIN last l ON l.invoice_id = s.invoice_id""")
def latest_escalation(spark, sf):
    last = R.latest_escalation(stored(spark, sf))
    s = saved(spark, sf).select("decision_id", "invoice_id")
    j = s.join(last.withColumnRenamed("invoice_id", "_iid"), s.invoice_id == F.col("_iid"), "left")
    return j.select("decision_id", "invoice_id",
                    F.coalesce("original_flag", F.lit("unknown")).alias("original_flag"),
                    F.coalesce("original_agent", F.lit("unknown")).alias("original_agent"))


@query("consistency_scores", f"""{HD} SELECT decision_id, original_flag, decision, prior_n, prior_same,
  consistency_score FROM cs""")
def consistency_scores(spark, sf):
    return scores(spark, sf).select("decision_id", "original_flag", "decision", "prior_n", "prior_same",
                                    "consistency_score")


@query("consistency_notes", f"""{HD} SELECT decision_id, consistency_score,
  CASE WHEN consistency_score < 0 THEN 'Not enough historical data'
       WHEN consistency_score > 0.6 THEN 'Aligned with historical pattern'
       ELSE 'Deviates from historical pattern - flagged for review' END AS consistency_note FROM cs""")
def consistency_notes(spark, sf):
    s = scores(spark, sf)
    return s.select("decision_id", "consistency_score",
                    R.consistency_note(F.col("consistency_score")).alias("consistency_note"))


@query("invalid_reviews", f"""{HD} SELECT decision_id,
  CASE WHEN invoice_id NOT IN (SELECT invoice_id FROM stored) THEN 'invoice_not_found'
       WHEN decision NOT IN ('approve','adjust_and_approve','reject','escalate_further') THEN 'invalid_decision'
       ELSE 'invalid_rationale' END AS problem
FROM hd WHERE invoice_id NOT IN (SELECT invoice_id FROM stored)
  OR decision NOT IN ('approve','adjust_and_approve','reject','escalate_further')
  OR rationale_category NOT IN ('amount_within_variance','vendor_confirmed_correction','po_mismatch_resolved',
     'duplicate_confirmed_void','anomaly_is_legitimate','requires_senior_review','policy_exception_granted','other')""")
def invalid_reviews(spark, sf):
    inv = domain.invoices(spark, sf).where(F.upper("currency").isin(*CURRENCIES))
    return (R.review_problem(reviews(spark, sf), inv.select("invoice_id"))
            .where(F.col("problem").isNotNull()).select("decision_id", "problem"))


@query("review_status", f"""{HD} SELECT invoice_id, arg_max(decision, (timestamp, seq)) AS decision,
  CASE arg_max(decision, (timestamp, seq)) WHEN 'approve' THEN 'approved' WHEN 'adjust_and_approve' THEN 'approved'
       WHEN 'reject' THEN 'rejected' WHEN 'escalate_further' THEN 'on_hold' END AS status
FROM saved GROUP BY invoice_id""")
def review_status(spark, sf):
    return R.review_status(saved(spark, sf))


def _hours_sql(n: str) -> str:
    return ratio_half_even_sql("sum(CAST(round(resolution_time_hours * 100) AS BIGINT))", f"{n} * 100", 2)


COUNTS_SQL = """count(*) FILTER (WHERE decision = 'approve') AS approve_count,
  count(*) FILTER (WHERE decision = 'reject') AS reject_count,
  count(*) FILTER (WHERE decision = 'adjust_and_approve') AS adjust_count,
  count(*) FILTER (WHERE decision = 'escalate_further') AS escalate_count"""


@query("decision_patterns", f"""{HD} SELECT original_flag AS flag_type, count(*) AS total_decisions, {COUNTS_SQL},
  {_hours_sql('count(*)')} AS avg_resolution_hours FROM saved GROUP BY original_flag""")
def decision_patterns(spark, sf):
    return R.decision_patterns(saved(spark, sf))


REVIEWERS_SQL = f"""SELECT reviewer_id, count(*) AS total_reviews, {COUNTS_SQL},
  CASE WHEN count(*) FILTER (WHERE consistency_score >= 0) = 0 THEN -1.0 ELSE
    {ratio_half_even_sql('sum(CAST(round(consistency_score * 1000) AS BIGINT)) FILTER (WHERE consistency_score >= 0)',
                         'count(*) FILTER (WHERE consistency_score >= 0) * 1000', 3)} END AS avg_consistency,
  {_hours_sql('count(*)')} AS avg_resolution_hours FROM cs"""


@query("reviewer_consistency", f"{HD} {REVIEWERS_SQL} GROUP BY reviewer_id")
def reviewer_consistency(spark, sf):
    return R.reviewer_consistency(scores(spark, sf))


@query("review_history", f"""{HD} SELECT decision_id, invoice_id, reviewer_id, decision, timestamp FROM saved
ORDER BY timestamp DESC, seq DESC LIMIT 50""")
def review_history(spark, sf):
    return R.newest(saved(spark, sf), 50).select("decision_id", "invoice_id", "reviewer_id", "decision", "timestamp")


def _history_sql(who: str, limit: str = "") -> str:
    return f"""{HD}, h AS (SELECT decision_id, invoice_id, reviewer_id,
  row_number() OVER (PARTITION BY {who} ORDER BY timestamp DESC, seq DESC) AS position FROM saved)
SELECT * FROM h {limit}"""


@query("review_history_by_invoice", _history_sql("invoice_id"))
def review_history_by_invoice(spark, sf):
    return R.history_by(saved(spark, sf), "invoice_id").select(
        "decision_id", "invoice_id", "reviewer_id", F.col("position").cast("bigint").alias("position"))


@query("review_history_by_reviewer", _history_sql("reviewer_id", "WHERE position <= 50"))
def review_history_by_reviewer(spark, sf):
    return R.history_by(saved(spark, sf), "reviewer_id", 50).select(
        "decision_id", "invoice_id", "reviewer_id", F.col("position").cast("bigint").alias("position"))


@query("consistency_overview", f"""{HD}
SELECT 'flag' AS part, original_flag AS name, count(*) AS total, {COUNTS_SQL},
  {_hours_sql('count(*)')} AS avg_resolution_hours, CAST(NULL AS DOUBLE) AS avg_consistency
FROM saved GROUP BY original_flag
UNION ALL BY NAME SELECT 'reviewer' AS part, * RENAME (reviewer_id AS name, total_reviews AS total)
FROM ({REVIEWERS_SQL} GROUP BY reviewer_id)""")
def consistency_overview(spark, sf):
    return R.overview(saved(spark, sf), scores(spark, sf))


REQUESTS_SQL = f"""{HD}, req AS (SELECT h.decision_id AS request_id, h.invoice_id, h.decision AS action,
  s.status AS prior_status, h.reviewer_id,
  CASE WHEN s.status IS NULL THEN 'not_found'
       WHEN h.decision = 'approve' AND s.status NOT IN ('pending','processing','validated','flagged','on_hold') THEN 'conflict'
       WHEN h.decision = 'reject' AND s.status = 'approved' THEN 'conflict' ELSE 'accepted' END AS outcome
FROM hd h LEFT JOIN stored s ON s.invoice_id = h.invoice_id WHERE h.decision IN ('approve','reject')),
req2 AS (SELECT *, CASE WHEN outcome = 'accepted' THEN CASE action WHEN 'approve' THEN 'approved' ELSE 'rejected' END END
  AS new_status FROM req)"""


@query("approval_requests", f"""{REQUESTS_SQL} SELECT request_id, invoice_id, action, prior_status, outcome, new_status
FROM req2""")
def approval_requests(spark, sf):
    return R.approval_requests(reviews(spark, sf), stored(spark, sf)).select(
        "request_id", "invoice_id", "action", "prior_status", "outcome", "new_status")


@query("approval_rows", f"""{REQUESTS_SQL}
SELECT md5(request_id || '|invoice.status_change') AS entry_id, invoice_id, 'invoice.status_change' AS event_type,
  'human:' || reviewer_id AS actor, '{{"status":"' || prior_status || '"}}' AS before_state,
  '{{"status":"' || new_status || '"}}' AS after_state FROM req2 WHERE outcome = 'accepted'
UNION ALL SELECT md5(request_id || '|human.' || action), invoice_id, 'human.' || action, 'human:' || reviewer_id, NULL, NULL
FROM req2 WHERE outcome = 'accepted'""")
def approval_rows(spark, sf):
    return R.approval_rows(R.approval_requests(reviews(spark, sf), stored(spark, sf)))


@query("review_audit_rows", f"""{HD} SELECT md5(decision_id || '|human_review') AS entry_id, invoice_id,
  'human_review' AS event_type, 'human:' || reviewer_id AS actor, 'escalated' AS before_state,
  decision AS after_state FROM cs""")
def review_audit_rows(spark, sf):
    return R.review_audit_rows(scores(spark, sf)).select("entry_id", "invoice_id", "event_type", "actor",
                                                         "before_state", "after_state")
