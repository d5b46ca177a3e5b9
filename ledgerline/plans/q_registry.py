"""Registry, table-maintenance and lookup queries."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import functions as F

from ..operators import ledger
from ..operators import registry as G
from ..operators import report
from ..operators.enrich import match_pos, match_vendors
from ..operators.review import review_status as _review_status
from ..policy import CURRENCIES, DEFAULT_POLICY
from ..session import ensure_checkpoint_dir, shared_table
from ..sources import domain
from .catalog import query
from .oracle_base import CHECKS, DOMAIN, ENRICHED, with_ctes
from .q_review import HD, saved
from .q_scoring import ALLOWED, STORED, scored, stored
from .scoring import score

BASE = with_ctes(DOMAIN, ENRICHED)


@query("vendor_registry", f"""{BASE} SELECT vendor_id, name, category, approved, payment_terms_days FROM vendors
ORDER BY name""")
def vendor_registry(spark, sf):
    return domain.vendors(spark, sf).orderBy("name")


@query("po_ledger", f"""{BASE} SELECT po_number, vendor_id, amount, issued_date, status FROM pos
ORDER BY issued_date DESC""")
def po_ledger(spark, sf):
    return (domain.purchase_orders(spark, sf).select("po_number", "vendor_id", "amount", "issued_date", "status")
            .orderBy(F.col("issued_date").desc()))


@query("seed_missing_vendors", f"""{BASE},
existing AS (SELECT * FROM vendors WHERE lower(name) IN (SELECT lower(vendor_name) FROM inv WHERE vendor_name <> ''))
SELECT vendor_id, name, false AS inserted FROM existing
UNION ALL SELECT vendor_id, name, true FROM vendors WHERE vendor_id NOT IN (SELECT vendor_id FROM existing)""")
def seed_missing_vendors(spark, sf):
    """Existing registry = vendors already named on invoices; the seed is the
    full supplier registry."""
    reg = domain.vendors(spark, sf)
    used = domain.invoices(spark, sf).select(F.lower("vendor_name").alias("_k")).where(F.col("_k") != "")
    existing = reg.join(used, F.lower(reg.name) == used._k, "left_semi")
    return G.seed_missing(existing, reg, "vendor_id").select("vendor_id", "name", "inserted")


@query("invoice_upsert", f"""{STORED},
old AS (SELECT invoice_id, 'processing' AS status, invoice_id || '.pdf' AS source_filename,
               'invoice' AS document_type, created_at FROM inv),
new AS (SELECT invoice_id, status FROM stored WHERE status IN ('flagged','on_hold','rejected'))
SELECT o.invoice_id, coalesce(n.status, o.status) AS status, o.source_filename, o.document_type, o.created_at,
       n.invoice_id IS NOT NULL AS updated, false AS inserted
FROM old o LEFT JOIN new n ON n.invoice_id = o.invoice_id""")
def invoice_upsert(spark, sf):
    """Old rows: every invoice as first stored ('processing'); new rows: the
    re-processed held/rejected ones, carrying a later created_at that the
    upsert must not take over."""
    old = domain.invoices(spark, sf).select(
        "invoice_id", F.lit("processing").alias("status"),
        F.concat(F.col("invoice_id"), F.lit(".pdf")).alias("source_filename"),
        F.lit("invoice").alias("document_type"), "created_at")
    later = F.lit(_dt.datetime.combine(DEFAULT_POLICY.as_of, _dt.time())).cast("timestamp_ntz")
    new = (stored(spark, sf).where(F.col("status").isin("flagged", "on_hold", "rejected"))
           .select("invoice_id", "status", F.lit(None).cast("string").alias("source_filename"),
                   F.lit("unknown").alias("document_type"), later.alias("created_at")))
    return G.upsert(old, new, "invoice_id")


@query("apply_status_changes", f"""{HD},
rs AS (SELECT invoice_id, CASE arg_max(decision, (timestamp, seq)) WHEN 'approve' THEN 'approved'
         WHEN 'adjust_and_approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'on_hold' END AS new_status
       FROM saved GROUP BY invoice_id)
SELECT s.invoice_id, coalesce(rs.new_status, s.status) AS status FROM stored s LEFT JOIN rs USING (invoice_id)""")
def apply_status_changes(spark, sf):
    changes = _review_status(saved(spark, sf)).select("invoice_id", "status")
    ts = _dt.datetime.combine(DEFAULT_POLICY.as_of, _dt.time())
    return G.apply_status_changes(stored(spark, sf), changes, ts).select("invoice_id", "status")


@query("ledger_merge", f"""{HD},
rs AS (SELECT invoice_id, CASE arg_max(decision, (timestamp, seq)) WHEN 'approve' THEN 'approved'
         WHEN 'adjust_and_approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'on_hold' END AS new_status
       FROM saved GROUP BY invoice_id)
SELECT s.invoice_id, coalesce(rs.new_status, s.status) AS status, s.created_at,
  CASE WHEN s.status = 'rejected' THEN 'unknown' ELSE 'invoice' END AS document_type
FROM stored s LEFT JOIN rs USING (invoice_id)""")
def ledger_merge(spark, sf):
    """A4 then A6 on a stored ledger: created from the invoices that are not
    rejected, first as 'processing'; a merge brings every held, flagged and
    rejected one (the rejected are inserted), another the approved ones; the
    last sets the statuses that reviews gave."""
    rows = shared_table(stored(spark, sf).select("invoice_id", "status", "created_at"), "ledger-input")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerline/ledger-{uuid.uuid4().hex}"
    kind = lambda df, t: df.withColumn("document_type", F.lit(t))
    approved = F.col("status") == "approved"
    ledger.create_ledger(kind(rows.where("status <> 'rejected'").withColumn("status", F.lit("processing")), "invoice"),
                         path, "invoice_id", buckets=16)
    ledger.merge_ledger(kind(rows.where(~approved), "unknown"), path, "invoice_id", "held")
    ledger.merge_ledger(kind(rows.where(approved), "unknown"), path, "invoice_id", "approved")
    changes = _review_status(saved(spark, sf)).select("invoice_id", "status")
    known = shared_table(changes.join(rows, "invoice_id", "left_semi"), "ledger-changes")  # read twice
    ledger.merge_ledger(known, path, "invoice_id", "reviews")
    return ledger.read_ledger(spark, path)


LINES_SQL = f"""{BASE},
lines AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_no, p_name AS description,
         CAST(l_quantity AS DECIMAL(12,2)) AS quantity,
         CASE WHEN CAST(l_quantity AS BIGINT) > 0 THEN CAST(
           ((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
            // (2 * CAST(l_quantity AS BIGINT))) AS DECIMAL(18,0)) / 100 END AS unit_price0,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS total
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
lines2 AS (SELECT * EXCLUDE (unit_price0), CAST(unit_price0 AS DECIMAL(18,2)) AS unit_price FROM lines)"""


@query("line_items_json_roundtrip", f"""{LINES_SQL} SELECT order_key, count(*) AS n_items,
  CAST(sum(total) AS DECIMAL(38,2)) AS items_total FROM lines2 GROUP BY order_key""")
def line_items_json_roundtrip(spark, sf):
    rt = G.json_roundtrip(G.line_items(domain.invoice_lines(spark, sf)))
    back = F.col("line_items_back")
    return rt.select("order_key", F.size(back).cast("bigint").alias("n_items"),
                     F.aggregate(back, F.lit(0).cast("decimal(38,2)"),
                                 lambda acc, x: (acc + x["total"]).cast("decimal(38,2)")).alias("items_total"))


@query("vendor_by_id", f"""{BASE} SELECT p.po_number, p.vendor_id, v.name AS vendor_name, v.approved
FROM pos p LEFT JOIN vendors v ON v.vendor_id = p.vendor_id""")
def vendor_by_id(spark, sf):
    pos = domain.purchase_orders(spark, sf).select("po_number", "vendor_id")
    v = domain.vendors(spark, sf).select(F.col("vendor_id").alias("_vid"), F.col("name").alias("vendor_name"),
                                         "approved")
    return pos.join(v, pos.vendor_id == v._vid, "left").select("po_number", "vendor_id", "vendor_name", "approved")


@query("vendor_name_match", f"{BASE} SELECT invoice_id, matched_vendor_id, registry_name FROM e")
def vendor_name_match(spark, sf):
    m = match_vendors(domain.invoices(spark, sf), domain.vendors(spark, sf))
    return m.select("invoice_id", "matched_vendor_id", "registry_name")


@query("vendor_approved", f"{BASE} SELECT invoice_id, vendor_approved FROM e")
def vendor_approved(spark, sf):
    return match_vendors(domain.invoices(spark, sf), domain.vendors(spark, sf)).select("invoice_id",
                                                                                         "vendor_approved")


@query("po_match_join", f"{BASE} SELECT invoice_id, po_found, po_amount FROM e")
def po_match_join(spark, sf):
    return match_pos(domain.invoices(spark, sf), domain.po_amounts(spark, sf)).select(
        "invoice_id", "po_found", "po_amount")


@query("invoice_by_id", f"""{HD} SELECT h.decision_id, h.invoice_id, s.invoice_id IS NOT NULL AS found,
  s.status, s.total FROM hd h LEFT JOIN stored s ON s.invoice_id = h.invoice_id""")
def invoice_by_id(spark, sf):
    """Point lookups for every requested id (the review requests) as one join."""
    req = domain.human_decisions(spark, sf).select("decision_id", "invoice_id")
    st = stored(spark, sf).select(F.col("invoice_id").alias("_iid"), "status", "total")
    j = req.join(st, req.invoice_id == st._iid, "left")
    return j.select("decision_id", "invoice_id", F.col("_iid").isNotNull().alias("found"), "status", "total")


@query("invoice_page", f"""{STORED} SELECT invoice_id, created_at, status FROM stored WHERE status = 'on_hold'
ORDER BY created_at DESC, invoice_id LIMIT 50 OFFSET 50""")
def invoice_page(spark, sf):
    return G.page(stored(spark, sf), "on_hold", 50, 50).select("invoice_id", "created_at", "status")


@query("exceptions", f"""{STORED} SELECT invoice_id, status, created_at,
  CASE status WHEN 'flagged' THEN 0 WHEN 'on_hold' THEN 1 ELSE 2 END AS status_group
FROM stored WHERE status IN ('flagged','on_hold','rejected')""")
def exceptions(spark, sf):
    return G.exceptions(stored(spark, sf)).select("invoice_id", "status", "created_at", "status_group")


@query("constraint_violations", f"""{BASE} SELECT invoice_id, 'currency' AS violations FROM inv
WHERE currency NOT IN {ALLOWED}""")
def constraint_violations(spark, sf):
    v = G.invoice_violations(domain.invoices(spark, sf))
    return v.where(F.size("violations") > 0).select("invoice_id", F.array_join("violations", ",").alias("violations"))


@query("currency_normalised", f"""{BASE} SELECT invoice_id, currency_raw, currency,
  currency IN {ALLOWED} AS currency_valid FROM inv""")
def currency_normalised(spark, sf):
    inv = domain.invoices(spark, sf)
    up = F.upper(F.coalesce("currency", F.lit("USD")))
    return inv.select("invoice_id", F.col("currency").alias("currency_raw"), up.alias("currency"),
                      up.isin(*CURRENCIES).alias("currency_valid"))


@query("line_total_mismatch", f"""{LINES_SQL} SELECT order_key, line_no,
  CAST(quantity * unit_price AS DECIMAL(20,4)) AS expected_total, total FROM lines2
WHERE abs(CAST(quantity * unit_price AS DECIMAL(20,4)) - total) > 0.02""")
def line_total_mismatch(spark, sf):
    v = G.line_violations(domain.invoice_lines(spark, sf))
    return v.where("total_mismatch").select("order_key", "line_no", "expected_total", "total")


@query("batch_with_errors", f"""{STORED} SELECT invoice_id, status, anomaly_types AS anomaly_flags FROM stored
UNION ALL SELECT invoice_id, 'rejected', 'processing_error' FROM scored WHERE currency NOT IN {ALLOWED}""")
def batch_with_errors(spark, sf):
    items = report.batch_items(scored(spark, sf), ~G.no_violations())
    return items.select("invoice_id", "status", F.array_join("anomaly_flags", ",").alias("anomaly_flags"))


STORABLE = "currency IN ('USD','CAD','EUR','GBP','AUD','JPY','CHF')"
BAD_LINES = """
bad_orders AS (
  SELECT order_key, string_agg(rule, ',' ORDER BY rule) AS rules FROM (
    SELECT DISTINCT l_orderkey AS order_key, 'line.' || unnest(list_filter([
      CASE WHEN l_partkey % 41 = 0 OR l_partkey % 43 = 0 OR l_partkey % 47 = 0
                OR p_name IS NULL OR length(p_name) NOT BETWEEN 1 AND 500 THEN 'description' END,
      CASE WHEN l_partkey % 53 = 0 OR NOT l_quantity > 0 THEN 'quantity' END,
      CASE WHEN l_partkey % 59 = 0 THEN 'unit_price' END,
      CASE WHEN l_partkey % 61 = 0 OR l_extendedprice * (1 - l_discount) < 0 THEN 'total' END], lambda x: x IS NOT NULL)) AS rule
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
  GROUP BY order_key)"""
# as the scored invoices, but those with a bad line are not stored and are no earlier invoice of a pair
GOOD_ORDER = "order_key NOT IN (SELECT order_key FROM bad_orders)"
SCORED_WITH_LINES = with_ctes(DOMAIN, BAD_LINES, ENRICHED.replace(
    f"CASE WHEN {STORABLE} THEN", f"CASE WHEN {STORABLE} AND {GOOD_ORDER} THEN"), CHECKS)


def invoices_with_damaged_lines(spark, sf):
    return G.with_line_violations(domain.invoices(spark, sf), domain.damaged_lines(spark, sf))


@query("quarantined_invoices", f"""{with_ctes(DOMAIN, BAD_LINES)}
SELECT invoice_id, concat_ws(',', CASE WHEN NOT {STORABLE} THEN 'currency' END, rules) AS reasons
FROM inv LEFT JOIN bad_orders USING (order_key) WHERE rules IS NOT NULL OR NOT {STORABLE}""")
def quarantined_invoices(spark, sf):
    _, bad = G.quarantine(G.invoice_violations(invoices_with_damaged_lines(spark, sf)))
    return bad.select("invoice_id", "reasons")


@query("batch_with_line_errors", f"""{SCORED_WITH_LINES}
SELECT invoice_id, CASE WHEN {STORABLE} AND {GOOD_ORDER} THEN status ELSE 'rejected' END AS status,
  CASE WHEN {STORABLE} AND {GOOD_ORDER} THEN anomaly_types ELSE 'processing_error' END AS anomaly_flags FROM scored""")
def batch_with_line_errors(spark, sf):
    """An invoice whose record has a bad line is an error item, and no
    earlier invoice for the duplicate test."""
    # stored: the duplicate history reads them more than once
    inv = shared_table(invoices_with_damaged_lines(spark, sf), "checked-invoices")
    scored_rows = score(inv, domain.vendors(spark, sf), domain.po_amounts(spark, sf))
    return report.batch_items(scored_rows, ~G.no_violations()).select(
        "invoice_id", "status", F.array_join("anomaly_flags", ",").alias("anomaly_flags"))
