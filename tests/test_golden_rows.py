"""Single invoices with results worked out by hand (FIXTURES.md, part 1), and
the strict or inclusive side of each threshold."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from ledgerline.plans.scoring import score
from ledgerline.policy import DEFAULT_POLICY

DAY = dt.date(2024, 3, 1)
POLICY = DEFAULT_POLICY.with_(as_of=DAY)
SCHEMA = ("invoice_id string, vendor_name string, invoice_number string, po_number string, invoice_date date, "
          "currency string, subtotal decimal(18,2), tax decimal(18,2), total decimal(18,2), "
          "extraction_confidence double, ocr_used boolean, ocr_confidence double, created_at timestamp_ntz")
VENDORS = [("V1", "Acme Cloud Services", True), ("V2", "NexGen Software", True)]
ORDERS = [("PO-2024-001", Decimal("15000.00")), ("PO-2024-013", Decimal("45000.00")), ("PO-100", Decimal("100.00")),
          ("PO-900", Decimal("900.00"))]


def invoice(key, vendor="Acme Cloud Services", number=None, po="PO-900", subtotal=None, tax=None, total="900.00",
            extraction=0.95, used=False, ocr=1.0, date=DAY, days=0):
    money = [None if v is None else Decimal(v) for v in (subtotal, tax, total)]
    return (key, vendor, number or key, po, date, "USD", *money, extraction, used, ocr,
            dt.datetime(2024, 3, 1) + dt.timedelta(days=days))


def run(spark, rows, duplicates=False):
    scored = score(spark.createDataFrame(rows, SCHEMA),
                   spark.createDataFrame(VENDORS, "vendor_id string, name string, approved boolean"),
                   spark.createDataFrame(ORDERS, "po_number string, amount decimal(18,2)"), POLICY, duplicates=duplicates)
    return {r.invoice_id: r for r in scored.collect()}


def rules(row):
    return [d.rule_triggered for d in row.decisions]


def test_golden_invoices(spark):
    got = run(spark, [
        invoice("sample", number="INV-TEST-001", po="PO-2024-001", subtotal="13274.34", tax="1725.66", total="15000.00"),
        invoice("high", "NexGen Software", "NXG-TEST-001", "PO-2024-013", total="100000.00", extraction=0.90),
        invoice("unknown", "ShadowTech Solutions Inc.", "ST-001", None, total="9000.00", extraction=0.85)])
    want = {
        "sample": (["pass"] * 5, "pass", 1.0, 0.0, True, ["round_number_amount"], 0.05, 0.975,
                   ["materiality_gate"], "on_hold", "l1_manager"),
        "high": (["pass", "fail", "pass", "skipped", "pass"], "fail", 0.86, 1.2222, False,
                 ["amount_outlier", "round_number_amount"], 0.45, 0.775,
                 ["variance_threshold", "materiality_gate"], "on_hold", "human_review"),
        "unknown": (["fail", "warning", "pass", "skipped", "pass"], "fail", 0.78, None, False,
                    ["unknown_vendor", "round_number_amount"], 0.30, 0.85,
                    ["unknown_vendor", "materiality_gate"], "on_hold", "human_review")}
    for key, w in want.items():
        r = got[key]
        assert ([f.status for f in r.field_results], r.validation_status, r.validation_confidence, r.po_variance_pct,
                r.po_match, list(r.anomaly_types), r.risk_score, r.anomaly_confidence, rules(r), r.status,
                r.escalation_level) == w, key


def test_gates_at_their_thresholds(spark):
    got = run(spark, [
        invoice("ocr-low", used=True, ocr=0.60), invoice("ocr-equal", used=True, ocr=0.85),
        invoice("ocr-high", used=True, ocr=0.95), invoice("ocr-unused", ocr=0.50),
        invoice("agent-low", extraction=0.50), invoice("agent-equal", extraction=0.70)])
    assert {k: rules(r) for k, r in got.items()} == {
        "ocr-low": ["ocr_confidence_gate"], "ocr-equal": [], "ocr-high": [], "ocr-unused": [],
        "agent-low": ["agent_confidence_gate"], "agent-equal": []}
    assert got["ocr-high"].status == "validated" and got["ocr-low"].status == "on_hold"


@pytest.mark.parametrize("total, level", [
    ("1000.00", "none"), ("4999.99", "none"), ("5000.00", "l1_manager"), ("6000.00", "l1_manager"),
    ("25000.00", "l2_controller"), ("30000.00", "l2_controller"), ("100000.00", "l3_vp_cfo"), ("150000.00", "l3_vp_cfo"),
    (None, "none")])
def test_materiality_levels(spark, total, level):
    row = run(spark, [invoice("m", po=None, total=total)])["m"]
    assert [d.escalation_level for d in row.decisions if d.rule_triggered == "materiality_gate"] == \
        ([] if level == "none" else [level])


def test_outlier_bounds_are_strict(spark):
    totals = {"110.00": None, "110.01": "low", "115.00": "low", "115.01": "medium", "130.00": "medium",
              "130.01": "high", "150.00": "high", "150.01": "critical"}
    got = run(spark, [invoice(t, po="PO-100", total=t) for t in totals])
    assert {t: next((a.severity for a in r.anomalies if a.anomaly_type == "amount_outlier"), None)
            for t, r in got.items()} == totals


def test_dates_and_sums_at_their_bounds(spark):
    got = run(spark, [
        invoice("week", date=DAY + dt.timedelta(7)), invoice("later", date=DAY + dt.timedelta(8)),
        invoice("old", date=DAY - dt.timedelta(180)), invoice("older", date=DAY - dt.timedelta(181)),
        invoice("sum", subtotal="800.00", tax="99.00"), invoice("off", subtotal="800.00", tax="98.99")])
    assert {k: list(r.anomaly_types) for k, r in got.items() if r.anomaly_types} == {
        "later": ["future_dated_invoice"], "older": ["stale_invoice"]}
    assert got["week"].field_results[2].status == "pass" and got["later"].field_results[2].status == "fail"
    assert (got["sum"].field_results[3].status, got["off"].field_results[3].status) == ("pass", "fail")


def test_ninety_days_apart_is_a_duplicate(spark):
    got = run(spark, [invoice("a", number="N"), invoice("b", number="N", days=90),
                      invoice("c", number="M"), invoice("d", number="M", days=91)], duplicates=True)
    assert {k for k, r in got.items() if r.is_duplicate} == {"b"}
    assert (got["b"].status, got["b"].duplicate_of) == ("rejected", "a")


def test_flagged_without_a_gate(spark):
    row = run(spark, [invoice("f", po="PO-NONE", total="2000.00", date=DAY + dt.timedelta(30))])["f"]
    assert (rules(row), row.risk_score, row.validation_status, row.status) == ([], 0.30, "fail", "flagged")
