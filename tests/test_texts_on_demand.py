"""Scores build no texts that are not read, and events are moved as one row an
invoice, on invoices written here."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_golden_rows import ORDERS, POLICY, SCHEMA, VENDORS, invoice

from ledgerline.functions import text as T
from ledgerline.operators import audit, governance, review
from ledgerline.operators import extract as X
from ledgerline.plans.scoring import score
from ledgerline.policy import FIELD_PATTERNS


@pytest.fixture(scope="module")
def scored(spark):
    rows = [invoice("a"), invoice("b", vendor=None), invoice("c", total="60000.00", extraction=0.2),
            invoice("d", number="n"), invoice("e", number="n", days=3)]
    return score(spark.createDataFrame(rows, SCHEMA),
                 spark.createDataFrame(VENDORS, "vendor_id string, name string, approved boolean"),
                 spark.createDataFrame(ORDERS, "po_number string, amount decimal(18,2)"), POLICY)


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_scores_build_no_texts(scored, capsys):
    for df in (scored.select("invoice_id", "status", "escalation_level", "validation_status", "risk_score"),
               governance.decision_rows(scored).select("invoice_id", "rule_triggered", "threshold_value"),
               review.latest_escalation(scored)):
        text = plan(df, capsys)
        assert "format_string" not in text and "StructsToJson" not in text and "to_json" not in text
    assert "format_string" in plan(scored.select("decisions"), capsys)


def test_decision_rows_are_those_of_the_list(scored):
    rows = governance.decision_rows(scored).select(
        "invoice_id", "seq", *governance.DECISION).collect()
    lists = {r.invoice_id: r.decisions for r in scored.select("invoice_id", "decisions").collect()}
    assert sum(map(len, lists.values())) == len(rows) > 4
    for r in rows:
        assert lists[r.invoice_id][r.seq - 1].asDict() == {c: r[c] for c in governance.DECISION}


def test_events_are_moved_before_they_are_exploded(scored, capsys):
    reviews = scored.select(F.md5("invoice_id").alias("entry_id"), "invoice_id", F.lit("human_review").alias("event_type"),
                            *[F.lit("x").alias(c) for c in ("actor", "description", "before_state", "after_state", "metadata")],
                            F.col("created_at").alias("timestamp"))
    rows = lambda df: sorted(map(tuple, df.select("invoice_id", "position", "event_type", "entry_id").collect()))
    placed = audit.trail_positions(audit.lifecycle_events(scored, reviews, POLICY, audit.by_invoice))
    text = plan(placed, capsys)
    assert text.index("Generate") < text.index("Exchange")
    assert rows(placed) == rows(audit.trail_positions(audit.lifecycle_events(scored, reviews, POLICY)))


def test_patterns_are_tried_one_after_the_other(spark, capsys):
    """As the nested form, NULL and odd texts included; each pattern stands once in the plan."""
    lines = ["Invoice #: A-1", "inv no. B-2", "PO Number: 7", "From: Acme Ltd\n", "vendor: Bolt & Co\n", "Total Due: $5.00",
             "amount due 7.1", "Date: 1/2/2024", "dated March 3, 2024", "Invoice Date: ", "EUR", "vat 3", "From: \n"]
    texts = [None, "", " "] + ["\n".join(lines[i::k]) for k in (1, 2, 3, 5) for i in range(k)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    for parity in (False, True):
        found = T.with_first_matches(df, "x", FIELD_PATTERNS, parity)
        nested = df.select("i", *[c.alias(f"{f}_raw") for f, c in T.extract_raw(F.col("x"), parity).items()])
        assert sorted(map(str, found.select(*nested.columns).collect())) == sorted(map(str, nested.collect()))
    capsys.readouterr()
    X.extraction_prompts(X.with_extraction_confidence(df, "x"), "x").select("i", F.md5("prompt")).explain()
    text = capsys.readouterr().out
    assert text.count("regexp_extract(") == sum(len(FIELD_PATTERNS[f]) for f in T.KEY_FIELDS)
    assert text.count("Project") > max(len(FIELD_PATTERNS[f]) for f in T.KEY_FIELDS)
