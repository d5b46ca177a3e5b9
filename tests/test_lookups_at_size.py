"""Lists are built inside the generated code, lookups read the POs once, common
passage lists do not meet in one task, a micro-batch is computed once for its
history; on rows written here."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_golden_rows import ORDERS, POLICY, SCHEMA, VENDORS, invoice

from ledgerline.functions.cols import compact
from ledgerline.operators import audit, governance, registry, retrieval
from ledgerline.plans.scoring import score
from ledgerline.sources import domain
from ledgerline.streaming import gates


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.fixture(scope="module")
def scored(spark):
    rows = [invoice("a"), invoice("b", vendor=None), invoice("c", total="60000.00", extraction=0.2),
            invoice("d", number="n"), invoice("e", number="n", days=3)]
    return score(spark.createDataFrame(rows, SCHEMA),
                 spark.createDataFrame(VENDORS, "vendor_id string, name string, approved boolean"),
                 spark.createDataFrame(ORDERS, "po_number string, amount decimal(18,2)"), POLICY)


def test_compact_drops_nulls_in_order(spark):
    df = spark.createDataFrame([(1, None, 3), (None, None, None), (2, 2, None)], "a int, b int, c int")
    got = [r.x for r in df.select(compact(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()]
    assert got == [[1, 3], [], [2, 2]]


def test_lists_stay_in_generated_code(scored, capsys):
    for df in (governance.decision_rows(scored).select("invoice_id", "rule_triggered", "threshold_value"),
               scored.where(registry.no_violations()).select("invoice_id", "status", "anomaly_types"),
               audit.lifecycle_events(scored, policy=POLICY).select("invoice_id", "event_type")):
        assert "lambda" not in plan(df, capsys)


def test_decisions_are_computed_once_a_row(scored, capsys):
    text = plan(governance.decision_rows(scored).select("invoice_id", "rule_triggered", "threshold_value"), capsys)
    assert text.count("struct(rule_triggered, ocr_confidence_gate") == 1


def test_the_history_does_not_look_up_orders(spark, tmp_path, capsys):
    """One join to the POs, with one exchange of these."""
    spark.createDataFrame([(1, 1, 5.0), (1, 1, 4.0), (1, 2, 7.0), (None, 1, 9.0)],
                          "l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    pos = domain.po_amounts(spark, str(tmp_path))
    assert {(r.po_number, str(r.amount)) for r in pos.where("po_number is not null").collect()} == {
        ("PO-1-1", "2.20"), ("PO-1-2", "4.90")}
    invoices = spark.createDataFrame([invoice("a"), invoice("b")], SCHEMA)
    vendors = spark.createDataFrame(VENDORS, "vendor_id string, name string, approved boolean")
    text = plan(score(invoices, vendors, pos, POLICY).select("invoice_id", "status"), capsys)
    assert text.count("l_orderkey:bigint") == 1 and "hashpartitioning(l_orderkey" not in text


def test_common_passage_lists_meet_no_aggregate(spark, capsys):
    corpus = spark.createDataFrame([("c1", 1, 0, "s", "terms of payment"), ("c2", 2, 0, "s", "payment to acme"),
                                    ("c3", 3, 0, "s", "other words")],
                                   "chunk_id string, doc_id long, chunk_index int, source string, text string")
    asked = spark.createDataFrame([(f"i{i}", 2, "nobody") for i in range(9)] + [("j", 2, "acme"), ("k", 7, "nobody"), ("n", 2, None)],
                                  "invoice_id string, q_no int, own string")
    got = retrieval.policy_context(asked, {2: "payment terms"}, corpus)
    text = plan(got, capsys)
    assert "Aggregate" not in text
    rows = dict(map(tuple, got.collect()))
    one, two = "[s] terms of payment", "[s] payment to acme"
    rule = "\n\n---\n\n"
    assert rows == {**{f"i{i}": one + rule + two for i in range(9)}, "j": one + rule + two,
                    "k": "No relevant policy context found.", "n": "No relevant policy context found."}


def test_a_micro_batch_is_computed_once_for_its_history(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(_):
        seen.add(1)
        return True

    rows = [(f"i{i}", "n", "v", True) for i in range(5)]
    batch = spark.createDataFrame(rows, "invoice_id string, invoice_number string, vendor_name string, valid boolean")
    batch = batch.withColumn("created_at", F.lit("2024-02-03").cast("timestamp_ntz")).where(
        F.udf(count, "boolean")("invoice_id"))
    assert len(gates.add_to_history(batch, str(tmp_path), 0, 4)) == 1
    assert seen.value == 5


def test_a_filter_on_the_status_reads_each_gate_once(scored, capsys):
    """No list is built and no condition is repeated to know whether a row is kept."""
    kept = scored.where(registry.no_violations() & F.col("status").isin("flagged", "on_hold", "rejected"))
    text = plan(kept.select("invoice_id", "status"), capsys)
    line = max((x for x in text.split("\n") if "Filter" in x), key=len)
    assert "size(" not in text and "remainder" not in line and "% 1" not in line
    assert line.count("ocr_used") == 1 and line.count("0.4") == 0
    assert {(r.invoice_id, r.status) for r in kept.collect()} == {
        (r.invoice_id, r.status) for r in scored.collect() if not r.violations and r.status in ("flagged", "on_hold", "rejected")}


def test_days_of_invoice_ids_are_formatted_alike(spark):
    days = ["0001-01-01", "0999-12-31", "1000-01-01", "1996-09-03", "9999-12-31"]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "d string").select(F.expr("cast(d AS timestamp_ntz)").alias("t"))
    assert all(r.a == r.b for r in df.select(domain._day_digits(F.col("t")).alias("a"),
                                             F.date_format("t", "yyyyMMdd").alias("b")).collect())
