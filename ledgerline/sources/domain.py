"""Domain tables (vendors, purchase orders, invoices, reviews, ...) projected
from the driver's TPC-H-style tables.

Every projection is a pure DataFrame expression over the input scans, so its
work grows with the inputs and Catalyst prunes the columns it does not need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import small_side
from ..policy import CURRENCIES, RATIONALE_CATEGORIES
from ..session import compiled_code
from .tables import read_table

D12_2 = "decimal(12,2)"
D4_2 = "decimal(4,2)"
D18_2 = "decimal(18,2)"

# Fixed values of the projection rules.
CURRENCY_CYCLE = ("USD", "CAD", "EUR", "gbp", "XXX")
FLAG_CYCLE = ("ocr_confidence_gate", "duplicate_detection", "agent_confidence_gate",
              "unknown_vendor", "variance_threshold", "materiality_gate")
EVENT_DECISION = {"purchase": "approve", "signup": "adjust_and_approve",
                  "error": "reject", "click": "escalate_further", "view": "maybe"}
ROLE_OF_FLAG = {"ocr_confidence_gate": "document_intake_specialist",
                "duplicate_detection": "anomaly_detection_specialist",
                "agent_confidence_gate": "data_extraction_analyst",
                "unknown_vendor": "validation_officer",
                "variance_threshold": "validation_officer",
                "materiality_gate": "reconciliation_manager"}


def _pick(index: Column, values) -> Column:
    """values[index] for a small fixed tuple, as a CASE chain (codegen-friendly)."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def po_number_of(orderkey: Column, linenumber: Column) -> Column:
    return F.concat(F.lit("PO-"), orderkey.cast("string"), F.lit("-"), linenumber.cast("string"))


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor registry: one row per supplier; nation name as category."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    # nation has a fixed 25 rows at every scale: a broadcast of proven size
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left")
            .select(F.concat(F.lit("VND"), F.col("s_suppkey").cast("string")).alias("vendor_id"),
                    F.col("s_name").alias("name"),
                    F.col("n_name").alias("category"),
                    (F.col("s_acctbal") >= 0).alias("approved"),
                    F.lit(30).alias("payment_terms_days")))


def _po_amount() -> Column:
    """Line price x a per-line factor."""
    factor = (F.lit(0.55).cast("decimal(2,2)")
              + F.lit(0.15).cast("decimal(2,2)") * (F.col("l_linenumber") - 1)).cast(D4_2)
    return (F.col("_price").cast(D12_2) * factor).cast(D18_2)


def po_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a PO lookup reads: (po_number, amount), one row a number. Grouped
    by the number, so that the lookup needs no second exchange of the POs."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return (li.groupBy(po_number_of(F.col("l_orderkey"), F.col("l_linenumber")).alias("po_number"))
            .agg(F.min("l_extendedprice").alias("_price"), F.min("l_linenumber").alias("l_linenumber"))
            .select("po_number", _po_amount().alias("amount")))


def purchase_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PO ledger, one PO per (order, line): amounts with currency, order date and status."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey",
                    "l_extendedprice")
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    g = (li.groupBy("l_orderkey", "l_linenumber")
         .agg(F.min("l_extendedprice").alias("_price"), F.min("l_suppkey").alias("_supp")))
    return (g.join(o, g.l_orderkey == o.o_orderkey, "left")
            .select(po_number_of(F.col("l_orderkey"), F.col("l_linenumber")).alias("po_number"),
                    F.concat(F.lit("VND"), F.col("_supp").cast("string")).alias("vendor_id"),
                    _po_amount().alias("amount"), F.lit("USD").alias("currency"),
                    F.to_date("o_orderdate").alias("issued_date"), F.lit("open").alias("status")))


def _day_digits(at: Column) -> Column:
    """yyyyMMdd; from numbers where the year has four digits, without a formatter."""
    digits = (F.year(at) * 10000 + F.month(at) * 100 + F.dayofmonth(at)).cast("string")
    return F.when(F.year(at).between(1000, 9999), digits).otherwise(F.date_format(at, "yyyyMMdd"))


LINEITEM_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_shipdate")


def invoices(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """One invoice per line item, with the nulling/renaming rules that make the
    checks fire (missing numbers, unlisted vendors, unknown POs, bad currency).
    ``lineitem`` may be a stream (the supplier side is then a static join)."""
    compiled_code(spark)
    li = (lineitem.select(*LINEITEM_COLS) if lineitem is not None
          else read_table(spark, sf_dir, "lineitem", *LINEITEM_COLS))
    # upper-cased once a supplier, not once a line
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select("s_suppkey", F.upper("s_name").alias("_s_upper"))
    j = li.join(small_side(s), li.l_suppkey == s.s_suppkey, "left")
    ext = F.col("l_extendedprice").cast(D12_2)
    disc = (1 - F.col("l_discount")).cast(D4_2)
    taxf = (1 + F.col("l_tax")).cast(D4_2)
    subtotal = (ext * disc).cast(D18_2)
    total = (ext * disc * taxf).cast(D18_2)
    tax = (total - subtotal + F.when(F.col("l_linenumber") == 6, F.lit(2).cast(D18_2))
           .otherwise(F.lit(0).cast(D18_2))).cast(D18_2)
    out = j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"),
                    _day_digits(F.col("l_shipdate"))).alias("invoice_id"),
        F.col("l_orderkey").alias("order_key"),
        F.when(F.col("l_partkey") % 37 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("INV-"), F.col("l_partkey").cast("string"))).alias("invoice_number"),
        F.when(F.col("l_suppkey") % 29 == 0, F.lit(None).cast("string"))
         .when(F.col("l_suppkey") % 17 == 0, F.concat(F.lit("Unlisted "), F.col("l_suppkey").cast("string")))
         .otherwise(F.col("_s_upper")).alias("vendor_name"),
        F.when(F.col("l_quantity") == 13, F.lit(None).cast("date"))
         .otherwise(F.to_date("l_shipdate")).alias("invoice_date"),
        F.when(F.col("l_partkey") % 11 == 0, F.lit(None).cast("string"))
         .when(F.col("l_partkey") % 13 == 0, F.lit("PO-NONE"))
         .otherwise(po_number_of(F.col("l_orderkey"), F.col("l_linenumber"))).alias("po_number"),
        _pick(F.col("l_suppkey") % 5, CURRENCY_CYCLE).alias("currency"),
        subtotal.alias("subtotal"), tax.alias("tax"), total.alias("total"),
        (F.col("l_returnflag") == "R").alias("ocr_used"),
        (1 - 3 * F.col("l_discount")).cast(D4_2).cast("double").alias("ocr_confidence"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_quantity").cast("decimal(12,2)").alias("quantity"),
        unit_price_col().alias("unit_price"),
        F.col("l_partkey").alias("part_key"),
    )
    return out.withColumn("extraction_confidence", extraction_confidence_col())


def unit_price_col() -> Column:
    """price / quantity rounded half-up to cents, in exact integers."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    q = F.col("l_quantity").cast("bigint")
    num, den = cents * 2 + q, q * 2
    unit_cents = ((num - F.pmod(num, den)) / den).cast("bigint")
    return F.when(q > 0, unit_cents.cast("decimal(18,0)") / 100).cast(D18_2)


def extraction_confidence_col() -> Column:
    """Share of the five key fields that are present (raw strings count)."""
    from ..functions.cols import missing
    n = (F.when(missing(F.col("vendor_name")), 0).otherwise(1)
         + F.when(missing(F.col("invoice_number")), 0).otherwise(1)
         + F.when(F.col("invoice_date").isNull(), 0).otherwise(1)
         + F.when(F.col("total").isNull(), 0).otherwise(1)
         + F.when(missing(F.col("po_number")), 0).otherwise(1))
    return n.cast("double") / F.lit(5.0)


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items per order: (order_key, line_no, description, quantity, unit_price, total)."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber",
                    "l_quantity", "l_extendedprice", "l_discount")
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    j = li.join(p, li.l_partkey == p.p_partkey, "left")
    qty = F.col("l_quantity").cast("decimal(12,2)")
    unit = unit_price_col()
    return j.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("p_name").alias("description"),
        qty.alias("quantity"),
        unit.cast(D18_2).alias("unit_price"),
        (F.col("l_extendedprice").cast(D12_2) * (1 - F.col("l_discount")).cast(D4_2))
        .cast(D18_2).alias("total"),
    )


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items with values that break each line rule, by part number."""
    part = F.col("part_key")
    return invoice_lines(spark, sf_dir).withColumns({
        "description": F.when(part % 41 == 0, "").when(part % 43 == 0, F.lit(None).cast("string"))
                        .when(part % 47 == 0, F.repeat(F.lit("x"), F.lit(501))).otherwise(F.col("description")),
        "quantity": F.when(part % 53 == 0, F.lit(0).cast("decimal(12,2)")).otherwise(F.col("quantity")),
        "unit_price": F.when(part % 59 == 0, F.lit(-1).cast(D18_2)).otherwise(F.col("unit_price")),
        "total": F.when(part % 61 == 0, F.lit(-1).cast(D18_2)).otherwise(F.col("total"))})


def human_decisions(spark: SparkSession, sf_dir: str,
                    invoices_df: DataFrame | None = None) -> DataFrame:
    """Reviewer decisions from the event stream.

    The decided invoice is the first stored invoice (by id) of order
    ``event_id``; events whose order has none point at an id that matches
    nothing (``ORPHAN-<event_id>``).
    """
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type",
                    "value", "props")
    inv = invoices_df if invoices_df is not None else invoices(spark, sf_dir)
    # only stored invoices (a supported currency) can be reviewed
    inv = inv.where(F.upper(F.col("currency")).isin(*CURRENCIES))
    first = inv.groupBy("order_key").agg(F.min("invoice_id").alias("_inv"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    dec = F.col("event_type")
    decision = None
    for src, dst in EVENT_DECISION.items():
        decision = F.when(dec == src, F.lit(dst)) if decision is None else decision.when(dec == src, F.lit(dst))
    flag = _pick(F.pmod(k, F.lit(6)), FLAG_CYCLE)
    rationale = _pick(F.pmod(F.col("event_id"), F.lit(9)), RATIONALE_CATEGORIES + ("bogus",))
    role = None
    for f_, r_ in ROLE_OF_FLAG.items():
        role = F.when(flag == f_, F.lit(r_)) if role is None else role.when(flag == f_, F.lit(r_))
    j = ev.join(first, ev.event_id == first.order_key, "left")
    return j.select(
        F.col("event_id").cast("string").alias("decision_id"),
        F.coalesce(F.col("_inv"), F.concat(F.lit("ORPHAN-"), F.col("event_id").cast("string"))).alias("invoice_id"),
        F.col("user_id").cast("string").alias("reviewer_id"),
        F.concat(F.lit("Reviewer "), F.col("user_id").cast("string")).alias("reviewer_name"),
        decision.alias("decision"),
        rationale.alias("rationale_category"),
        F.col("event_type").alias("rationale_text"),
        flag.alias("original_flag"),
        role.alias("original_agent"),
        F.col("value").alias("resolution_time_hours"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("seq"),
    )
