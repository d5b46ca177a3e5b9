"""Table maintenance, lookups and row checks (A1-A7, B1-B11) as DataFrame
operators: anti-join seeding, join-based upserts and status changes, JSON
round trips, paging, per-status caps and constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cols import compact, missing
from ..policy import CURRENCIES, DEFAULT_POLICY, INVOICE_STATUSES, Policy

LINE_ITEM = "array<struct<line_no:int,description:string,quantity:decimal(12,2),unit_price:decimal(18,2),total:decimal(18,2)>>"


def seed_missing(existing: DataFrame, seed: DataFrame, key: str,
                 skip_if_nonempty: bool = False) -> DataFrame:
    """A3: insert seed rows whose key is absent (left anti join + union).
    With ``skip_if_nonempty`` the whole load is skipped when rows exist
    (one bounded probe: ``limit(1)``)."""
    if skip_if_nonempty and not existing.limit(1).isEmpty():
        return existing.withColumn("inserted", F.lit(False))
    new = seed.join(existing.select(key), key, "left_anti")
    return (existing.withColumn("inserted", F.lit(False))
            .unionByName(new.withColumn("inserted", F.lit(True))))


KEEP_ON_UPSERT = ("source_filename", "document_type", "created_at")


def upsert(old: DataFrame, new: DataFrame, key: str, keep=KEEP_ON_UPSERT) -> DataFrame:
    """A4: insert, or replace every column except ``keep`` (kept from the old
    row) -- one full outer join on the key."""
    cols = [c for c in old.columns if c != key]
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_has_old"))
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols if c in new.columns],
                   F.lit(True).alias("_has_new"))
    j = o.join(n, key, "full_outer")
    has_old = F.coalesce(F.col("_has_old"), F.lit(False))
    has_new = F.coalesce(F.col("_has_new"), F.lit(False))
    out = [F.col(key)]
    for c in cols:
        if c not in new.columns:
            out.append(F.col(f"_o_{c}").alias(c))
        elif c in keep:
            out.append(F.when(has_old, F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c))
        else:
            out.append(F.when(has_new, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c))
    return j.select(*out, (has_new & has_old).alias("updated"), (has_new & ~has_old).alias("inserted"))


def apply_status_changes(invoices: DataFrame, changes: DataFrame, as_of_ts) -> DataFrame:
    """Status changes as a left join; unchanged rows keep status and time."""
    ch = changes.select(F.col("invoice_id").alias("_cid"), F.col("status").alias("_new_status"))
    j = invoices.join(ch, invoices.invoice_id == ch._cid, "left")
    return (j.withColumns({"status": F.coalesce("_new_status", "status"),
                           "updated_at": F.when(F.col("_new_status").isNotNull(), F.lit(as_of_ts))
                                          .otherwise(F.col("created_at"))})
            .drop("_cid", "_new_status"))


def line_items(lines: DataFrame) -> DataFrame:
    """Nested line items per order (one aggregate, sorted array of structs)."""
    item = F.struct(F.col("line_no").cast("int").alias("line_no"), "description", "quantity",
                    "unit_price", "total")
    return (lines.groupBy("order_key").agg(F.array_sort(F.collect_list(item)).alias("line_items")))


def json_roundtrip(items: DataFrame) -> DataFrame:
    """Nested -> JSON text -> nested (bad JSON would come back NULL)."""
    j = items.withColumn("line_items_json", F.to_json("line_items"))
    return j.withColumn("line_items_back", F.from_json("line_items_json", LINE_ITEM))


def page(df: DataFrame, status: str | None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Optional status filter, newest first (id tiebreak), offset/limit.
    A limit outside 1-500 or a negative offset is refused."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError(f"limit must be 1-500 and offset not negative: {limit}, {offset}")
    src = df.where(F.col("status") == status) if status else df
    return src.orderBy(F.col("created_at").desc(), F.col("invoice_id")).offset(offset).limit(limit)


def exceptions(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Every flagged, on_hold or rejected invoice, with its status group
    (the order of the report). With ``cap`` only the newest of each status
    (row_number <= cap is planned as a per-partition group limit before the
    shuffle, so a status with many rows ships only ``cap`` per task)."""
    order = {"flagged": 0, "on_hold": 1, "rejected": 2}
    held = df.where(F.col("status").isin(*order))
    if cap is not None:
        w = Window.partitionBy("status").orderBy(F.col("created_at").desc(), F.col("invoice_id"))
        held = held.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    grp = F.when(F.col("status") == "flagged", 0).when(F.col("status") == "on_hold", 1).otherwise(2)
    return held.withColumn("status_group", grp)


def invoice_violations(inv: DataFrame) -> DataFrame:
    """B8 on invoices: enum membership, confidence ranges, required fields, and
    what is wrong with their lines (``line_violations``, if that is a column).
    Adds the list ``violations`` and the boolean ``storable``: it is empty."""
    in01 = lambda c: F.col(c).between(0.0, 1.0)
    broken = {
        "currency": ~F.upper(F.col("currency")).isin(*CURRENCIES),
        "extraction_confidence": ~in01("extraction_confidence"),
        "ocr_confidence": ~in01("ocr_confidence"),
        "invoice_id": missing(F.col("invoice_id")),
    }
    if "status" in inv.columns:
        broken["status"] = F.col("status").isNotNull() & ~F.col("status").isin(*INVOICE_STATUSES)
    v = compact(*[F.when(c, F.lit(name)) for name, c in broken.items()])
    bad = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in broken.values()])
    if "line_violations" in inv.columns:
        v = F.concat(v, F.coalesce("line_violations", F.array().cast("array<string>")))
        bad = bad | F.coalesce(F.size("line_violations") > 0, F.lit(False))
    return inv.withColumns({"violations": v, "storable": ~bad})


def no_violations() -> F.Column:
    """Only rows without violations are stored. A boolean of its own: the
    list need not be built to know it."""
    return F.col("storable")


def line_violations(lines: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """B8 on line items, and B10's tolerance check (reported, never gating)."""
    d = F.col("description")
    v = compact(
        F.when(d.isNull() | (F.length(d) < 1) | (F.length(d) > 500), F.lit("description")),
        F.when(~(F.col("quantity") > 0), F.lit("quantity")),
        F.when(~(F.col("unit_price") >= 0), F.lit("unit_price")),
        F.when(~(F.col("total") >= 0), F.lit("total")))
    expected = (F.col("quantity") * F.col("unit_price")).cast("decimal(20,4)")
    return lines.withColumns({
        "violations": v,
        "expected_total": expected,
        "total_mismatch": F.abs(expected - F.col("total")) > F.lit(str(policy.line_tolerance)).cast("decimal(4,2)"),
    })


def with_line_violations(inv: DataFrame, lines: DataFrame, key: str = "order_key") -> DataFrame:
    """B8 on nested records: a record with a bad line is bad. The rules that
    the lines of a record break (four at most) are one array on each invoice of
    the record, as ``line.<field>``."""
    broken = line_violations(lines).select(F.col(key).alias("_key"), F.explode("violations").alias("_rule"))
    folded = broken.groupBy("_key").agg(
        F.sort_array(F.collect_set(F.concat(F.lit("line."), F.col("_rule")))).alias("line_violations"))
    return inv.join(folded, F.col(key) == F.col("_key"), "left").drop("_key")


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may be stored, and those that may not with their
    ``reasons``; ``checked`` comes from ``invoice_violations``."""
    good = checked.where(no_violations())
    bad = checked.where(~no_violations()).withColumn("reasons", F.array_join("violations", ","))
    return good, bad
