"""The invoice scoring plan: lookups once, then validation, anomaly and
governance columns in one projection over the enriched frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.anomaly import analyze
from ..operators.enrich import enrich, match_pos, match_vendors
from ..operators.governance import govern
from ..operators.registry import invoice_violations, no_violations
from ..operators.validate import validate
from ..policy import DEFAULT_POLICY, Policy
from ..session import compiled_code
from ..sources import domain


def normalise_currency(inv: DataFrame) -> DataFrame:
    """Currency upper-cased (NULL -> USD), validity kept as a column."""
    return inv.withColumn("currency", F.upper(F.coalesce(F.col("currency"), F.lit("USD"))))


def score(inv: DataFrame, vendors: DataFrame, pos: DataFrame,
          policy: Policy = DEFAULT_POLICY, history: DataFrame | None = None,
          duplicates: DataFrame | bool | None = True) -> DataFrame:
    """Invoices -> every check, flag, gate decision and final status.

    ``duplicates``: True computes the 90-day history here (batch); a
    DataFrame of (invoice_id, is_duplicate, duplicate_of,
    duplicate_of_created_at) supplies it from elsewhere (the streaming
    detector); None takes these columns from ``inv``; False scores without a
    history."""
    compiled_code(inv.sparkSession)
    inv = invoice_violations(normalise_currency(inv))
    if duplicates is True:
        e = enrich(inv, vendors, pos, policy, history, no_violations())
    else:
        e = match_pos(match_vendors(inv, vendors), pos)
        if duplicates is False:
            e = e.withColumns({"is_duplicate": F.lit(False), "duplicate_of": F.lit(None).cast("string"),
                               "duplicate_of_created_at": F.lit(None).cast("timestamp_ntz")})
        elif duplicates is not None:
            e = e.join(duplicates, "invoice_id", "left").withColumn(
                "is_duplicate", F.coalesce(F.col("is_duplicate"), F.lit(False)))
    return govern(analyze(validate(e, policy), policy), policy)


def scored_from_tables(spark: SparkSession, sf_dir: str,
                       policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return score(domain.invoices(spark, sf_dir), domain.vendors(spark, sf_dir),
                 domain.po_amounts(spark, sf_dir), policy)
