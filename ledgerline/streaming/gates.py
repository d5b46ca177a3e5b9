"""Structured Streaming (K1, K2): invoices arrive as a file stream and are
scored as they come, against registries and a growing history of invoices.

The history holds the invoices seen, in folders by key bucket and quarter. Each
micro-batch is added to it, and the batch operator (E1) is applied to the keys
the batch touched, within the look-back window around its rows; only the
buckets and quarters of those rows are read, so the work of a batch does not
grow with the history. New flags replace old ones: an invoice that arrives late
can turn a later invoice, scored long ago, into a duplicate. K1 scores all
invoices a batch touched again, so its statuses follow. Results are tables by
batch number, of which the newest row of an invoice counts; the result after
any micro-batch is that of all rows seen so far, whatever the order of files,
and a batch that is run again after a failure replaces its own rows.

K1 looks invoices up in the registries as they are when a batch is scored;
a registry that changes later does not change statuses given before.

``watermarked_duplicates`` is K2 as a stateful self-join: its state is bounded
by the watermark, and rows behind it go to a side table instead.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.cols import missing
from ..operators.enrich import duplicate_history
from ..operators.registry import invoice_violations, no_violations
from ..policy import DEFAULT_POLICY, Policy
from ..session import EXCHANGES_DROPPED, ensure_checkpoint_dir, settings
from ..sources import domain

FLAG_COLUMNS = ("is_duplicate", "duplicate_of", "duplicate_of_created_at")
FLAGS = "invoice_id string, is_duplicate boolean, duplicate_of string, duplicate_of_created_at timestamp_ntz, batch bigint"
STATUS_COLUMNS = ("status", "escalation_level", "n_decisions", "validation_status", "risk_score")
BUCKETS = 8


def lineitem_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The line-item table as a file stream (glob path: the source lists files)."""
    path = f"{sf_dir.rstrip('/')}/lineitem.parquet"
    schema = spark.read.parquet(path).schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path[:-1] + "[" + path[-1] + "]"))


def stream_folder(spark: SparkSession, name: str) -> str:
    """Tables and checkpoint of a stream, in the session's shared folder. The
    same name continues the same stream."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def storable(inv: DataFrame) -> DataFrame:
    """Adds ``valid``: the invoice breaks no row constraint."""
    usd = inv.withColumn("currency", F.coalesce("currency", F.lit("USD")))
    return invoice_violations(usd).withColumn("valid", no_violations()).drop("storable")


def quarter_of(at: Column) -> Column:
    """Quarters since year 0."""
    return F.year(at) * 4 + F.quarter(at) - 1


def keyed(batch: DataFrame, buckets: int) -> DataFrame:
    """Rows that have a key, with it, its bucket and their quarter."""
    has_key = ~missing(F.col("invoice_number")) & ~missing(F.col("vendor_name"))
    return batch.where(has_key).withColumns({
        "_n": F.col("invoice_number"), "_v": F.lower("vendor_name"),
        "bucket": F.pmod(F.xxhash64("invoice_number", F.lower("vendor_name")), F.lit(buckets)).cast("int"),
        "quarter": quarter_of(F.col("created_at"))})


def write(rows: DataFrame, path: str, *folders: str) -> None:
    """Writes a micro-batch's rows, in place of those there; the exchanges they came by are gone then."""
    with settings(rows.sparkSession, EXCHANGES_DROPPED):
        (rows.write.option("compression", "zstd").mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*folders).parquet(path))


def add_to_history(batch: DataFrame, base: str, number: int, buckets: int) -> list[tuple[int, int]]:
    """Writes the batch into the history (its own folders are replaced) and
    returns the buckets and quarters it touched (at most ``buckets`` times the
    quarters of its rows)."""
    rows = keyed(batch, buckets).withColumn("batch", F.lit(number).cast("bigint"))
    write(rows.drop("_n", "_v").repartition("bucket", "quarter"), f"{base}/rows", "bucket", "quarter", "batch")
    # from the folders: the batch is not computed again
    written = (batch.sparkSession.read.schema("bucket int, quarter int, batch bigint").parquet(f"{base}/rows")
               .where(F.col("batch") == number))
    return sorted((r.bucket, r.quarter) for r in written.select("bucket", "quarter").distinct().collect())


def history_near(spark: SparkSession, schema: StructType, base: str, number: int, touched: list[tuple[int, int]],
                 days: int) -> DataFrame:
    """The history of the touched buckets, ``days`` around the touched quarters."""
    reach = days // 90 + 1
    quarters: dict[int, set[int]] = {}
    for bucket, quarter in touched:
        quarters.setdefault(bucket, set()).update(range(quarter - reach, quarter + reach + 1))
    folders = [f"{base}/rows/bucket={b}/quarter={{{','.join(map(str, sorted(q)))}}}" for b, q in quarters.items()]
    folder_columns = [StructField("bucket", IntegerType()), StructField("quarter", IntegerType()),
                      StructField("batch", LongType())]
    seen = (spark.read.schema(StructType(schema.fields + folder_columns))
            .option("basePath", f"{base}/rows").parquet(*folders))
    return seen.where(F.col("batch") <= number).withColumns({"_n": F.col("invoice_number"), "_v": F.lower("vendor_name")})


def touched_invoices(batch: DataFrame, base: str, number: int, policy: Policy, buckets: int) -> DataFrame | None:
    """The invoices whose flags this batch decides, with all columns and their
    flags: its own and those of its keys from its first row on. Only ``valid``
    invoices are stored and can be the earlier one of a pair. Its own rows are
    all wanted: only older ones are joined to the times of its keys."""
    touched = add_to_history(batch, base, number, buckets)
    if not touched:
        return None
    days = int(policy.duplicate_days) + 1
    seen = history_near(batch.sparkSession, batch.schema, base, number, touched, days)
    own = seen.where(F.col("batch") == number).withColumn("_decided", F.lit(True))
    if seen.where(F.col("batch") < number).isEmpty():
        return duplicate_history(own, policy, witness=F.col("valid")).drop("_decided")
    around = own.groupBy("_n", "_v").agg(F.min("created_at").alias("_lo"), F.max("created_at").alias("_hi"))
    older = (seen.where(F.col("batch") < number).join(around, ["_n", "_v"])
             .where(F.expr(f"created_at BETWEEN _lo - INTERVAL {days} DAYS AND _hi + INTERVAL {days} DAYS"))
             .withColumn("_decided", F.expr("created_at >= _lo")).drop("_lo", "_hi"))
    return duplicate_history(own.unionByName(older), policy, witness=F.col("valid")).where("_decided").drop("_decided")


def duplicates_step(base: str, policy: Policy = DEFAULT_POLICY, buckets: int = BUCKETS):
    """What K2 does with a micro-batch of invoices."""
    def step(batch: DataFrame, number: int) -> None:
        flags = touched_invoices(batch, base, number, policy, buckets)
        if flags is not None:
            write(flags.select("invoice_id", *FLAG_COLUMNS), f"{base}/flags/batch={number}")
    return step


def gates_step(base: str, vendors: DataFrame, pos: DataFrame, policy: Policy = DEFAULT_POLICY, buckets: int = BUCKETS):
    """What K1 does with a micro-batch: flags as K2, then all gates for the
    invoices whose flags the batch decides and for those without a key."""
    def step(batch: DataFrame, number: int) -> None:
        from ..plans.scoring import score
        columns = batch.columns
        flagged = touched_invoices(batch, base, number, policy, buckets)
        no_key = missing(F.col("invoice_number")) | missing(F.col("vendor_name"))
        rows = batch.where(no_key).withColumns({"is_duplicate": F.lit(False), "duplicate_of": F.lit(None).cast("string"),
                                                "duplicate_of_created_at": F.lit(None).cast("timestamp_ntz")})
        if flagged is not None:
            rows = rows.unionByName(flagged.select(*columns, *FLAG_COLUMNS))
        scored = score(rows.drop("violations", "valid"), vendors, pos, policy, duplicates=None)
        write(scored.select("invoice_id", *STATUS_COLUMNS), f"{base}/statuses/batch={number}")
    return step


def latest(versions: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Of a table by batch number, the newest row of each key."""
    columns = [c for c in versions.columns if c not in (key, "batch")]
    return (versions.groupBy(key).agg(F.max(F.struct("batch", F.struct(*columns).alias("row"))).alias("newest"))
            .select(key, *[F.col(f"newest.row.{c}").alias(c) for c in columns]))


def latest_flags(spark: SparkSession, base: str) -> DataFrame:
    """The flags of each invoice after the newest batch that touched it."""
    return latest(spark.read.schema(FLAGS).parquet(f"{base}/flags"))


def drive(df: DataFrame, step, base: str) -> None:
    """Work off all that is available; a later call goes on from there."""
    (df.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def stream_duplicates(spark: SparkSession, sf_dir: str, policy: Policy = DEFAULT_POLICY,
                      name: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """K2: continuous 90-day duplicate detection. With a ``name`` a later call
    goes on where the last one ended."""
    base = stream_folder(spark, name or f"dups_{uuid.uuid4().hex[:8]}")
    inv = storable(domain.invoices(spark, sf_dir, lineitem=lineitem_stream(spark, sf_dir)))
    drive(inv.select("invoice_id", "invoice_number", "vendor_name", "created_at", "valid"),
          duplicates_step(base, policy, buckets), base)
    return latest_flags(spark, base)


def stream_gates(spark: SparkSession, sf_dir: str, policy: Policy = DEFAULT_POLICY, name: str | None = None,
                 registry_dir: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """K1: every arriving invoice is looked up in the vendor and PO registries
    (of ``registry_dir``, default ``sf_dir``), validated, analysed and gated,
    and so is every earlier one whose duplicate flag it may change. With a
    ``name`` a later call goes on where the last one ended."""
    base = stream_folder(spark, name or f"gates_{uuid.uuid4().hex[:8]}")
    registries = registry_dir or sf_dir
    inv = storable(domain.invoices(spark, sf_dir, lineitem=lineitem_stream(spark, sf_dir)))
    drive(inv, gates_step(base, domain.vendors(spark, registries), domain.po_amounts(spark, registries), policy, buckets),
          base)
    return latest(spark.read.option("basePath", f"{base}/statuses").parquet(f"{base}/statuses/batch=*"))


def watermarked_duplicates(spark: SparkSession, sf_dir: str, delay: str = "3650 days", policy: Policy = DEFAULT_POLICY,
                           name: str | None = None, files_per_trigger: int = 1) -> tuple[DataFrame, DataFrame]:
    """K2 as a stream-stream interval join of the invoices with themselves:
    (invoice_id of duplicates, late rows). State is kept for the watermark's
    ``delay`` and the look-back. A row more than ``delay`` behind the newest row
    of earlier batches is late: the join does not see it, and it is written to
    the side table. Without late rows the result is that of the batch."""
    base = stream_folder(spark, name or f"join_{uuid.uuid4().hex[:8]}")

    def side(p: str) -> DataFrame:
        inv = storable(domain.invoices(spark, sf_dir, lineitem=lineitem_stream(spark, sf_dir, files_per_trigger)))
        has_key = ~missing(F.col("invoice_number")) & ~missing(F.col("vendor_name"))
        return inv.where(has_key).select(
            F.col("invoice_id").alias(f"{p}_id"), F.col("invoice_number").alias(f"{p}_n"),
            F.lower("vendor_name").alias(f"{p}_v"), F.col("created_at").cast("timestamp").alias(f"{p}_at"),
            F.col("valid").alias(f"{p}_valid")).withWatermark(f"{p}_at", delay)

    later, earlier = side("l"), side("r").where("r_valid")
    pairs = later.join(earlier, F.expr(
        f"""l_n = r_n AND l_v = r_v AND r_at >= l_at - INTERVAL {int(policy.duplicate_days)} DAYS AND r_at <= l_at
            AND (r_at < l_at OR r_id < l_id)"""))

    def keep(batch: DataFrame, number: int) -> None:
        (batch.select(F.col("l_id").alias("invoice_id")).distinct().write.mode("overwrite")
         .parquet(f"{base}/pairs/batch={number}"))

    def late(batch: DataFrame, number: int) -> None:
        newest = f"{base}/newest/batch={number}"
        batch.agg(F.max("l_at").alias("at")).write.mode("overwrite").parquet(newest)
        if number:
            before = (spark.read.schema("at timestamp, batch bigint").parquet(f"{base}/newest")
                      .where(F.col("batch") < number).agg(F.max("at").alias("at")))
            (batch.join(F.broadcast(before), F.expr(f"l_at < at - INTERVAL {delay}"))
             .select(F.col("l_id").alias("invoice_id"), F.col("l_at").alias("created_at"))
             .write.mode("overwrite").parquet(f"{base}/late/batch={number}"))

    drive(side("l"), late, f"{base}/side")
    drive(pairs, keep, f"{base}/join")
    found = spark.read.schema("invoice_id string, batch bigint").parquet(f"{base}/pairs").select("invoice_id").distinct()
    late_rows = "invoice_id string, created_at timestamp, batch bigint"
    try:
        behind = spark.read.schema(late_rows).parquet(f"{base}/late")
    except AnalysisException:                           # a single batch: no folder of late rows
        behind = spark.createDataFrame([], late_rows)
    return found, behind
