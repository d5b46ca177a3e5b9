"""A4/A6 on a stored ledger: a merge rewrites only the buckets it touches.

Rows lie in folders ``data/merge=<name>/bucket=<number>``; ``commits`` holds a
row (seq, merge, bucket) for each bucket a merge wrote. The newest commit of a
bucket says where its rows are, so files are never changed: a reader sees all
of a merge or nothing of it, and one that failed can run again under its name.
Folders that no newest commit names are left for the owner to remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import EXCHANGES_DROPPED, settings
from .registry import upsert

BUCKETS = 256  # fixed when a ledger is created; more for a larger one


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """With the row's bucket; a NULL key has bucket 0."""
    return df.withColumn("bucket", F.coalesce(F.pmod(F.xxhash64(key), F.lit(buckets)), F.lit(0)).cast("int"))


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seq long, merge string, bucket int, buckets int").parquet(f"{path}/commits")


def _places(spark: SparkSession, path: str) -> list:
    """The newest commit of each bucket: at most as many rows as buckets."""
    return (_commits(spark, path).groupBy("bucket").agg(
        F.max_by("merge", "seq").alias("merge"), F.max("seq").alias("seq"), F.max("buckets").alias("buckets")).collect())


def _write(rows: DataFrame, path: str, merge: str, seq: int, touched: list[int], buckets: int) -> None:
    with settings(rows.sparkSession, EXCHANGES_DROPPED):
        (rows.hint("rebalance", "bucket").write.option("compression", "zstd").mode("overwrite").partitionBy("bucket")
         .parquet(f"{path}/data/merge={merge}"))
    # one small file that appears whole: the commit
    (rows.sparkSession.createDataFrame([(seq, merge, b, buckets) for b in touched],
                                       "seq long, merge string, bucket int, buckets int")
     .coalesce(1).write.mode("append").parquet(f"{path}/commits"))


def create_ledger(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A new ledger; every bucket has a commit, empty ones too."""
    _write(_bucketed(rows, key, buckets), path, "created", 0, list(range(buckets)), buckets)


def _read(spark: SparkSession, path: str, places: list, schema) -> DataFrame:
    """Rows of the given places; merges read together, other folders are not listed."""
    at: dict[str, list[int]] = {}
    for p in places:
        at.setdefault(p.merge, []).append(p.bucket)
    out = spark.createDataFrame([], schema)
    for merge, numbers in sorted(at.items()):
        part = spark.read.schema(schema).parquet(f"{path}/data/merge={merge}").where(F.col("bucket").isin(numbers))
        out = out.unionByName(part)
    return out


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows as of now."""
    schema = spark.read.parquet(f"{path}/data/merge=created").schema
    return _read(spark, path, _places(spark, path), schema).drop("bucket")


def merge_ledger(new: DataFrame, path: str, key: str, merge: str, how=upsert) -> int:
    """Merge ``new`` (one row a key) into the ledger; ``how(old, new, key)``
    gives the rows after it, ``upsert`` by default. Reads and writes the touched
    buckets only and returns their number. A merge whose name is committed is
    not done again."""
    spark = new.sparkSession
    if not _commits(spark, path).where(F.col("merge") == merge).isEmpty():
        return 0
    places = _places(spark, path)
    buckets = places[0].buckets
    new = _bucketed(new, key, buckets)
    touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
    if not touched:
        return 0
    schema = spark.read.parquet(f"{path}/data/merge=created").schema
    old = _read(spark, path, [p for p in places if p.bucket in touched], schema)
    after = how(old.drop("bucket"), new.drop("bucket"), key).select(*[c for c in schema.names if c != "bucket"])
    _write(_bucketed(after, key, buckets), path, merge, max(p.seq for p in places) + 1, sorted(touched), buckets)
    return len(touched)
