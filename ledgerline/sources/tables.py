"""Reading the input tables (one parquet dataset per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan one table; naming the columns keeps the parquet ReadSchema narrow."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Already-extracted document text, one row per file (A2 input)."""
    return (spark.read.text(path, wholetext=True)
            .selectExpr("_metadata.file_name AS filename", "value AS raw_text"))
