"""Training-corpus pipeline over ``documents``.

Five stages, each calling one operator of ``ledgerline.llm``; every stage's
result is written as Parquet and read back as the next one's documents. All
but the last return the columns of ``documents``.

1. language: rows whose language cannot be told (no letter, or hardly any
   confidence) go.
2. near_duplicates: of each SimHash component one row stays, that with the
   smallest name. A row is named by its doc_id. Of different rows with one
   doc_id the one whose columns have the smallest hash keeps that name; the
   others, and rows without a doc_id, are named after all doc_ids, by their
   hash. Of rows equal in all columns one stays.
3. repeats: bytes covered by 200-byte strings that also start elsewhere are cut
   out (a character cut in two goes too) and n_chars is set anew; rows of which
   nothing but white space is left go.
4. decontamination: rows that hold a benchmark passage go.
5. packing: one row for each sequence, with bucket and batch.

Empty tables pass all stages; repeated rows are treated as each operator says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, language, packing, simhash, suffix_dedup
from ledgerline.llm.common import unused, written
from ledgerline.sources.tables import read_table

MIN_SCORE = 0.2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.learn(docs), MIN_SCORE)


LATER = 1 << 62              # names of rows whose doc_id does not name them begin here


def named_rows(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a long that names each different row, in ``name``."""
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    shared = written(rows.where("doc_id is not null").groupBy("doc_id")
                     .agg(F.min("digest").alias("first"), F.max("digest").alias("last"))
                     .where("first <> last").select(F.col("doc_id").alias(name), F.col("first").alias(f"{name}_first")),
                     "shared-names")
    own, first = F.col("doc_id").cast("long"), F.lit(None).cast("long")
    joined = docs
    if not shared.isEmpty():
        joined, first = docs.join(shared, own == F.col(name), "left"), F.col(f"{name}_first")
    later = F.lit(LATER) + F.shiftrightunsigned(digest, 2)
    named = F.when(own.isNull() | (digest != first), later).otherwise(own)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], named.alias(name))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = unused(docs, "row_name")
    named = named_rows(docs, name)
    keep = (simhash.simhash_components(named, id_col=name).where("doc_id = component_id")
            .select(F.col("doc_id").alias(name)).distinct())
    return named.join(keep, name, "left_semi").dropDuplicates([name]).select([F.col(f"`{c}`") for c in docs.columns])


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.rewrite(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where(F.col("text").rlike(r"\S"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Suffix arrays, machines and token counts are beyond SQL; tests/llm/test_pipeline.py
# compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
