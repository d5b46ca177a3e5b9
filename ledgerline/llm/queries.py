"""The named queries over whole tables, with the DuckDB SQL where SQL can say
the same. Each returns the digest columns of its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources.tables import read_table

from . import (best_fit, cascade, collocations, conversation, decontaminate, language, packing, quality_rules_model, recompression, simhash,
               suffix_dedup, token_count, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by the sparse rule ensemble."""
    return quality_rules_model.quality(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                                       read_table(spark, sf_dir, "labels", "doc_id", "quality"))


@register
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents: family, then language."""
    return language.language_id(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@register
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages found in the documents, with their edits."""
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                                      read_table(spark, sf_dir, "benchmark", "item_id", "text"))


@register
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of all documents after removal of repeated 50-word windows."""
    return recompression.remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@register
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of all documents after removal of repeated 200-byte strings."""
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


@register
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents (3-word shingles, 3 bits)."""
    return simhash.simhash_components(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@register
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences in optimal length buckets, batched."""
    return packing.pack(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@register
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the rule cascade for all documents."""
    return cascade.judge(read_table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLES["op8_quality_rules"] = cascade.ORACLE


@register
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by byte_bpe_50k.json."""
    counts = token_count.token_counts(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return counts.withColumn("over_limit", counts.n_tokens > 1024)


@register
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by the weighted lexicon."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                             read_table(spark, sf_dir, "labels", "doc_id", "toxic"))


@register
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all conversations, after the damage."""
    return conversation.repair(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@register
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two and three words of each language."""
    return collocations.mine(read_table(spark, sf_dir, "documents", "text", "lang"))


ORACLES["op12_collocations"] = collocations.ORACLE


@register
def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces packed into few sequences of 4096."""
    return best_fit.pack(read_table(spark, sf_dir, "documents", "doc_id", "text"))
