"""The corpus pipeline: quality rules, line dedup, near-duplicates, source mix, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.
All but the last return the columns of docs; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebar.llm import jaccard, line_templates, packing, quality_rules, source_mix
from tidebar.llm.common import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality_rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, all but the first; a document of which nothing is left goes."""
    return line_templates.without_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (SimHash, then exact: five-word shingles, Jaccard 0.8 or more) stays, the one with the smallest doc_id."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights; a document stands as often as it is taken."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return source_mix.mixed_documents(docs, source_mix.label_weights(labels))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near-duplicates", near_dedup), ("source mix", mix), ("packing", pack)]

# XXH64 of the fingerprints and the tokenizer of the packing are not in SQL; tests compare run() with a brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
