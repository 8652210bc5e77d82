"""A corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

Quality rules drop rejected documents, exact and near-duplicate removal keep one of
each group, mixing orders (and repeats) documents by a curriculum, packing places
their tokens in sequences.

Defined cases, beyond those of the operators. Null and empty texts, and texts of white space, go with the quality rules, so that
no later stage sees them. Duplicates are decided by row: a row goes if its text is an equal or near copy of one that stays, and never because another row has its doc_id; of
each group the smallest doc_id stays (in exact removal after the longest text), rows without a doc_id after all others. A very long text is one document all the way; packing cuts it. An empty table gives an
empty result with the same columns. Other columns, whatever their names, pass through to the last stage, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motionloom.llm import common, exact, mixing, packing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return common.compact(packing.pack(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; what each returns is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, f"stage-{k}", short=False)
    return docs


#: Tokenising and SimHash are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
