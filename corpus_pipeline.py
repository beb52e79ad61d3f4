"""The corpus pipeline: stages over documents, each on what the one before kept.

Toxic documents go; one document of each near-duplicate group stays; of a passage that documents share, one copy stays;
sources are mixed to their targets; the mix is packed into context windows. Each stage writes what it needs to cut its
lineage to the shared folder, and returns a DataFrame with the columns of documents, the last one pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillspark.llm import mixing, packing, passages, simhash, toxicity
from rillspark.llm.common import cut


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.without(docs, passages.repeated(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).drop("ids", "doc_row")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The toxicity fit, the chains and the tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
