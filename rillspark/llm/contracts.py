"""Thin queries over whole tables: each applies one operator with its production parameters and shapes the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.llm import chat, licenses, media, mixing, orcids, packing, passages, quality, simhash, toxicity
from rillspark.llm.common import cut, documents, new_path, read

#: A text is predicted to be toxic from this score on.
TOXIC = 0.3
NAMES = ["op1_license_digests", "op2_factorization_machine", "op3_chunked_media", "op4_tokeniser_fertility", "op5_repeated_passages", "op6_chat_segments", "op8_sainte_lague_mix", "op7_orc_token_ids", "op9_hierarchical_packing", "op10_simhash_components"]
SQL: dict[str, str] = {"op1_license_digests": licenses.sql(), "op6_chat_segments": chat.sql(), "op8_sainte_lague_mix": mixing.SQL}


def op1_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(documents(spark, sf_dir))


def op8_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).documents.select("doc_id", "size", "source_size", "target", "taken", "shard")


def op2_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op3_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.write(documents(spark, sf_dir)))


def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(documents(spark, sf_dir))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(documents(spark, sf_dir)).drop("key")


def op6_chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    rows = rows.union(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema).coalesce(1))
    turns = cut(chat.format_turns(rows), "turns")
    checked = chat.conversations(turns).withColumnRenamed("conv_id", "its_id")
    return chat.digests(turns).join(checked, F.col("conv_id").eqNullSafe(F.col("its_id"))).drop("its_id")


def op7_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = new_path(spark, "token-ids")
    orcids.write_ids(documents(spark, sf_dir), to)
    return orcids.documents_of(orcids.read_ids(spark, to))


def op9_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))
