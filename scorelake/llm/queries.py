"""One query per operator, ``(spark, sf_dir) -> DataFrame``, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import (chat, decontamination, fill_in_middle, hard_negatives, language, language_model, packing, secrets, simhash, substring_dedup, token_store, url_filter,
                           vector_neighbours)
from scorelake.llm.common import documents


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs).select("doc_id", language.held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return decontamination.report(found)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(documents(spark, sf_dir, "pages"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neighbours.near_duplicates(documents(spark, sf_dir, "embeddings"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.write_and_read_back(turns.unionByName(more))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_store(spark, token_store.write_store(documents(spark, sf_dir)), with_ids=False)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.transform(documents(spark, sf_dir).select("doc_id", "text")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language, op2_substrings, op3_decontamination, op4_urls, op5_vectors, op6_chat, op7_secrets, op8_simhash, op9_token_store, op10_packing,
                                   op11_fill_in_middle, op12_hard_negatives, op13_language_model)}
ORACLES = {"op4_urls": url_filter.oracle_sql(), "op11_fill_in_middle": fill_in_middle.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL}
