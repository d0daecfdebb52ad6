"""The registered queries of this package, one an operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import bpe, hnsw, langid, licenses, lines, mixing, mpegts, phrases, pii, simhash, suffixes, turns, urls
from matchloom.llm.common import documents


def op1_mpeg_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.media_features(documents(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(documents(spark, sf_dir))


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op7_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_language_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_predictions(documents(spark, sf_dir))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


QUERIES = {name: f for name, f in sorted(globals().items(), key=lambda x: (len(x[0].split("_")[0]), x[0])) if name.startswith("op")}
ORACLE = {"op3_personal_data": pii.ORACLE, "op9_url_filter": urls.oracle(), "op10_source_mix": mixing.ORACLE, "op11_phrase_mining": phrases.ORACLE, "op12_conversation_repair": turns.ORACLE, "op13_license_scan": licenses.ORACLE}
