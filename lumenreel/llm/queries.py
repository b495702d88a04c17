"""The registered query of each operator, over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_output, centroids, conversations, langid, media, minhash, mixing, packing, search, simhash, substrings, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spark, _table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(spark, _table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(spark, _table(spark, sf_dir, "documents")).withColumn("wanted", F.round("wanted", 9))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(spark, _table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(spark, _table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, _table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.token_output(spark, _table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_conversations(spark, _table(spark, sf_dir, "conversations"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered_vectors(spark, _table(spark, sf_dir, "embeddings"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_substring_dedup, op3_toxicity, op4_source_mixing, op5_simhash_dedup, op6_topk_search, op7_packing, op8_media_columns, op9_language_id, op10_token_output, op11_conversation_repair, op12_centroid_clustering, op13_minhash_dedup)}
ORACLE_SQL: dict[str, str] = {"op1_url_filter": urls.ORACLE_SQL, "op2_substring_dedup": substrings.ORACLE_SQL, "op4_source_mixing": mixing.ORACLE_SQL, "op6_topk_search": search.ORACLE_SQL, "op11_conversation_repair": conversations.ORACLE_SQL, "op12_centroid_clustering": centroids.ORACLE_SQL}
