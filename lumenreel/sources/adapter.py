"""Ratings, catalog and requests made of the star-schema tables, so that every operator has data to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_title


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, movie_id, rating (1 to 5), ts and pos (the row's place in the file order)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return line.join(order, line.l_orderkey == order.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("movie_id"), (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("int").alias("rating"),
        F.col("o_orderdate").alias("ts"), ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("pos"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_index, movie_id, title, norm_title and genres."""
    words = F.split("p_name", " ")
    title = F.concat("p_name", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_index"), F.col("p_partkey").alias("movie_id"), title.alias("title"), normalize_title(title).alias("norm_title"),
        F.array_compact(F.array("p_type", F.get(words, F.lit(0)), F.get(words, F.lit(1)))).alias("genres"),
    )


def positives(spark: SparkSession, sf_dir: str, least: int = 4) -> DataFrame:
    """user_id, item_index, ts of ratings of at least least whose movie the catalog has."""
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("movie_id"))
    return ratings(spark, sf_dir).where(F.col("rating") >= least).join(known, "movie_id", "left_semi").select("user_id", F.col("movie_id").alias("item_index"), "ts")


#: The same three as SQL, for the checks.
SQL = """
ratings AS (SELECT o_custkey AS user_id, l_partkey AS movie_id, (floor((l_quantity - 1) / 10) + 1)::INT AS rating, o_orderdate AS ts, (l_orderkey * 100 + l_linenumber) * 10000000 + l_partkey AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
catalog AS (SELECT p_partkey AS item_index, p_partkey AS movie_id, p_name || ' (' || p_partkey::VARCHAR || ')' AS title,
  trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS norm_title, list_filter([p_type, string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]], lambda x: x IS NOT NULL) AS genres FROM part),
positives AS (SELECT user_id, movie_id AS item_index, ts FROM ratings WHERE rating >= 4 AND movie_id IN (SELECT movie_id FROM catalog))
"""
