"""Interactions, id maps, subset filters and the chronological leave-one-out split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PART = 250_000  # rows of users' items that a task counts genres of


def by_user(rows: DataFrame) -> DataFrame:
    """rows with each user's in one partition, as many partitions as the rows ask for, so that no task's groups grow with the input.

    rows are counted first, so they are read twice.
    """
    return rows.repartition(max(1, -(-rows.count() // PART)), "user_id")


def binary_matrix(positives: DataFrame) -> DataFrame:
    """The sparse binary matrix as rows (user_id, item_index)."""
    return positives.select("user_id", "item_index").distinct()


def last_rating_matrix(ratings: DataFrame) -> DataFrame:
    """Of each user and movie the rating that comes last in the file; of rows at one place the larger."""
    return ratings.groupBy("user_id", "movie_id").agg(F.max_by("rating", F.struct("pos", "rating")).alias("rating"))


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """A map of the different ids to 0, 1, ... in ascending order, without a single sorting task.

    Ids are range-partitioned; a partition's base is the prefix sum of the counts before it.
    """
    ids = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()).persist()
    sizes = ids.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    row = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    return ids.join(F.broadcast(base), "_part").select(column, (F.col("_base") + row - 1).cast("long").alias(name))


def frequent_items(ratings: DataFrame, least: int = 200, top: int = 4000) -> DataFrame:
    """The top movies by ratings among those with at least least; ties go to the smaller id."""
    counts = ratings.groupBy("movie_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "movie_id").limit(top)


def active_users(ratings: DataFrame, least: int = 30, top: int = 10_000) -> DataFrame:
    counts = ratings.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "user_id").limit(top)


def subset(ratings: DataFrame, least_item: int = 200, top_items: int = 4000, least_user: int = 30, top_users: int = 10_000) -> DataFrame:
    """Ratings of frequent movies by users who are active on them, with both ids dense. The order of the filters counts."""
    by_item = ratings.join(frequent_items(ratings, least_item, top_items), "movie_id", "left_semi")
    kept = by_item.join(active_users(by_item, least_user, top_users), "user_id", "left_semi")
    return kept.join(dense_ids(kept, "user_id", "new_user"), "user_id").join(dense_ids(kept, "movie_id", "new_movie"), "movie_id")


def remap(df: DataFrame, ids: DataFrame, column: str, name: str) -> DataFrame:
    """Rows whose id the map has, with the new id: for side tables such as movies and tags."""
    return df.join(ids, column).drop(column).withColumnRenamed(name, column)


def leave_one_out(positives: DataFrame, least: int = 5) -> DataFrame:
    """Adds is_target to the positives of users with at least least rows: the last by (ts, item_index) is held out."""
    user = Window.partitionBy("user_id")
    latest = user.orderBy(F.desc("ts"), F.desc("item_index"))
    rows = positives.withColumn("_n", F.count("*").over(user)).withColumn("_last", F.row_number().over(latest))
    return rows.where(F.col("_n") >= least).select("user_id", "item_index", "ts", (F.col("_last") == 1).alias("is_target"))


def targets_of(split: DataFrame) -> DataFrame:
    return split.where("is_target").select("user_id", F.col("item_index").alias("target"))


def history_of(split: DataFrame) -> DataFrame:
    return split.where(~F.col("is_target")).select("user_id", "item_index").distinct()


def shuffle_key(user: Column, seed: int) -> Column:
    """A key that puts users in a fixed random order, the same on every engine."""
    return F.md5(F.concat(user.cast("string"), F.lit(str(seed))).cast("binary"))


def validation_users(users: DataFrame, seed: int = 2026, max_users: int | None = None) -> DataFrame:
    """user_id and is_validation: in shuffled order the first max(1, n // 5) users.

    The border is found as a quantile of the keys' prefixes and settled among the users that share the border's prefix,
    so no task sorts all users.
    """
    keyed = users.select("user_id", shuffle_key(F.col("user_id"), seed).alias("key"))
    if max_users is not None:
        keyed = keyed.orderBy("key").limit(max_users)
    bins = keyed.groupBy(F.substring("key", 1, 4).alias("bin")).agg(F.count("*").alias("n"))  # 65,536 rows at most
    run = Window.orderBy("bin")
    sums = bins.withColumn("before", F.sum("n").over(run) - F.col("n")).withColumn("goal", F.greatest(F.lit(1), F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) / 5)))
    placed = keyed.withColumn("bin", F.substring("key", 1, 4)).join(F.broadcast(sums), "bin")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("key", "user_id"))
    return placed.select("user_id", (rank <= F.col("goal")).alias("is_validation"))


def permuted_users(user_ids: list[int], seed: int = 2026, max_users: int | None = None) -> list[int]:
    """The order that a PCG64 generator with this seed gives ascending ids: for runs that must repeat one bit for bit."""
    import numpy as np

    ids = np.array(sorted(user_ids))
    np.random.default_rng(seed).shuffle(ids)
    return ids[:max_users].tolist()


def lookup_variants(requests: DataFrame, saved: DataFrame, limit: int = 3, chars: int = 800) -> DataFrame:
    """For requests (id, keys array<int>) the first saved texts of their keys, joined by a space and cut.

    Saved keys may be written 12 or 12.0; the plain form comes first.
    """
    known = saved.select(F.col("key").try_cast("double").alias("number"), F.struct(F.length("key").alias("n"), F.col("summary").alias("text")).alias("s"))
    first = known.where("number IS NOT NULL").groupBy("number").agg(F.min("s").alias("s"))
    asked = requests.select("id", F.posexplode("keys").alias("pos", "key")).withColumn("number", F.col("key").cast("double"))
    found = asked.join(first, "number").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("s.text").alias("text")))).alias("texts"))
    text = F.substring(F.array_join(F.slice(F.col("texts.text"), 1, limit), " "), 1, chars)
    return requests.join(found, "id", "left").select("id", F.coalesce(text, F.lit("")).alias("summary"))
