"""Ranking: top-k, masks, exclusions, title dedupe, diversity reranking, quota selection, rank changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import folders
from ..functions.text import clean_title_legacy, normalize_title
from ..shipping import ship


DIGITS = 9  # scores are rounded to so many places before they are ranked, so that ties are ties on every machine


def best_of_rows(scores: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """best_of() of every row, with one partition for all rows; rows that tie at the border or have few finite entries go singly."""
    n = scores.shape[1]
    if n <= k:
        return [best_of(line, k) for line in scores]
    cols = np.argpartition(-scores, k, axis=1)[:, : k + 1]
    cols.sort(axis=1)
    own = np.take_along_axis(scores, cols, axis=1)
    order = np.argsort(-own, axis=1, kind="stable")
    cols, own = np.take_along_axis(cols, order, axis=1), np.take_along_axis(own, order, axis=1)
    clear = np.isfinite(own[:, k - 1]) & (own[:, k - 1] > own[:, k])
    return [(cols[i, :k], own[i, :k]) if clear[i] else best_of(scores[i], k) for i in range(len(scores))]


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and scores of the k best finite entries, by score and then by column."""
    finite = int(np.isfinite(scores).sum())
    k = min(k, finite)
    if k == 0:
        return np.empty(0, np.int64), np.empty(0)
    border = -np.partition(-scores, k - 1)[k - 1]
    above = np.flatnonzero(scores >= border)
    order = np.lexsort((above, -scores[above]))[:k]
    return above[order], scores[above[order]]


def top_k(scores: DataFrame, k: int, by: str = "user_id", item: str = "item_index", score: str = "score") -> DataFrame:
    """The k best rows of each group with their rank; ties go to the smaller item. Partial limits run before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def best(scores: DataFrame, k: int, item: str = "item_index", score: str = "score") -> DataFrame:
    """The k best rows of a whole table, with rank and rank_label."""
    few = scores.orderBy(F.desc(score), item).limit(k)
    ranked = few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), item)))  # over k rows
    return ranked.withColumn("rank_label", F.concat(F.lit("Rank #"), F.col("rank").cast("string")))


def unseen(candidates: DataFrame, history: DataFrame) -> DataFrame:
    return candidates.join(history.select("user_id", "item_index"), ["user_id", "item_index"], "left_anti")


def placed(scored: DataFrame) -> DataFrame:
    """Adds place to item_index and score: 1, 2, ... by score, then by item. A row for each item passes through one task."""
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "item_index")).cast("long"))


def most_popular(history: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """user_id and the rows of items (item_index, score, place) in the first places, k more than the user has items.

    These hold every user's k best unseen items, and are as many as the history has rows and k for each user.
    """
    own = history.groupBy("user_id").agg(F.count("*").alias("own"))
    places = own.select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own") + k)).alias("place"))
    return places.join(items, "place").drop("place")


def rank_among_unseen(targets: DataFrame, history: DataFrame, items: DataFrame) -> DataFrame:
    """user_id, item_index and rank of a target among the items that its user has not seen; items: item_index, place."""
    place = items.select("item_index", "place")
    goals = targets.join(place, "item_index", "left")
    seen = history.join(place, "item_index").select("user_id", F.col("place").alias("seen_place"))
    before = goals.select("user_id", "item_index", "place").join(seen, "user_id").where("seen_place < place").groupBy("user_id", "item_index").agg(F.count("*").alias("before"))
    return goals.join(before, ["user_id", "item_index"], "left").select("user_id", "item_index", (F.col("place") - F.coalesce("before", F.lit(0))).alias("rank"))


def mask_seen(candidates: DataFrame, history: DataFrame, value: float = -13.815510557964274) -> DataFrame:
    """Seen items stay, at log(1e-6): what some older models did."""
    seen = history.select("user_id", "item_index").distinct().withColumn("_seen", F.lit(True))
    joined = candidates.join(seen, ["user_id", "item_index"], "left")
    return joined.withColumn("score", F.when(F.col("_seen"), F.lit(value)).otherwise(F.col("score"))).drop("_seen")


def without_genres(items: DataFrame, disliked: Column, separator: str | None = None) -> DataFrame:
    """Leaves out items with a disliked genre, whatever the case.

    With a separator, genres are taken as one string joined by a bar and cut there, as the older filter did.
    """
    own = F.col("genres") if separator is None else F.transform(F.split(F.array_join("genres", "|"), separator), F.trim)
    low = lambda a: F.transform(a, F.lower)
    return items.where(~F.coalesce(F.arrays_overlap(low(own), low(disliked)), F.lit(False)))


def without_titles(items: DataFrame, excluded: DataFrame) -> DataFrame:
    """Leaves out items (norm_title) that agree with an excluded title (title) when both are normalised."""
    return items.join(excluded.select(normalize_title(F.col("title")).alias("norm_title")).distinct(), "norm_title", "left_anti")


def genre_filter(catalog: DataFrame, genre: str, k: int) -> DataFrame:
    """The first k items with a genre that contains the text; the first k of the catalog where there is none."""
    rows = catalog.withColumn("hit", F.contains(F.lower(F.array_join("genres", "|")), F.lit(genre.lower())))
    some = rows.agg(F.max("hit").alias("some"))
    return rows.crossJoin(F.broadcast(some)).where(F.col("hit") | ~F.col("some")).orderBy("item_index").limit(k).select(*catalog.columns)  # some is one row


def liked_boost(catalog: DataFrame, liked: DataFrame) -> DataFrame:
    """query_id, item_id for each liked title (query_id, title) by the older title key; of equal keys the last item."""
    keys = catalog.groupBy(clean_title_legacy(F.col("title")).alias("key")).agg(F.max("item_index").alias("item_id"))
    return liked.select("query_id", clean_title_legacy(F.col("title")).alias("key")).join(keys, "key").select("query_id", "item_id")


def diversify(candidates: DataFrame, k: int = 10, penalty: float | tuple[float, ...] = 0.1, candidate_k: int = 50, by: str = "user_id") -> DataFrame:
    """Greedy maximal marginal relevance over genres: group, rank, item_index, and penalty if several are given.

    candidates: group, item_index, score, genres. The candidate_k best of a group are kept, relevance is the min-max of
    their scores, and each step takes the item with the best relevance less penalty times its largest Jaccard
    similarity to those taken; the first of equals wins. Similarities are made once for all penalties.
    """
    several = isinstance(penalty, tuple)
    penalties = penalty if isinstance(penalty, tuple) else (penalty,)
    few = top_k(candidates, candidate_k, by)
    rows = few.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "item_index", F.coalesce("genres", F.array().cast("array<string>")).alias("genres")))).alias("c"))
    flat = rows.select(by, F.col("c.score").alias("scores"), F.col("c.item_index").alias("items"), F.col("c.genres").alias("genres"))
    ship(flat.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                n = np.array([len(x) for x in part["items"]])
                wide = int(n.max())
                names = {g: i for i, g in enumerate(sorted({g for lists in part["genres"] for own in lists for g in own}))}
                has = np.zeros((len(part), wide, len(names)), dtype=np.float32)
                rel = np.full((len(part), wide), -np.inf)
                for u, (scores, lists) in enumerate(zip(part["scores"], part["genres"], strict=True)):
                    x = np.asarray(scores, dtype=np.float64)
                    span = x.max() - x.min()
                    rel[u, : n[u]] = (x - x.min()) / span if span > 1e-12 else 0.0
                    for i, own in enumerate(lists):
                        has[u, i, [names[g] for g in own]] = 1
                both = (has @ has.transpose(0, 2, 1)).astype(np.float64)  # counts, exact in either type
                sizes = has.sum(axis=2, dtype=np.float64)
                union = sizes[:, :, None] + sizes[:, None, :] - both
                near = np.divide(both, union, out=np.zeros(both.shape), where=union > 0)
                items, users = part["items"].tolist(), np.arange(len(part))
                for p in penalties:
                    open_, most, taken = rel.copy(), np.zeros((len(part), wide)), []
                    for _ in range(min(k, wide)):  # one more item of every user at each step
                        pick = np.argmax(open_ - p * most, axis=1)
                        taken.append(np.where(np.isfinite(open_[users, pick]), pick, -1))
                        open_[users, pick] = -np.inf
                        most = np.maximum(most, near[users, pick])
                    order = np.stack(taken, axis=1)
                    u, r = np.nonzero(order >= 0)
                    out = {by: part[by].to_numpy()[u], "rank": (r + 1).astype(np.int32), "item_index": np.array([items[x][y] for x, y in zip(u.tolist(), order[u, r].tolist(), strict=True)], dtype=np.int64)}
                    yield pd.DataFrame(out | ({"penalty": np.full(len(u), p)} if several else {}))

    kind = candidates.schema[by].dataType.simpleString()
    return flat.mapInPandas(run, f"`{by}` {kind}, rank int, item_index long" + (", penalty double" if several else ""))


def by_vote(items: DataFrame, vote: str = "vote_average", tie: str = "title") -> DataFrame:
    """Adds rank and rank_label ("Rank #n") by vote, descending, without votes last; ties by another column.

    Ranks come from range partitions and the counts before them, so no task orders all items.
    """
    order = [F.desc_nulls_last(vote), F.col(tie).asc_nulls_last()]
    ranged = items.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist()
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.withColumn("_base", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = (F.col("_base") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))).cast("int")
    return ranged.join(F.broadcast(before), "_part").withColumn("rank", rank).withColumn("rank_label", F.concat(F.lit("Rank #"), F.col("rank").cast("string"))).drop("_part", "_base")


def quota_selection(items: DataFrame, most: int = 10, wanted: int = 50) -> DataFrame:
    """Takes items by n (descending, ties by first_pos, then movie_id) unless one of their genres has most picks already; at most wanted.

    items: movie_id, title, genres, n, first_pos. A round takes the best items after the last one looked at that have
    no full genre, as many as are still wanted: they are all picked, or a genre gets full on the way. So rounds are at
    most one more than the genres that get full, and a round's rows are at most wanted; no task sees the whole catalog.
    """
    spark = items.sparkSession
    rows = folders.stored(items.select("movie_id", "title", F.coalesce("genres", F.array().cast("array<string>")).alias("genres"), "n", "first_pos"), "quota")
    taken: dict[str, int] = {}
    picked: list[tuple] = []
    left, last = rows, None
    while len(picked) < wanted:
        full = [g for g, n in taken.items() if n >= most]
        left = rows.where(~F.arrays_overlap("genres", F.array(*map(F.lit, full)))) if full else rows
        if last is not None:
            after = (F.col("n") == last["n"]) & ((F.col("first_pos") > last["first_pos"]) | ((F.col("first_pos") == last["first_pos"]) & (F.col("movie_id") > last["movie_id"])))
            left = left.where((F.col("n") < last["n"]) | after)
        asked = wanted - len(picked)
        best = left.orderBy(F.desc("n"), "first_pos", "movie_id").limit(asked).collect()
        for row in best:
            if all(taken.get(g, 0) < most for g in row["genres"]):
                picked.append((len(picked) + 1, row["movie_id"], row["title"], row["genres"]))
                for g in row["genres"]:
                    taken[g] = taken.get(g, 0) + 1
        if len(best) < asked:
            break
        last = best[-1]
    folders.discard(rows)
    kind = items.schema["movie_id"].dataType.simpleString()
    return spark.createDataFrame(picked, f"place int, movie_id {kind}, title string, genres array<string>")


def rank_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """title, the ranks in both lists, and how far it rose."""
    b, n = before.select("title", F.col("rank").alias("rank_before")), now.select("title", F.col("rank").alias("rank_now"))
    return b.join(n, "title").withColumn("rose", F.col("rank_before") - F.col("rank_now"))
