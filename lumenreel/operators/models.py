"""Scoring models: popularity, genre content, item similarity, hybrid, linear autoencoder, embedding cosine.

Models that relate items to items are tables. Lists of users are made in Arrow batches of users against the item side,
whose files in the shared folder tasks read; neither users nor items are gathered, and the work grows with users over
tasks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import folders
from ..shipping import ship
from . import interactions, linear
from .itemside import Items, ItemSide, portions, similar_to
from .ranking import DIGITS, top_k

HEAVY = 2000  # items of a user that meet under one key
PAIRS = 1_000_000  # pairs of items that a task makes and counts
OPEN = 16  # signatures' lists that are read first


def min_max(column: str, window: Window) -> F.Column:
    low, high = F.min(column).over(window), F.max(column).over(window)
    return F.when(high - low > 1e-12, (F.col(column) - low) / (high - low)).otherwise(F.lit(0.0))


def popularity(history: DataFrame, catalog: DataFrame) -> DataFrame:
    """item_index, n (users) and popularity: min-max of log(1 + n) over the whole catalog."""
    counts = history.groupBy("item_index").agg(F.countDistinct("user_id").alias("n"))
    rows = catalog.select("item_index").join(counts, "item_index", "left").select("item_index", F.coalesce("n", F.lit(0)).alias("n"))
    logs = rows.withColumn("log_n", F.log1p(F.col("n").cast("double")))
    ends = logs.agg(F.min("log_n").alias("low"), F.max("log_n").alias("high"))
    scaled = F.when(F.col("high") - F.col("low") > 1e-12, (F.col("log_n") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    return logs.crossJoin(F.broadcast(ends)).select("item_index", "n", scaled.alias("popularity"))  # ends is one row


def _parts(rows: DataFrame) -> int:
    """How many tasks make the pairs of users' items, PAIRS each or those of one user."""
    n = F.col("n").cast("double")
    pairs = rows.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0]
    return max(1, math.ceil((pairs or 0) / PAIRS))


def _pairs(history: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """item_i < item_j, the number of users who have both, and the items' extra columns (extra_i, extra_j).

    A user with over HEAVY items is cut into parts by a hash of the item, and each pair of parts meets under a key of
    its own, so no key holds more than about HEAVY items of either side. Other users meet by their id alone. Pairs are
    counted where they are made, so the tasks are as many as the pairs ask for, not the rows. history is read twice.
    """
    parts = _parts(history)
    rows = history.select("user_id", "item_index", *extra).repartition(parts, "user_id")
    side = lambda df, c: df.withColumnsRenamed({"item_index": f"item_{c}", **{x: f"{x}_{c}" for x in extra}})
    columns = ["item_i", "item_j", *[f"{x}_{c}" for x in extra for c in "ij"]]
    heavy = rows.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("user_id", F.ceil(F.col("n") / HEAVY).cast("int").alias("parts"))
    light = rows.join(heavy, "user_id", "left_anti")
    met = side(light, "i").join(side(light, "j"), "user_id").where("item_i < item_j").select(*columns)
    dealt = rows.join(heavy, "user_id").withColumn("part", F.pmod(F.xxhash64("item_index"), F.col("parts")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    keys = ["user_id", "row", "col"]
    x = side(dealt, "i").withColumns({"row": F.col("part"), "col": each}).repartition(parts, *keys)
    y = side(dealt, "j").withColumns({"col": F.col("part"), "row": each}).repartition(parts, *keys)
    cut = x.drop("part", "parts").join(y.drop("part", "parts"), keys).where("item_i < item_j").select(*columns)
    return met.unionByName(cut).groupBy(*columns).agg(F.count("*").alias("n"))


def cooccurrence(history: DataFrame) -> DataFrame:
    """item_i < item_j and the number of users who have both."""
    return _pairs(history)


def item_similarity(history: DataFrame, alpha: float = 0.5, shrinkage: float = 0.0) -> DataFrame:
    """item_i, item_j and sim for both orders: c * n_i^-alpha * n_j^-(1 - alpha), times c / (c + shrinkage).

    An item's count goes with it through the pairs, so the pairs are not dealt out again for it.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    if shrinkage < 0:
        raise ValueError("shrinkage is not negative")
    counts = history.groupBy("item_index").agg(F.count("*").cast("double").alias("c"))
    half = _pairs(history.select("user_id", "item_index").join(counts, "item_index"), ("c",))
    both = half.unionByName(half.select(F.col("item_j").alias("item_i"), F.col("item_i").alias("item_j"), F.col("c_j").alias("c_i"), F.col("c_i").alias("c_j"), "n"))
    c = F.col("n").cast("double")
    sim = c * F.pow("c_i", F.lit(-alpha)) * F.pow("c_j", F.lit(-(1 - alpha)))
    if shrinkage:
        sim = sim * c / (c + F.lit(float(shrinkage)))
    return both.select("item_i", "item_j", sim.alias("sim"))


def genre_proportions(history: DataFrame, catalog: DataFrame) -> DataFrame:
    """user_id, genre and its share of the genres of the user's items; users without genres have no row."""
    rows = interactions.by_user(history.join(catalog.select("item_index", "genres"), "item_index").select("user_id", "genres")).select("user_id", F.explode("genres").alias("genre"))
    counts = rows.groupBy("user_id", "genre").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).select("user_id", "genre", "share")


def collaborative(history: DataFrame, side: ItemSide) -> DataFrame:
    """user_id, item_index and score: the sparse product of profiles and the side's similar items.

    A task reads the similar items of its users' items, so neither these nor their sums are dealt out.
    """
    items = side.items
    ship(history.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = items.whole("items")
        for batch in batches:
            users, profiles = batch.user_id.to_numpy(), [np.asarray(p) for p in batch["places"]]
            for part in portions(items, profiles):
                owner, place, sums = similar_to(items, profiles[part])
                yield pd.DataFrame({"user_id": users[part][owner], "item_index": ids[place].astype(np.int64), "score": sums})

    return side.profiles(history).mapInPandas(run, "user_id long, item_index long, score double")


@dataclass(frozen=True)
class Weights:
    """Weights of the hybrid; the defaults are fixed values."""

    collaborative: float = 0.80
    content: float = 0.15
    popularity: float = 0.05

    def normalized(self) -> Weights:
        total = self.collaborative + self.content + self.popularity
        if total <= 0:
            raise ValueError("one weight at least must be positive")
        return Weights(self.collaborative / total, self.content / total, self.popularity / total)


#: The 27 weights that a search tries (fixed values).
GRID = [Weights(a, b, c) for a in (0.6, 0.8, 1.0) for b in (0.0, 0.15, 0.3) for c in (0.0, 0.05, 0.1)]


@dataclass(frozen=True)
class Blend:
    """Raw content (the share of the user's genres that an item has) and popularity, over items that share a genre."""

    content: float
    popularity: float


class _Lists:
    """The catalog as lists of a genre signature's items, by popularity and by id; read from the item side's files."""

    def __init__(self, items: Items):
        # Places are in the order of signatures, so that a signature's items lie together; genres are kept by signature.
        n, wide = items.n, len(items.genres)
        self.items, self.popularity, self.of = np.empty(n, np.int64), np.empty(n), np.empty(n, np.int32)
        starts, kinds, at, last = [np.empty(0, np.int64)], [np.empty((0, wide))], 0, None
        for path in items.blocks:
            block = folders.read_arrays(path, keep=False)
            has = block["has"].reshape(len(block["items"]), wide)
            new = np.append(last is None or (has[0] != last).any(), (has[1:] != has[:-1]).any(axis=1))
            upto = at + len(has)
            self.items[at:upto], self.popularity[at:upto] = block["items"], block["popularity"]
            self.of[at:upto] = sum(map(len, starts)) + np.cumsum(new) - 1
            starts.append(at + np.flatnonzero(new))
            kinds.append(has[new].astype(np.float64))
            at, last = upto, has[-1].copy()
        self.starts, self.has = np.concatenate(starts), np.concatenate(kinds)
        self.ends = np.append(self.starts[1:], n).astype(np.int64)
        self.by_item = np.lexsort((self.items, self.of)).astype(np.int32)
        self.seen = np.zeros(n, bool)
        self.side, self.title, self.by_title = items, None, None

    def titles(self) -> np.ndarray:
        """The titles' hashes by place, read when they are first asked for."""
        if self.title is None:
            self.title = self.side.whole("title").astype(np.int64)
            self.by_title = np.argsort(self.title, kind="stable").astype(np.int32)
        return self.title

    def titled(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the items that have one of the titles."""
        title = self.titles()
        low, high = (np.searchsorted(title, hashes, side, sorter=self.by_title) for side in ("left", "right"))
        return np.concatenate([np.empty(0, np.int32), *[self.by_title[a:b] for a, b in zip(low, high, strict=True)]])

    def best(self, const: np.ndarray, weight: float, lists: np.ndarray, own: np.ndarray, first: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best: const of the signature and weight times popularity, for items but own.

        The threshold algorithm: signatures' lists (those of lists) are read k items at a time, best first, as long as
        the next item of a list could still be among the k best; first has places and scores that are known already.
        The lists whose next items are ahead are read first, OPEN of them and then twice as many each time, since few
        lists have any of the k best.
        """
        places, scores = [first[0]], [first[1]]
        order = None if weight else self.by_item
        at, taken, need, last, width = self.starts[lists].copy(), np.zeros(len(lists), np.int64), -np.inf, None, OPEN
        const, ends = const[lists], self.ends[lists]
        self.seen[own] = True
        while True:
            left = np.flatnonzero((at < ends) & (taken < k))
            head = at[left] if order is None else order[at[left]]
            ahead = np.round(const[left] + weight * self.popularity[head], DIGITS) + 0.0
            may = ahead >= need
            if last is not None and order is not None:  # a list's items ascend: of equal scores the larger ones are out of it
                may &= (ahead > need) | (self.items[head] < last)
            left, head, ahead = left[may], head[may], ahead[may]
            if not len(left):
                break
            open_ = left if len(left) <= width else left[np.lexsort((self.items[head], -ahead))[:width]]
            width *= 2
            rows = at[open_, None] + np.arange(k)
            there = rows < ends[open_, None]
            rows = np.minimum(rows, len(self.items) - 1)
            rows = rows if order is None else order[rows]
            fine = there & ~self.seen[rows]
            total = np.round(const[open_, None] + weight * self.popularity[rows], DIGITS) + 0.0
            places.append(rows[fine])
            scores.append(total[fine])
            taken[open_] += fine.sum(axis=1)
            at[open_] += k
            every = np.concatenate(scores)
            if len(every) >= k:
                need = -np.partition(-every, k - 1)[k - 1]
                if order is not None:  # the largest item of the k best that has their last score
                    tied = np.sort(self.items[np.concatenate(places)[every == need].astype(np.int64)])
                    last = tied[k - 1 - int((every > need).sum())]
        self.seen[own] = False
        place, score = np.concatenate(places).astype(np.int64), np.concatenate(scores)
        near = np.flatnonzero(score >= need)
        pick = near[np.lexsort((self.items[place[near]], -score[near]))[:k]]
        return place[pick], score[pick]


_lists: dict[str, _Lists] = {}


def lists_of(items: Items) -> _Lists:
    if items.folder not in _lists:
        _lists.clear()  # a worker keeps one
        _lists[items.folder] = _Lists(items)
    return _lists[items.folder]


def _scaled(values: np.ndarray, low: float, high: float) -> np.ndarray:
    return (values - low) / (high - low) if high - low > 1e-12 else np.zeros(len(values))


def recommend_users(history: DataFrame, side: ItemSide, models: dict[str, Weights | Blend | str], k: int = 10, weights: linear.Weights | None = None) -> DataFrame:
    """model, user_id, rank, item_index and score: the k best unseen items of each user under each model.

    A model is weights of the hybrid, a blend, or "ease" for the linear autoencoder, whose weights are given. A user's
    scores are made for the items that its items are similar to, and for as much of the signatures' lists as the k
    best can come from; no user meets the whole catalog. Those of the linear autoencoder, which no item is without, are
    made by blocks of items, and the k best of each block meet.
    """
    spark, parts = history.sparkSession, []
    ship(spark)
    mixed = {name: m.normalized() if isinstance(m, Weights) else m for name, m in models.items() if not isinstance(m, str)}
    if mixed:
        items = side.items
        similar = any(isinstance(m, Weights) and m.collaborative for m in mixed.values())

        def answered(users: np.ndarray, profiles: list[np.ndarray]) -> pd.DataFrame:
            lists = lists_of(items)
            owner, place, sums = similar_to(items, profiles if similar else [])
            cuts = np.searchsorted(owner, np.arange(len(profiles) + 1))
            genres = np.stack([lists.has[np.unique(lists.of[p])].any(axis=0) for p in profiles]).astype(np.float64)
            raw = genres @ lists.has.T / np.maximum(genres.sum(axis=1, keepdims=True), 1)
            out: list[tuple[str, int, np.ndarray, np.ndarray]] = []
            for u, own in enumerate(profiles):
                near, sim = place[cuts[u] : cuts[u + 1]], sums[cuts[u] : cuts[u + 1]]
                rest = [0.0] if len(near) < items.n else []
                low, high = min([*sim[:1], *rest, *([sim.min()] if len(sim) else [])]), max([*rest, *([sim.max()] if len(sim) else [])])
                cf, none = _scaled(sim, low, high), float(_scaled(np.zeros(1), low, high)[0])
                content = _scaled(raw[u], raw[u].min(), raw[u].max())
                unseen = ~np.isin(near, own)
                for name, m in mixed.items():
                    if isinstance(m, Blend):
                        const, some, first, known = m.content * raw[u], np.flatnonzero(raw[u] > 0), (near[:0], sim[:0]), own
                    elif m.collaborative:
                        scored = np.round(m.collaborative * cf + m.content * content[lists.of[near]] + m.popularity * lists.popularity[near], DIGITS) + 0.0
                        const, some = m.collaborative * none + m.content * content, np.arange(len(content))
                        first, known = (near[unseen], scored[unseen]), np.concatenate([own, near])
                    else:
                        const, some, first, known = m.content * content, np.arange(len(content)), (near[:0], sim[:0]), own
                    out.append((name, users[u], *lists.best(const, m.popularity, some, known, first, k)))
            n = [len(o[2]) for o in out]
            return pd.DataFrame({
                "model": np.repeat(np.array([o[0] for o in out], dtype=object), n), "user_id": np.repeat(np.array([o[1] for o in out]), n), "rank": np.concatenate([np.arange(1, c + 1, dtype=np.int32) for c in n]),
                "item_index": lists.items[np.concatenate([o[2] for o in out])], "score": np.concatenate([o[3] for o in out]),
            })

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for begin in range(0, len(batch), 256):
                    some = [np.asarray(p) for p in batch["places"].iloc[begin : begin + 256]]
                    for part in portions(items, some) if similar else [slice(0, len(some))]:
                        yield answered(batch.user_id.to_numpy()[begin : begin + 256][part], some[part])

        parts.append(side.profiles(history).mapInPandas(run, "model string, user_id long, rank int, item_index long, score double"))
    for name in (name for name, m in models.items() if isinstance(m, str)):
        if weights is None:
            raise ValueError("a model of the linear autoencoder needs its weights")
        best = top_k(linear.recommend(history, side, weights, k), k)
        parts.append(best.select(F.lit(name).alias("model"), "user_id", "rank", "item_index", "score"))
    return functools.reduce(lambda x, y: x.unionByName(y), parts)
