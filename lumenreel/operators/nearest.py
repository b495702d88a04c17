"""Exact cosine neighbours over a clustered index: clusters are visited by their bounds and most are never read.

Items are clustered once, each task its own: pivots (a bounded number of items, drawn by a hash) go to all tasks, an item
joins the pivot nearest to it, and a task writes its clusters one after another into a file, with each cluster's mean
direction and the largest angle to it. The cosine of a query with anything in a cluster is at most that of its angle to
the mean less the cluster's. Tasks of queries go through the files; of a file only centroids are read first, and then the
clusters whose bound reaches the k-th score that a query of the batch has so far.

Nulls and NaN in vectors are 0; vectors of length 0 have cosine 0 with all. Scores are rounded, ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import folders
from ..shipping import ship
from .ranking import DIGITS

PIVOTS = 256  # clusters of a file at most
ROWS = 65_536  # items of a file at most
BATCH = 256  # queries that go through the files together


def unit(vectors: list, size: int | None = None) -> np.ndarray:
    """Rows of length 1 (or 0), with nulls and NaN as 0."""
    if not len(vectors):
        return np.zeros((0, size or 0))
    x = np.nan_to_num(np.array([[np.nan if v is None else v for v in row] if isinstance(row, list) else row for row in vectors], dtype=np.float64).reshape(len(vectors), -1), posinf=0.0, neginf=0.0)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Index:
    files: list[tuple[str, str]]  # of each part: centroids and the like, and the vectors
    genres: list[str]
    folder: str


def build(items: DataFrame, pivots: int = PIVOTS, rows: int = ROWS) -> Index:
    """An index of items (item_id, embedding, and genres if queries may ban some)."""
    spark = items.sparkSession
    ship(spark)
    folder, kinds = folders.new(spark, "index"), "genres" in items.columns
    own = items.select("item_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), *(["genres"] if kinds else [])).where("embedding IS NOT NULL")
    clean = F.lower(F.trim("g"))
    names = [r[0] for r in own.select(F.explode("genres").alias("g")).select(clean.alias("g")).where("g IS NOT NULL").distinct().orderBy("g").collect()] if kinds else []  # genres of a catalog
    drawn = own.orderBy(F.xxhash64("item_id", F.lit("pivot")), "item_id").select("embedding").limit(pivots).collect()
    middle = unit([r["embedding"] for r in drawn])
    at = {g: i for i, g in enumerate(names)}

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), rows):
                part = batch.iloc[begin : begin + rows]
                v = unit(part.embedding.to_list())
                cluster = (v @ middle.T).argmax(axis=1)
                order = np.lexsort((part.item_id.to_numpy(), cluster))
                v, cluster, ids = v[order], cluster[order], part.item_id.to_numpy()[order]
                starts = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
                ends = np.append(starts[1:], len(v))
                means = unit(list(np.add.reduceat(v, starts, axis=0)))
                angle = np.arccos(np.clip(np.einsum("ij,ij->i", v, np.repeat(means, ends - starts, axis=0)), -1, 1))
                angle[~v.any(axis=1)] = np.pi  # a vector of length 0 may score above its neighbours
                has = np.zeros((len(v), len(at)), np.uint8)
                if kinds:
                    for row, genres in enumerate(part["genres"].iloc[order]):
                        has[row, [at[g.strip().lower()] for g in genres if g is not None] if genres is not None else []] = 1
                head = folders.write_arrays(folder, ids=ids, starts=starts, ends=ends, means=means, widest=np.maximum.reduceat(angle, starts), has=has)
                yield pd.DataFrame({"head": [head], "data": [folders.write_bytes(folder, np.ascontiguousarray(v).tobytes())]})

    found = own.mapInPandas(write, "head string, data string").collect()  # a row for each file
    return Index(sorted((r["head"], r["data"]) for r in found), names, folder)


def search(queries: DataFrame, index: Index, k: int = 10, banned: DataFrame | None = None) -> DataFrame:
    """query_id, item_id and score of the k best items of each query, with the clusters that its batch has read and all there are.

    banned: query_id and genre; items of these genres, whatever their case, are left out.
    """
    ship(queries.sparkSession)
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    if banned is None:
        rows = rows.withColumn("banned", F.array().cast("array<string>"))
    else:
        out = banned.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.collect_set(F.lower(F.trim("genre"))).alias("banned"))
        rows = rows.join(out, "query_id", "left")
    at = {g: i for i, g in enumerate(index.genres)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), BATCH):
                part = batch.iloc[begin : begin + BATCH]
                q = unit(part.embedding.to_list())
                out = np.zeros((len(part), len(at)), np.uint8)
                for row, genres in enumerate(part.banned):
                    out[row, [at[g] for g in genres if g in at] if genres is not None else []] = 1
                best, of, need = np.empty((len(part), 0)), np.empty((len(part), 0), np.int64), np.full(len(part), -np.inf)
                read, every = 0, 0
                for head, data in index.files:
                    h = folders.read_arrays(head)
                    apart = np.arccos(np.clip(q @ h["means"].T, -1, 1)) - h["widest"]
                    bound = np.cos(np.maximum(apart, 0)) + 1e-7
                    every += len(h["starts"])
                    for c in np.argsort(-bound.max(axis=0), kind="stable").tolist():
                        asking = np.flatnonzero(bound[:, c] >= need)
                        if not len(asking):
                            continue
                        read += 1
                        s, e = int(h["starts"][c]), int(h["ends"][c])
                        v = np.frombuffer(folders.read_range(data, s * q.shape[1] * 8, (e - s) * q.shape[1] * 8)).reshape(e - s, -1)
                        scores = np.full((len(part), e - s), -np.inf)
                        scores[asking] = np.round(q[asking] @ v.T, DIGITS) + 0.0
                        scores[(out @ h["has"][s:e].T) > 0] = -np.inf
                        best, of = np.hstack([best, scores]), np.hstack([of, np.broadcast_to(h["ids"][s:e], scores.shape)])
                        if best.shape[1] > k:
                            order = np.lexsort((of, -best), axis=1)[:, :k]
                            best, of = np.take_along_axis(best, order, axis=1), np.take_along_axis(of, order, axis=1)
                            need = best[:, -1]
                row, col = np.nonzero(np.isfinite(best))
                yield pd.DataFrame({"query_id": part.query_id.to_numpy()[row], "item_id": of[row, col], "score": best[row, col], "clusters_read": read, "clusters": every})

    spread = rows.repartition("query_id")
    return spread.mapInPandas(run, "query_id long, item_id long, score double, clusters_read long, clusters long")


def top_k(queries: DataFrame, items: DataFrame, k: int = 10, boost: DataFrame | None = None, amount: float = 0.15, banned: DataFrame | None = None) -> DataFrame:
    """query_id, item_id, score and rank by cosine; boost (query_id, item_id, one row a liked title) adds amount each.

    A boosted item's score is made on its own; the others among the best are among the best without boosts.
    """
    index = build(items)
    near = search(queries, index, k, banned).select("query_id", "item_id", "score")
    if boost is not None:
        times = boost.groupBy(F.col("query_id").cast("long").alias("query_id"), F.col("item_id").cast("long").alias("item_id")).agg(F.count("*").alias("times"))
        wide = lambda c: F.transform(c, lambda x: F.when(x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), 0.0).otherwise(x.cast("double")))
        own = times.join(queries.select(F.col("query_id").cast("long").alias("query_id"), wide("embedding").alias("q")), "query_id")
        own = own.join(items.select(F.col("item_id").cast("long").alias("item_id"), wide("embedding").alias("v"), *(["genres"] if banned is not None else [])), "item_id")
        if banned is not None:
            out = banned.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.collect_set(F.lower(F.trim("genre"))).alias("banned"))
            own = own.join(out, "query_id", "left").where(~F.coalesce(F.arrays_overlap(F.transform("genres", lambda g: F.lower(F.trim(g))), "banned"), F.lit(False)))
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        length = lambda c: F.greatest(F.sqrt(total(F.transform(c, lambda x: x * x))), F.lit(1e-12))
        cosine = total(F.zip_with("q", "v", lambda x, y: x * y)) / (length(F.col("q")) * length(F.col("v")))
        raised = own.select("query_id", "item_id", (F.round(cosine + F.lit(amount) * F.col("times"), DIGITS) + 0.0).alias("score"))
        near = near.unionByName(raised).groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
