"""Centroid clustering by dual-tree Lloyd over integer vectors.

Vectors stay where they are read. A task cuts them into blocks and builds a cover tree of each block's different
vectors: nested nets at halving distances, each net point covered by one of the net above. Trees are written once, to
the shared folder. In a round the centroids (``k`` of them, nothing that grows with the table) go to every task with a
cover tree of their own, and each block's tree is walked against it in pairs of nodes: a pair goes if even its closest
points are farther apart than the centroid that some pair of the same node has shown to be near. What is left at the
leaves is compared exactly in 64-bit integers; bounds are floats with a margin, so they never decide a tie. A task sends
one row for each centroid (count and sums), which are summed exactly and divided with floor.

Kept are vectors with exactly ``dims`` components, none null or non-finite; others have no row in the result. Repeated
rows and equal vectors count each. A null vec_id is kept, its hash is that of ``2:``; of equal hashes the smaller vector
comes first. With fewer vectors than ``k`` each is a centroid; of equal centroids the smaller number gets the vectors.
An empty table gives no rows, extra columns are ignored. Components of 2^27 and more after scaling would overflow a
64-bit distance and raise an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, give_back, materialise, ship

CLUSTERS = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
BLOCK = 2048  # vectors of a tree at most
LEAF = 8  # different vectors of a leaf at most
LARGEST = 1 << 27
PAIRS = 1 << 14  # pairs of points compared at once


class CoverTree:
    """Nested nets over different points; the points of a node are rows start to end of ``points``."""

    PARTS = ("points", "center", "radius", "start", "end", "first", "count", "kids")

    def __init__(self, points: np.ndarray, center: np.ndarray, radius: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, count: np.ndarray, kids: np.ndarray):
        self.points, self.center, self.radius = points, center, radius
        self.start, self.end, self.first, self.count, self.kids = start, end, first, count, kids

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[CoverTree, np.ndarray]:
        """The tree of points (int64, all different, one at least) and the place of each of its rows in points."""
        n = len(points)
        x = (points - points[0]).astype(np.float64)
        square = np.einsum("ij,ij->i", x, x)
        gap = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * (x @ x.T), 0))
        near, who = gap[0].copy(), np.zeros(n, np.int64)
        chosen = np.zeros(n, bool)
        chosen[0] = True
        widest, level, above = float(near.max()), 0, who.copy()
        made: list[tuple[int, int, int]] = []  # level, parent and point, in the order of levels
        for _ in range(n - 1):
            i = int(np.argmax(np.where(chosen, -1.0, near)))
            here = int(np.floor(np.log2(widest / near[i]))) + 1 if near[i] > 0 else level + 1
            if here > level:
                level, above = here, who.copy()  # the net of the levels before
            made.append((level, int(above[i]), i))
            chosen[i] = True
            closer = gap[i] < near
            near[closer], who[closer] = gap[i][closer], i
        # Nodes from the finest level up: a point with new neighbours gets a node over its last one and theirs.
        last, sons, middle, members = list(range(n)), [[] for _ in range(n)], list(range(n)), [[i] for i in range(n)]
        at = len(made)
        while at:
            begin = at
            while begin and made[begin - 1][0] == made[at - 1][0]:
                begin -= 1
            groups: dict[int, list[int]] = {}
            for _, parent, i in made[begin:at]:
                groups.setdefault(parent, []).append(i)
            for parent, own in groups.items():
                sons.append([last[parent], *(last[i] for i in own)])
                members.append([m for s in sons[-1] for m in members[s]])
                middle.append(parent)
                last[parent] = len(sons) - 1
            at = begin
        # Numbered from the root on, with leaves of a few points.
        order = np.array(members[last[0]], np.int64)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        queue, rows, kids = [last[0]], [], []
        for node in queue:  # grows while it is read
            own = members[node]
            low = int(place[own[0]])
            first, count = 0, 0
            if len(own) > leaf:
                first, count = len(kids), len(sons[node])
                kids += range(len(queue), len(queue) + count)
                queue += sons[node]
            far = points[own] - points[middle[node]]
            rows.append((place[middle[node]], np.sqrt(float(np.einsum("ij,ij->i", far, far).max())) * (1 + 1e-12), low, low + len(own), first, count))
        cols = list(zip(*rows, strict=True))
        whole = [np.array(c, np.float64 if i == 1 else np.int64) for i, c in enumerate(cols)]
        return cls(points[order], *whole, np.array(kids, np.int64)), order

    def pack(self) -> dict[str, bytes]:
        return {p: getattr(self, p).astype({"points": "<i4", "radius": "<f8"}.get(p, "<i4")).tobytes() for p in self.PARTS}

    @classmethod
    def unpack(cls, cells: dict[str, bytes], dims: int) -> CoverTree:
        parts = {p: np.frombuffer(cells[p], {"radius": "<f8"}.get(p, "<i4")) for p in cls.PARTS}
        return cls(**{p: v if p == "radius" else v.astype(np.int64).reshape(-1, dims) if p == "points" else v.astype(np.int64) for p, v in parts.items()})


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), PAIRS):
        gap = a[at : at + PAIRS] - b[at : at + PAIRS]
        out[at : at + PAIRS] = np.einsum("ij,ij->i", gap, gap)
    return out


def nearest(tree: CoverTree, centers: CoverTree, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each point of tree the number of its nearest center and the squared distance, and how many pairs were compared.

    numbers are those of the rows of centers; of centers equally near the smallest number is taken.
    """
    n, seen = len(tree.points), 0
    bound = np.full(len(tree.center), np.inf)  # no point of the node is farther from its nearest center
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(v):
        apart = np.concatenate([np.sqrt(_squares(tree.points[tree.center[v[at : at + PAIRS]]], centers.points[centers.center[c[at : at + PAIRS]]]).astype(np.float64)) for at in range(0, len(v), PAIRS)])
        seen += len(v)
        np.minimum.at(bound, v, apart + tree.radius[v])
        left = apart - tree.radius[v] - centers.radius[c] <= bound[v] * (1 + 1e-9) + 1e-6
        v, c = v[left], c[left]
        leaves = (tree.count[v] == 0) & (centers.count[c] == 0)
        lv, lc = v[leaves], c[leaves]
        if len(lv):
            nv, nc = tree.end[lv] - tree.start[lv], centers.end[lc] - centers.start[lc]
            for at in range(0, len(lv), PAIRS // LEAF):
                some = slice(at, at + PAIRS // LEAF)
                of = np.repeat(np.arange(len(nv[some])), nv[some] * nc[some])
                turn = _ragged(np.zeros(len(nv[some]), np.int64), nv[some] * nc[some])
                p, q = tree.start[lv[some]][of] + turn // nc[some][of], centers.start[lc[some]][of] + turn % nc[some][of]
                d = _squares(tree.points[p], centers.points[q])
                seen += len(p)
                nearer = best.copy()
                np.minimum.at(nearer, p, d)
                number[nearer < best] = np.iinfo(np.int64).max
                best = nearer
                tied = d == best[p]
                np.minimum.at(number, p[tied], numbers[q[tied]])
        v, c = v[~leaves], c[~leaves]
        by_center = (centers.count[c] > 0) & ((tree.count[v] == 0) | (centers.radius[c] >= tree.radius[v]))
        cv, cc = v[by_center], c[by_center]
        vv, vc = v[~by_center], c[~by_center]
        sons_c, sons_v = centers.kids[_ragged(centers.first[cc], centers.count[cc])], tree.kids[_ragged(tree.first[vv], tree.count[vv])]
        bound_of = np.repeat(bound[vv], tree.count[vv])
        np.minimum.at(bound, sons_v, bound_of)
        v = np.concatenate([np.repeat(cv, centers.count[cc]), sons_v])
        c = np.concatenate([sons_c, np.repeat(vc, tree.count[vv])])
    return number, best, seen


def _distinct(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows, the first place of each, and the different row of each row."""
    keys = np.ascontiguousarray(points).view(np.dtype((np.void, points.shape[1] * points.itemsize)))[:, 0]
    _, first, of = np.unique(keys, return_index=True, return_inverse=True)
    return points[first], first, of


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    q = np.floor(values * float(scale))
    if len(q) and np.abs(q).max() >= LARGEST:
        raise ValueError(f"a component reaches {LARGEST} after scaling, where 64-bit distances overflow")
    return q.astype(np.int64)


_TREES = "ids array<long>, owner binary, " + ", ".join(f"{p} binary" for p in CoverTree.PARTS)


def trees(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each block of kept vectors: their ids, the tree's point of each, and the tree."""
    ship(vectors.sparkSession)
    shape = pa.schema([("ids", pa.list_(pa.int64())), ("owner", pa.binary()), *[(p, pa.binary()) for p in CoverTree.PARTS]])

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            full = np.flatnonzero(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dims)
            for at in range(0, len(full), BLOCK):
                rows = pa.array(full[at : at + BLOCK])
                values = lists.take(rows).flatten()  # a null component is NaN here
                flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
                fine = np.isfinite(flat).all(axis=1)
                if not fine.any():
                    continue
                points, _, of = _distinct(_integers(flat[fine], scale))
                tree, order = CoverTree.build(points)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                ids = batch.column(0).take(rows).filter(pa.array(fine))
                cells = {"ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "owner": pa.array([place[of].astype("<i4").tobytes()]), **{k: pa.array([v]) for k, v in tree.pack().items()}}
                yield pa.RecordBatch.from_pydict(cells, shape)
        give_back()

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, _TREES)


def _blocks(batches, dims: int):
    """ids, places and tree of each row of trees()."""
    for b in batches:
        for row in range(b.num_rows):
            cells = {name: b.column(i)[row] for i, name in enumerate(b.schema.names)}
            yield cells["ids"].values, np.frombuffer(cells["owner"].as_py(), "<i4").astype(np.int64), CoverTree.unpack({p: cells[p].as_py() for p in CoverTree.PARTS}, dims)


def _center_tree(centroids: np.ndarray) -> tuple[CoverTree, np.ndarray]:
    points, first, _ = _distinct(centroids)
    tree, order = CoverTree.build(points, 1)
    return tree, first[order]


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """The k kept vectors with the smallest SHA-256 of ``2:<id>``, in its order, scaled to integers."""
    own = vectors.select(F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))).cast("binary"), 256).alias("hash"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = own.where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
    rows = kept.orderBy("hash", "v").limit(k).collect()
    return _integers(np.array([r["v"] for r in rows], np.float64).reshape(-1, dims), scale)


def _sums(stored: DataFrame, centroids: np.ndarray) -> list:
    """cluster, n and sums of the vectors nearest to each centroid."""
    k, dims = centroids.shape

    def run(batches):
        centers, numbers = _center_tree(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, owner, tree in _blocks(batches, dims):
            cluster, _, _ = nearest(tree, centers, numbers)
            times = np.bincount(owner, minlength=len(tree.points))
            np.add.at(n, cluster, times)
            np.add.at(sums, cluster, tree.points * times[:, None])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": n[some], "sums": pa.array(list(sums[some]), pa.list_(pa.int64()))})
        give_back()

    parts = stored.mapInArrow(run, "cluster int, n long, sums array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums")).collect()  # k rows at most


def cluster(spark: SparkSession, vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of every kept vector as a stored table, and the final centroids."""
    stored = materialise(trees(vectors, dims, scale, id_col, vector_col), "trees")
    centroids = first_centroids(vectors, k, dims, scale, id_col, vector_col)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for row in _sums(stored, centroids):
            centroids[row["cluster"]] = [s // row["n"] for s in row["sums"]]  # floor of exact integers

    def run(batches):
        centers, numbers = _center_tree(centroids) if len(centroids) else (None, None)  # no vector, no tree
        for ids, owner, tree in _blocks(batches, dims):
            number, distance, _ = nearest(tree, centers, numbers)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(number[owner], pa.int32()), "distance": distance[owner]})
        give_back()

    assigned = materialise(stored.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    discard(stored)
    return assigned, centroids


def clustered_vectors(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    assigned, centroids = cluster(spark, vectors)
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = [(number, inertia.get(number, 0), sum(inertia.values()), digest) for number, digest in enumerate(digests)]
    named = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # named has k rows


def _sql() -> str:
    def assigned(centers: str) -> str:
        squares = f"list_sum(list_transform(range(1, {DIMS + 1}), lambda p: (v.q[p] - c.q[p]) * (v.q[p] - c.q[p])))::HUGEINT"
        return f"SELECT r, min({squares} * {CLUSTERS} + c.c) AS least FROM v CROSS JOIN {centers} c GROUP BY r"

    rounds = ""
    for i in range(1, ROUNDS + 1):
        rounds += f"""a{i} AS MATERIALIZED ({assigned(f'c{i - 1}')}),
s{i} AS (SELECT (least % {CLUSTERS})::INT AS c, p, sum(q[p])::HUGEINT AS s, count(*) AS n FROM a{i} JOIN v USING (r) CROSS JOIN (SELECT unnest(range(1, {DIMS + 1})) AS p) GROUP BY 1, 2),
u{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS q FROM s{i} GROUP BY 1),
c{i} AS MATERIALIZED (SELECT o.c, coalesce(u.q, o.q) AS q FROM c{i - 1} o LEFT JOIN u{i} u ON u.c = o.c),
"""
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), q) - 1)::INT AS c, q FROM v QUALIFY c < {CLUSTERS}),
{rounds}f AS MATERIALIZED ({assigned(f'c{ROUNDS}')}),
g AS (SELECT r, (least % {CLUSTERS})::INT AS cluster, (least // {CLUSTERS})::BIGINT AS distance FROM f)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM g JOIN v USING (r) JOIN c{ROUNDS} c ON c.c = g.cluster
"""


ORACLE_SQL = _sql()
