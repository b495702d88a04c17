"""Dual-tree clustering against plain Lloyd over all pairs, and its trees against their definition."""

import hashlib

import numpy as np
import pytest
from conftest import same

from lumenreel.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string"


def vectors(n=700, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, 64))
    rows = []
    for i in range(n):
        v = middles[rng.integers(12)] + rng.normal(size=64) * rng.choice([0.02, 0.3])
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), 1, "clash", "clash"))
    same_ = rows[5][1]
    rows += [(10_000 + i, same_, 1, "", "") for i in range(300)]  # a hot vector
    rows += [(None, rows[9][1], None, None, None), (9, rows[9][1], 0, "", ""), rows[9]]
    rows += [(20_000, None, 0, "", ""), (20_001, [], 0, "", ""), (20_002, [1.0] * 63, 0, "", ""), (20_003, [1.0] * 65, 0, "", "")]
    rows += [(20_004, [float("nan")] + [1.0] * 63, 0, "", ""), (20_005, [float("inf")] + [0.0] * 63, 0, "", ""), (20_006, [None] + [0.5] * 63, 0, "", ""), (20_007, [0.0] * 64, 0, "", ""), (20_008, [-0.0] * 64, 0, "", "")]
    return rows


def plain(rows, k=40, rounds=5):
    kept = [(r[0], np.floor(256 * np.array(r[1], np.float64)).astype(np.int64)) for r in rows if r[1] and len(r[1]) == 64 and all(x is not None and np.isfinite(x) for x in r[1])]
    ordered = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))
    centers = [r[1] for r in ordered[:k]]
    x = np.array([r[1] for r in kept])

    def assign():
        d = np.array([((x - c) ** 2).sum(axis=1) for c in centers])
        return d.argmin(axis=0), d.min(axis=0)

    for _ in range(rounds):
        own, _ = assign()
        centers = [x[own == c].sum(axis=0) // (own == c).sum() if (own == c).any() else centers[c] for c in range(len(centers))]
    own, d = assign()
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centers]
    return sorted([(r[0], int(c), int(e), int(d[own == c].sum()), int(d.sum()), digest[c]) for r, c, e in zip(kept, own, d, strict=True)], key=repr)


def held(df):
    return sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()], key=repr)


@pytest.mark.parametrize("block", [2048, 50, 1])
def test_equals_plain_lloyd(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = vectors(700 if block > 1 else 60)
    assert held(C.clustered_vectors(spark, spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


@pytest.mark.parametrize("n", [1, 3, 39])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [*vectors()[:n], (77, [0.25] * 64, 0, "", ""), (78, [0.25] * 64, 0, "", "")]
    assert held(C.clustered_vectors(spark, spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_empty_table(spark):
    assert C.clustered_vectors(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.clustered_vectors(spark, spark.createDataFrame([(1, [1.0], 1, "", "")], SCHEMA)).count() == 0


def test_equals_sql(spark, duck):
    rows = vectors(300)
    con = duck.cursor()
    table = spark.createDataFrame(rows, SCHEMA)
    con.register("rows_of_embeddings", table.select("vec_id", "embedding").toArrow())
    con.execute("CREATE TEMP VIEW embeddings AS SELECT * FROM rows_of_embeddings")
    same(C.clustered_vectors(spark, table), con.sql(C.ORACLE_SQL))


def test_components_that_overflow_are_refused(spark):
    with pytest.raises(Exception, match="overflow"):
        C.clustered_vectors(spark, spark.createDataFrame([(1, [1e30] * 64, 1, "", "")], SCHEMA)).count()


def test_tree_is_a_cover_tree():
    rng = np.random.default_rng(1)
    points, _, _ = C._distinct(np.concatenate([rng.integers(-300, 300, (150, 8)), rng.integers(-3, 3, (150, 8))]))
    tree, order = C.CoverTree.build(points, 1)
    assert sorted(order.tolist()) == list(range(len(points))) and (tree.points == points[order]).all()
    depth = np.zeros(len(tree.center), int)
    for node in range(len(tree.center)):
        own = tree.points[tree.start[node] : tree.end[node]]
        assert np.sqrt(((own - tree.points[tree.center[node]]) ** 2).sum(axis=1)).max() <= tree.radius[node]
        sons = tree.kids[tree.first[node] : tree.first[node] + tree.count[node]]
        if len(sons):
            assert tree.start[sons].tolist() == [tree.start[node], *tree.end[sons][:-1]] and tree.end[sons[-1]] == tree.end[node]
            assert tree.center[sons[0]] == tree.center[node]  # nested
            depth[sons] = depth[node] + 1
            far = [np.sqrt(((tree.points[tree.center[a]] - tree.points[tree.center[b]]) ** 2).sum()) for a in sons for b in sons if a < b]
            reach = max(np.sqrt(((tree.points[tree.center[s]] - tree.points[tree.center[node]]) ** 2).sum()) for s in sons)
            assert min(far) > reach / 2 - 1e-9  # separated by more than half of what covers them
    assert depth.max() < 40


def test_node_pairs_are_pruned():
    rng = np.random.default_rng(2)
    middles = rng.integers(-2000, 2000, (40, 64))
    points, _, _ = C._distinct(middles[rng.integers(0, 40, 2000)] + rng.integers(-40, 40, (2000, 64)))
    tree, _ = C.CoverTree.build(points)
    centers, numbers = C._center_tree(middles)
    number, distance, seen = C.nearest(tree, centers, numbers)
    gaps = np.array([((tree.points - m) ** 2).sum(axis=1) for m in middles])
    assert (number == gaps.argmin(axis=0)).all() and (distance == gaps.min(axis=0)).all()
    assert seen < 0.25 * len(points) * 40
