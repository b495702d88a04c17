"""Behaviour and golden values on the catalog of four items and the interactions of three users."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenreel import __main__ as cli
from lumenreel import folders
from lumenreel.engine import Engine
from lumenreel.functions import text as X
from lumenreel.functions import vectors as V
from lumenreel.operators import interactions as I
from lumenreel.operators import itemside, linear, nearest
from lumenreel.operators import metrics as M
from lumenreel.operators import models as S
from lumenreel.operators import neural
from lumenreel.operators import ranking as R
from lumenreel.operators import requests as Q
from lumenreel.operators.itemside import ItemSide, similar_to
from lumenreel.sources import adapter as A


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(0, 1, "Space One (2000)", ["Sci-Fi"]), (1, 2, "Space Two (2001)", ["Sci-Fi", "Action"]), (2, 3, "Love One (2002)", ["Romance"]), (3, 4, "Mix (2003)", ["Sci-Fi", "Romance"])]
    df = spark.createDataFrame(rows, "item_index long, movie_id long, title string, genres array<string>")
    return df.withColumn("norm_title", X.normalize_title(F.col("title"))).cache()


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (1, 3), (2, 2), (2, 3)], "user_id long, item_index long").cache()


@pytest.fixture(scope="module")
def engine(history, catalog):
    return Engine(history, catalog, regularization=10)


def request(spark, liked=(), description="", disliked=(), excluded=(), top_k=10, summary="", context=""):
    row = (1, description, summary, context, list(liked), list(disliked), [], list(excluded), top_k, 1.0)
    return spark.createDataFrame([row], Q.SCHEMA)


def items(engine, *args, **kw):
    rows = engine.recommend(request(*args, **kw)).collect()
    return [(i["title"], round(i["score"], 6)) for i in rows[0]["items"]] if rows else []


def test_popularity(history, catalog):
    assert {r.item_index: (r.n, round(r.popularity, 6)) for r in S.popularity(history, catalog).collect()} == {0: (2, 1.0), 1: (2, 1.0), 2: (1, 0.0), 3: (2, 1.0)}


def test_similarity_golden(history):
    sims = {(r.item_i, r.item_j): round(r.sim, 6) for r in S.item_similarity(history).collect()}
    assert sims == {(0, 1): 1.0, (1, 0): 1.0, (0, 3): 0.5, (3, 0): 0.5, (1, 3): 0.5, (3, 1): 0.5, (2, 3): 0.707107, (3, 2): 0.707107}
    with pytest.raises(ValueError):
        S.item_similarity(history, 2.0)
    with pytest.raises(ValueError):
        S.item_similarity(history, 0.5, -1)


def whole_weights(weights, side):
    """The weights as a matrix in the order of items."""
    n = side.items.n_blocks
    b = np.vstack([np.hstack([weights.block(i, j) for j in range(n)]) for i in range(n)])
    order = np.argsort(side.items.whole("items"))
    return b[np.ix_(order, order)]


@pytest.mark.parametrize("width", [1024, 3, 1])
def test_linear_autoencoder_golden(history, catalog, width):
    side = ItemSide(catalog, S.popularity(history, catalog), width)
    want = [[0, 0.160794, -0.006024, 0.071429], [0.160794, 0, -0.006024, 0.071429], [-0.006406, -0.006406, 0, 0.090909], [0.070468, 0.070468, 0.084337, 0]]
    assert np.allclose(whole_weights(linear.fit(history, side, 10), side), want, atol=1e-6)
    with pytest.raises(ValueError):
        linear.fit(history, side, 0)


@pytest.mark.parametrize(("width", "strip"), [(1024, 128 << 20), (70, 128 << 20), (33, 100_000)])
def test_weights_by_blocks_equal_the_dense_inverse(spark, sf_dir, monkeypatch, width, strip):
    monkeypatch.setattr(linear, "STRIP", strip)
    history, catalog = I.binary_matrix(A.positives(spark, sf_dir)), A.catalog(spark, sf_dir)
    side = ItemSide(catalog, S.popularity(history, catalog), width)
    weights = linear.fit(history, side, 50.0)
    ids = sorted(r[0] for r in catalog.select("item_index").collect())
    rows = history.toPandas()
    x = np.zeros((rows.user_id.nunique(), len(ids)))
    x[np.unique(rows.user_id, return_inverse=True)[1], np.searchsorted(ids, rows.item_index)] = 1
    p = np.linalg.inv(x.T @ x + 50 * np.eye(len(ids)))
    b = p / -np.diag(p)
    np.fill_diagonal(b, 0)
    assert np.allclose(whole_weights(weights, side), b, atol=1e-12)
    checked = linear.check(history, side, weights, 50.0).toPandas().sort_values("item_index")
    assert checked.deviation.max() < 1e-10 and np.allclose(checked.own_inverse, np.diag(p)) and np.allclose(checked.weight_sum, b.sum(axis=0)) and (checked.own_weight == 0).all()
    want = np.where(x > 0, -np.inf, np.round(x @ b, 9))
    users = {u: k for k, u in enumerate(np.unique(rows.user_id))}
    got = {}
    for r in S.recommend_users(history, side, {"ease": "ease"}, 5, weights).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(ids.index(r.item_index))
    assert len(got) == len(users)
    for user, row in users.items():
        assert got[user] == sorted(range(len(ids)), key=lambda i: (-want[row, i], i))[:5]
    side.release()


def test_request_golden(spark, engine):
    assert items(engine, spark, ["Space One (2000)"], "I like science fiction") == [("Space Two (2001)", 1.0), ("Mix (2003)", 0.555363), ("Love One (2002)", 0.0)]


def test_older_hybrid_golden(spark, engine, history, catalog):
    rows = Q.prepared(request(spark, ["Space One (2000)"], "science fiction"), catalog, engine.genres)
    for width in (1024, 2, 1):
        side = ItemSide(catalog, S.popularity(history, catalog), width).with_similar(S.item_similarity(history))
        got = [(r.item_index, round(r.score, 6)) for r in Q.answer(rows, side, hybrid=S.Weights()).orderBy("rank").collect()]
        assert got == [(1, 1.0), (3, 0.68), (2, 0.0)]


def test_requests_in_bulk_equal_single_ones(spark, engine, history, catalog):
    """Many requests at once, of equal and different signatures, over one block and several, as each alone."""
    rows = [(i, ["science fiction", "romance", ""][i % 3], "", "", [["Space One (2000)"], ["Mix (2003)", "?", "mix"], []][i // 3 % 3] or ([] if i % 3 < 2 else ["Love One (2002)"]), ["Romance"] if i % 4 == 3 else [], [], ["space two (2001)"] if i % 5 == 4 else [], 1 + i % 4, 1.0) for i in range(60)]
    whole = Q.prepared(spark.createDataFrame(rows, Q.SCHEMA), catalog, engine.genres)
    key = lambda df: sorted((r.request_id, r["rank"], r.item_index, round(r.score, 9), round(r.ease, 9), round(r.content, 9)) for r in df.collect())
    bulk = key(Q.answer(whole, engine.side, engine.weights))
    narrow = ItemSide(catalog, S.popularity(history, catalog), 1)
    assert key(Q.answer(whole, narrow, linear.fit(history, narrow, 10))) == bulk
    for i in (0, 4, 11, 34):
        assert key(Q.answer(whole.where(F.col("request_id") == i), engine.side, engine.weights)) == [b for b in bulk if b[0] == i] != []


def test_exclusions(spark, engine):
    assert [t for t, _ in items(engine, spark, ["Space One (2000)"], "scifi", disliked=["romance"])] == ["Space Two (2001)"]
    assert [t for t, _ in items(engine, spark, ["Space One (2000)"], "scifi", excluded=["space two (2001)"])][0] == "Mix (2003)"


def test_cold_start_and_errors(spark, engine):
    assert [t for t, _ in items(engine, spark, description="melodrama only")] == ["Space One (2000)", "Space Two (2001)", "Mix (2003)", "Love One (2002)"]
    with pytest.raises(Exception, match="needed"):
        items(engine, spark)
    with pytest.raises(Exception, match="top_k"):
        items(engine, spark, description="x", top_k=101)


def test_unknown_titles_are_cold_start(spark, engine):
    assert len(items(engine, spark, ["Nothing (1900)"])) == 4


def test_services(spark, engine):
    assert engine.describe()["catalog_size"] == 4
    asked = spark.createDataFrame([(1, ["A", "B"], ["C"], " rain ")], "request_id long, liked array<string>, disliked array<string>, context string")
    assert engine.summarize(asked).first().summary == "The user likes movies such as A, B. The user does not enjoy C. Current viewing context: rain"
    movies = spark.createDataFrame([(1, [2, 99, 1]), (2, [99])], "request_id long, movie_ids array<long>")
    got = {r.request_id: r.summary for r in engine.summarize_movies(movies).collect()}
    assert got == {1: "The user likes movies such as Space Two (2001), Space One (2000). Their selected movies suggest interest in Sci-Fi, Action.", 2: ""}
    genres = spark.createDataFrame([(1, ["Romance", " Romance "], "", 10)], "request_id long, genres array<string>, context string, top_k int")
    assert [i["title"] for i in engine.recommend_genres(genres).first()["items"]][:2] == ["Mix (2003)", "Love One (2002)"]


def test_split_fixture(spark):
    rows = [(1, 5, 10), (1, 7, 20), (1, 9, 20), (1, 3, 15), (1, 8, 20), *[(2, k, k) for k in range(4)]]
    split = I.leave_one_out(spark.createDataFrame(rows, "user_id long, item_index long, ts long")).collect()
    assert {r.user_id for r in split} == {1}
    assert [r.item_index for r in split if r.is_target] == [9] and {r.item_index for r in split if not r.is_target} == {3, 5, 7, 8}


def test_validation_size(spark):
    users = spark.range(6024).withColumnRenamed("id", "user_id")
    assert I.validation_users(users).where("is_validation").count() == 1204
    assert I.validation_users(users.limit(3)).where("is_validation").count() == 1


def test_title_and_text_goldens(spark):
    pairs = {
        "Matrix, The (1999)": "matrix the", "The Matrix": "the matrix", "American in Paris, An (1951)": "american in paris an", "Seven (a.k.a. Se7en) (1995)": "seven (a.k.a. se7en)",
        "  Bug's  Life, A (1998) ": "bug's life a", "(500)": "", "": "", "A (B) C": "a (b) c",
    }
    df = spark.createDataFrame(list(pairs), "string").select("value", X.normalize_title(F.col("value")).alias("n"))
    assert {r.value: r.n for r in df.collect()} == pairs
    voc = ["Drama", "Sci-Fi", "Film-Noir"]
    texts = {"melodrama only": [], "scifi": ["Sci-Fi"], "a DRAMA, or film-noir": ["Drama", "Film-Noir"], "sci-fié": [], None: []}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for found in (X.genres_of_literal(F.col("t"), voc), X.genres_from_text(F.col("t"), F.array(*map(F.lit, voc)))):
        assert {r.t: r.g for r in df.select("t", found.alias("g")).collect()} == texts


def test_more_text(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(X.preference_text(F.array(F.lit("a"), F.lit(" "), F.lit("b")))) == "a\nContext: b"
    assert value(X.extract_dislikes(F.lit("I DISLIKE all horror, no drama"))) == ["Horror", "Drama"]
    assert value(X.short_overview(F.lit("A b. C d. E"))) == "A b. C d."
    assert value(X.search_queries(F.lit("Star Wars: Episode IV - Hope (1977)"))) == ["Star Wars Episode IV", "Star Wars: Episode IV - Hope (1977)", "Star Wars Episode IV", "Star Wars: Episode IV"]
    assert value(X.generated_list(F.lit("One,  T,Two words\nThree"), 2)) == ["One", "Two words"]
    assert value(X.clean_title_legacy(F.lit("Bird, An (1990)"))) == "birdn"
    assert value(X.genre_ids(F.array(F.lit("Sci-Fi"), F.lit("?"), F.lit("War")))) == [878, 10752]
    fav, least = X.favourite_genres(F.lit("Favorite: Sci-Fi\nLeast Favorite: War"))
    assert (value(fav), value(least)) == ("sci fi", "war")
    assert value(X.favourite_genres(F.lit("none"))[1]) is None
    assert value(X.year_of(F.lit("1999-05-01"))) == 1999 and value(X.year_of(F.lit(""))) is None


def test_metrics_goldens(spark, catalog, history):
    ranked = spark.createDataFrame([("m", 1, 1, 0), ("m", 1, 2, 1), ("m", 1, 3, 2)], "model string, user_id long, rank int, item_index long")
    targets = spark.createDataFrame([(1, 2)], "user_id long, target long")
    got = M.leave_one_out_metrics(ranked, targets, catalog, S.popularity(history, catalog)).first()
    assert (got.recall, got.ndcg, round(got.mrr, 6), got.coverage, round(got.diversity, 6)) == (1.0, 0.5, 0.333333, 0.75, 0.833333)
    own = spark.createDataFrame([(1, 0)], "user_id long, item_index long")
    assert round(M.many_positive_metrics(ranked, own, 10).first().ndcg, 6) == 0.613147
    assert M.many_positive_metrics(ranked, own, 10, "standard").first().ndcg == 1.0
    wanted = spark.createDataFrame([(1, "Sci-Fi")], "user_id long, genre string")
    assert round(M.genre_ndcg(ranked, catalog, wanted).first().ndcg, 6) == 0.765361
    single = ranked.where("rank = 1")
    assert M.diversity(single, catalog).first().diversity is None


def greedy(cands, k, penalty):
    taken = []
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    while len(taken) < min(k, len(cands)):
        left = [i for i in range(len(cands)) if i not in taken]
        taken.append(max(left, key=lambda i: (cands[i][0] - penalty * max([jac(cands[i][1], cands[j][1]) for j in taken], default=0), -i)))
    return taken


def test_diversify_is_the_greedy_rule(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for user in range(25):
        n = int(rng.integers(2, 12))
        scores = np.sort(rng.integers(0, 50, n) / 10.0)[::-1]
        genres = [[g for g in "abcd" if rng.random() < 0.4] for _ in range(n)]
        rows += [(user, i, float(scores[i]), genres[i]) for i in range(n)]
        span = scores.max() - scores.min()
        rel = (scores - scores.min()) / span if span > 1e-12 else scores * 0
        want[user] = greedy([(float(r), set(g)) for r, g in zip(rel, genres, strict=True)], 6, 0.3)
    out = R.diversify(spark.createDataFrame(rows, "user_id long, item_index long, score double, genres array<string>"), 6, 0.3)
    got = {}
    for r in out.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.item_index)
    assert got == want


def test_quota(spark):
    rows = [(i, str(i), ["a"] if i % 2 else ["b", "c"], 100 - i, i) for i in range(12)]
    out = R.quota_selection(spark.createDataFrame(rows, "movie_id long, title string, genres array<string>, n long, first_pos long"), most=3, wanted=50).collect()
    assert [r.movie_id for r in out] == [0, 1, 2, 3, 4, 5]


def test_vectors(spark):
    one = spark.range(1)
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(V.bures_wasserstein(arr(0, 0), arr(1, 4), arr(1, 2), arr(4, 9))) == 7.0
    assert value(V.merge_latents(arr(4), arr(8), 0.25)) == [5.0]
    assert value(V.fuse(F.lit(None).cast("array<double>"), arr(1, 2))) == [1.0, 2.0]
    assert value(V.normalize(F.array(F.lit(float("nan")), F.lit(3.0)))) == [0.0, 1.0]
    tokens = F.array(arr(1, 2), arr(3, 4))
    assert value(V.pool(tokens)) == [2.0, 3.0] and value(V.pool(tokens, "last")) == [3.0, 4.0]
    assert np.allclose(value(V.pool(tokens, "weighted_mean")), [7 / 3, 10 / 3])
    assert abs(sum(value(V.softmax(arr(1, 2, 3)))) - 1) < 1e-12
    assert value(V.js_between(arr(1), arr(0), arr(1), arr(0))) == 0.0
    assert abs(value(V.temperature_kl(arr(1, 2), arr(1, 2), 2.0))) < 1e-12


def test_boosted_neighbours(spark, catalog):
    items = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "item_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    liked = R.liked_boost(catalog, spark.createDataFrame([(7, "Space Two (2001)"), (7, "space two"), (7, "?")], "query_id long, title string"))
    got = [(r.item_id, round(r.score, 3)) for r in nearest.top_k(queries, items, 2, liked).orderBy("rank").collect()]
    assert got == [(1, 1.294), (0, 1.0)]


def test_weights():
    assert S.Weights(2, 1, 1).normalized() == S.Weights(0.5, 0.25, 0.25)
    assert len(S.GRID) == 27
    with pytest.raises(ValueError):
        S.Weights(0, 0, 0).normalized()


def dense_lists(history, catalog, popular, similarity, models, k):
    """Lists by plain matrices of users and items."""
    items = catalog.select("item_index", "genres").join(popular.select("item_index", "popularity"), "item_index").toPandas().sort_values("item_index", ignore_index=True)
    ids, names = items.item_index.to_numpy(), sorted({g for gs in items.genres for g in gs})
    has = np.array([[float(g in gs) for g in names] for gs in items.genres]).reshape(len(ids), len(names))
    rows, sims = history.toPandas(), similarity.toPandas()
    users = np.unique(rows.user_id)
    x = np.zeros((len(users), len(ids)))
    x[np.searchsorted(users, rows.user_id), np.searchsorted(ids, rows.item_index)] = 1
    s = np.zeros((len(ids), len(ids)))
    s[np.searchsorted(ids, sims.item_i), np.searchsorted(ids, sims.item_j)] = sims.sim
    own = (x @ has > 0).astype(float)
    raw = own @ has.T / np.maximum(own.sum(axis=1, keepdims=True), 1)
    scale = lambda m: np.divide(m - m.min(axis=1, keepdims=True), np.ptp(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.ptp(m, axis=1, keepdims=True) > 1e-12)
    cf, content, out = scale(x @ s), scale(raw), {}
    for name, m in models.items():
        if isinstance(m, S.Blend):
            total = np.where(raw > 0, m.content * raw + m.popularity * items.popularity.to_numpy(), -np.inf)
        else:
            w = m.normalized()
            total = w.collaborative * cf + w.content * content + w.popularity * items.popularity.to_numpy()
        total = np.where(x > 0, -np.inf, np.round(total, 9))
        for u, line in zip(users, total, strict=True):
            best = sorted((i for i in range(len(ids)) if np.isfinite(line[i])), key=lambda i: (-line[i], i))[:k]
            out[name, u] = [(int(ids[i]), round(float(line[i]), 6)) for i in best]
    return {key: v for key, v in out.items() if v}


@pytest.mark.parametrize("k", [1, 10, 150])
def test_lists_by_thresholds_equal_plain_matrices(spark, sf_dir, k):
    """Whole lists of all models, for users with few and with nearly all items, lists longer than signatures and the catalog."""
    catalog = A.catalog(spark, sf_dir).where("item_index % 2 = 0")
    history = I.binary_matrix(A.positives(spark, sf_dir).join(catalog.select("item_index"), "item_index", "left_semi")).where("user_id % 3 = 0")
    most = catalog.where("item_index % 20 <> 4").select(F.lit(3).cast("long").alias("user_id"), "item_index")
    history = history.unionByName(most).distinct()
    popular, similarity = S.popularity(history, catalog), S.item_similarity(history)
    models = {"hybrid": S.Weights(), "cf": S.Weights(1, 0, 0), "cf_content": S.Weights(1, 1, 0), "content": S.Weights(0, 1, 0), "popularity": S.Weights(0, 0, 1), "mixed": S.Weights(0, 0.5, 0.5), "raw": S.Blend(1.0, 0.0), "blend": S.Blend(0.3, 0.7)}
    side = ItemSide(catalog, popular, 16).with_similar(similarity)
    got = {}
    for r in S.recommend_users(history, side, models, k).orderBy("model", "user_id", "rank").collect():
        got.setdefault((r.model, r.user_id), []).append((r.item_index, round(r.score, 6)))
    assert got == dense_lists(history, catalog, popular, similarity, models, k)


def test_lists_read_few_items(spark):
    """Where popularity falls, a list of ten reads the heads of the signatures' lists, not the catalog."""
    n = 4000
    catalog = spark.range(n).select(F.col("id").alias("item_index"), F.array(F.concat(F.lit("g"), (F.col("id") % 20).cast("string"))).alias("genres"))
    popular = catalog.select("item_index", (F.lit(1.0) - F.col("item_index") / n).alias("popularity"))
    lists = S._Lists(ItemSide(catalog, popular).items)
    read = 0

    class Counted(np.ndarray):
        def __getitem__(self, at):
            nonlocal read
            out = super().__getitem__(at)
            read += np.size(out)
            return out

    lists.popularity = lists.popularity.view(Counted)
    none = (np.empty(0, np.int64), np.empty(0))
    places, scores = lists.best(np.zeros(20), 1.0, np.arange(20), np.arange(5), none, 10)
    assert len(places) == 10 and read < n / 4 and (np.diff(scores) <= 0).all()


def plain_neighbours(queries, items, k, boost, banned, amount=0.15):
    out = {}
    unit = lambda v: np.nan_to_num(np.array([np.nan if x is None else x for x in v], float)) / max(np.linalg.norm(np.nan_to_num(np.array([np.nan if x is None else x for x in v], float))), 1e-12)
    for q, v in queries:
        rows = [(-(round(float(unit(v) @ unit(w)) + amount * boost.count((q, i)), 9)), i) for i, w, g in items if not set(g) & banned.get(q, set())]
        out[q] = [(i, round(-s, 6)) for s, i in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize(("pivots", "rows", "batch"), [(256, 65_536, 256), (7, 40, 3), (1, 1000, 1)])
def test_neighbours_by_bounds_equal_plain_ones(spark, monkeypatch, pivots, rows, batch):
    """Clusters of all sizes, vectors of length 0 and with NaN, ties, boosts and banned genres, against all pairs."""
    monkeypatch.setattr(nearest, "BATCH", batch)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(9, 8))
    items = [(i, (middles[i % 9] + rng.normal(size=8) * [0.01, 0.5][i % 2]).tolist(), [f"G{i % 3} "]) for i in range(400)]
    items += [(500 + i, items[i][1], ["g0"]) for i in range(30)] + [(600, [0.0] * 8, []), (601, [float("nan"), 1.0, *[0.0] * 6], []), (602, [None, 1.0, *[0.0] * 6], [])]
    queries = [(i, (middles[i % 9] * 2 + rng.normal(size=8) * 0.1).tolist()) for i in range(40)] + [(90, [0.0] * 8), (91, (-middles[0]).tolist())]
    boost = [(q, i) for q, _ in queries for i in (q, 500, 3, 3) if q % 2]
    banned = {q: {"g1"} for q, _ in queries if q % 3 == 0}
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>").repartition(3)
    v = spark.createDataFrame(items, "item_id long, embedding array<double>, genres array<string>").repartition(4)
    plain = plain_neighbours(queries, [(i, w, [g.strip().lower() for g in gs]) for i, w, gs in items], 6, boost, banned)
    kept = nearest.build
    monkeypatch.setattr(nearest, "build", lambda df: kept(df, pivots, rows))
    found = nearest.top_k(q, v, 6, spark.createDataFrame(boost, "query_id long, item_id long"), 0.15, spark.createDataFrame([(a, " " + g.upper()) for a, gs in banned.items() for g in gs], "query_id long, genre string"))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.item_id, round(r.score, 6)))
    assert got == plain


def test_few_clusters_are_read(spark):
    """Where vectors lie in groups, most clusters are passed over by their bounds."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(200, 16))
    rows = [(i, (middles[i % 200] + rng.normal(size=16) * 0.05).tolist()) for i in range(8000)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(i, middles[i].tolist()) for i in range(3)], "query_id long, embedding array<double>").coalesce(1)
    found = nearest.search(queries, nearest.build(items), 10).collect()
    assert len(found) == 30 and all(r.item_id % 200 == r.query_id for r in found)
    assert all(r.clusters_read < 0.2 * r.clusters for r in found)


def test_places_and_ranks_among_unseen(spark):
    history = spark.createDataFrame([(1, 0), (1, 2), (2, 5)], "user_id long, item_index long")
    items = R.placed(spark.createDataFrame([(i, s) for i, s in enumerate((5.0, 4.0, 4.0, 3.0, 2.0, 1.0))], "item_index long, score double"))
    got = sorted((r.user_id, r.item_index) for r in R.most_popular(history, items, 2).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2)]
    targets = spark.createDataFrame([(1, 3), (2, 0), (2, 9)], "user_id long, item_index long")
    assert {(r.user_id, r.item_index, r["rank"]) for r in R.rank_among_unseen(targets, history, items).collect()} == {(1, 3, 2), (2, 0, 1), (2, 9, None)}


def test_best_of_rows_is_best_of_each():
    rng = np.random.default_rng(0)
    x = np.round(rng.random((60, 40)), 1)
    x[rng.random(x.shape) < 0.5] = -np.inf
    x[0], x[1, 3:] = -np.inf, -np.inf
    for k in (1, 5, 39, 40, 50):
        for (a, b), line in zip(R.best_of_rows(x, k), x, strict=True):
            c, d = R.best_of(line, k)
            assert a.tolist() == c.tolist() and b.tolist() == d.tolist()


def test_sparse_products_equal_plain_sums(spark):
    catalog = spark.createDataFrame([(i, ["a", "b"][: i % 3]) for i in range(6)], "item_index long, genres array<string>")
    popular = catalog.select("item_index", F.lit(0.5).alias("popularity"))
    rows = [(0, 1, 1.0), (0, 4, 2.0), (2, 0, 3.0), (3, 2, 4.0), (3, 5, 5.0), (5, 0, 6.0)]
    for width in (1024, 2):
        side = ItemSide(catalog, popular, width).with_similar(spark.createDataFrame(rows, "item_i long, item_j long, sim double"))
        ids = side.items.whole("items")
        at = np.argsort(ids)
        owner, place, total = similar_to(side.items, [np.sort(at[p]) for p in (np.array([0, 3]), np.array([], np.int64), np.array([2, 5, 1]))])
        assert {(u, int(ids[p]), t) for u, p, t in zip(owner.tolist(), place.tolist(), total.tolist(), strict=True)} == {(0, 1, 1.0), (0, 2, 4.0), (0, 4, 2.0), (0, 5, 5.0), (2, 0, 9.0)}


def test_skip_encoder_by_hand():
    rng = np.random.default_rng(0)
    layers = [(rng.normal(0, 1, (5, 3)), rng.normal(0, 1, 3)), (rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)), (rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))]
    norms = [(rng.normal(1, 0.1, 3), rng.normal(0, 0.1, 3)) for _ in layers]
    mean, decoder = (rng.normal(0, 1, (3, 2)), np.ones(2)), (rng.normal(0, 1, (2, 5)), np.zeros(5))
    model = neural.make("recvae", hidden=layers, norms=norms, mean=mean, decoder=decoder)
    x = np.array([[1.0, 0, 1, 1, 0]])

    def scaled(h, k):
        h = h - h.mean()
        return h / np.sqrt((h**2).mean() + 0.1) * norms[k][0] + norms[k][1]

    sw = lambda v: v / (1 + np.exp(-v))
    h1 = scaled(sw((x[0] / 3**0.5) @ layers[0][0] + layers[0][1]), 0)
    h2 = scaled(sw(h1 @ layers[1][0] + layers[1][1] + h1), 1)
    h3 = scaled(sw(h2 @ layers[2][0] + layers[2][1] + h1 + h2), 2)
    assert np.allclose(model.logits(x)[0], (h3 @ mean[0] + mean[1]) @ decoder[0] + decoder[1])


def test_models_with_texts_and_conditions(spark, history):
    rng = np.random.default_rng(0)
    layer = lambda a, b: (rng.normal(0, 1, (a, b)), rng.normal(0, 1, b))
    plain = neural.make("vae", encoder=[layer(4, 3), layer(3, 2)], decoder=[layer(2, 4)], latent=2)
    film = neural.make("film_vae", encoder=[layer(4, 3), layer(3, 2)], decoder=[layer(2, 4)], latent=2, film=(layer(2, 3), layer(2, 3)))
    vectors = {0: [0.5, -1.0], 1: [2.0, 0.0], 2: [0.0, 1.0]}
    table = spark.createDataFrame([*vectors.items(), (9, [1.0, 1.0])], "user_id long, vector array<double>")
    seen = {0: [0, 1], 1: [0, 1, 3], 2: [2, 3]}
    for model, as_, how in ((plain, "text", {"alpha": 0.25}), (plain, "text", {"negative": True}), (film, "condition", {})):
        got = {(r.user_id, r.item_index): r.score for r in neural.score_users(history, model, np.arange(4), 4, table, as_, **how).collect()}
        want = {}
        for u, own in seen.items():
            x = np.zeros((1, 4))
            x[0, own] = 1
            x /= np.linalg.norm(x)
            (w1, b1), (w2, b2), v = *model.encoder, np.array([vectors[u]])
            h = np.tanh(x @ w1 + b1)
            if as_ == "condition":
                (gw, gb), (bw, bb) = model.film
                h = (v @ gw + gb) * h + v @ bw + bb
            z = h @ w2 + b2
            z = z if as_ == "condition" else (z - v) / 2 if how.get("negative") else 0.75 * v + 0.25 * z
            line = (z @ model.decoder[0][0] + model.decoder[0][1])[0]
            want |= {(u, i): round(line[i], 9) for i in range(4) if i not in own}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in got)


def test_softmax_head_learns_profiles(spark, history):
    rng = np.random.default_rng(0)
    vectors = rng.normal(0, 1, (400, 6))
    profiles = (vectors @ rng.normal(0, 1, (6, 8)) > 1).astype(float)
    head = neural.fit_head(vectors, profiles, epochs=60, batch=64, rate=0.05)
    z = head.logits(profiles, vectors)
    loss = lambda z: -((z - np.log(np.exp(z).sum(axis=1, keepdims=True))) * profiles / np.maximum(profiles.sum(axis=1, keepdims=True), 1)).sum(axis=1).mean()
    assert loss(z) < 0.75 * loss(np.zeros_like(z))
    table = spark.createDataFrame([(u, [float(u), 1.0]) for u in range(3)], "user_id long, vector array<double>")
    out = neural.score_users(history, neural.SoftmaxHead(np.ones((2, 4)), np.arange(4.0)), np.arange(4), 1, table)
    assert {(r.user_id, r.item_index, r.score) for r in out.collect()} == {(0, 3, 4.0), (1, 2, 4.0), (2, 1, 4.0)}


def test_prototypes_share_items_between_factors():
    items = np.array([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]])
    model = neural.make("macrid", items=items, cores=np.eye(2), model=neural.EncoderDecoder([(items, np.zeros(2))], [], 2))
    shares = model.shares()
    assert np.allclose(shares.sum(axis=1), 1) and shares[0, 0] > 0.9 and shares[2, 1] > 0.9
    assert model.logits(np.array([[1.0, 0, 0]]))[0].argmax() in (0, 1)


def test_prototypes_merge_latents_of_texts():
    rng = np.random.default_rng(1)
    items = rng.normal(0, 1, (5, 3))
    model = neural.make("macrid", items=items, cores=items[:2], model=neural.EncoderDecoder([(items, np.zeros(3))], [], 3))
    x, text = np.array([[1.0, 0, 1, 0, 0], [0, 1, 0, 0, 1]]), rng.normal(0, 1, (2, 6))
    assert np.allclose(model.logits(x, text, 1.0), model.logits(x)) and not np.allclose(model.logits(x, text, 0.5), model.logits(x))
    unit = lambda v: v / np.linalg.norm(v)
    shares, places = model.shares(), [unit(i) for i in items]
    for how, merge in (({"alpha": 0.25}, lambda z, t: 0.75 * t + 0.25 * z), ({"negative": True}, lambda z, t: (z - t) / 2)):
        for row, got in enumerate(model.logits(x, text, **how)):
            want = np.zeros(5)
            for k in range(2):
                z = unit(merge(unit(unit(x[row] * shares[:, k]) @ items), unit(text[row, 3 * k : 3 * k + 3])))
                want += [shares[i, k] * np.exp(z @ places[i] / 0.1) for i in range(5)]
            assert np.allclose(got, np.log(want))


def test_text_only_models(spark, history):
    rng = np.random.default_rng(0)
    layer = lambda a, b: (rng.normal(0, 1, (a, b)), np.zeros(b))
    first, second = layer(2, 2), layer(2, 4)
    x, text = np.array([[1.0, 1, 0, 0]]), np.array([[0.5, -1.0]])
    model = neural.make("text", layers=[first, second])
    assert np.allclose(model.logits(x, text), np.tanh(text @ first[0]) @ second[0])
    vae = neural.make("vae", encoder=[layer(4, 4)], decoder=[layer(2, 4)], latent=2)
    blend = neural.make("text_blend", layers=[first, layer(2, 4)], model=vae, gamma=0.3)
    own = (np.tanh(text @ first[0]) @ blend.layers[1][0])[:, :2]
    assert np.allclose(blend.logits(x, text), (0.3 * own + 0.7 * vae.encode(x)) @ vae.decoder[0][0])
    vectors = spark.createDataFrame([(0, [0.5, -1.0])], "user_id long, vector array<double>")
    assert {r.item_index for r in neural.score_users(history, blend, np.arange(4), 4, vectors).collect()} == {2, 3}


def test_pooled_encoder(spark):
    lengths = []

    def tokens(texts):
        lengths.extend(map(len, texts))
        return [np.array([[len(w), 1.0] for w in t.split()]) for t in texts]

    encode = neural.mean_pooled(tokens, 3)
    assert encode(["a bb ccc dddddddd", "xx"]).tolist() == [[2.0, 1.0], [2.0, 1.0]]
    table = spark.createDataFrame([(1, "a bb ccc dddd"), (2, " "), (3, None)], "id int, text string")
    got = {r.id: r.v for r in table.select("id", neural.text_encoder(encode)("text").alias("v")).collect()}
    assert got[2] is None and got[3] is None and np.allclose(got[1], np.array([2, 1]) / 5**0.5)


def test_users_with_many_items_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 4, 300) ** 2 // 4, rng.integers(0, 60, 300), strict=True)})
    table = spark.createDataFrame(rows, "user_id long, item_index long")
    whole = sorted(map(tuple, S.cooccurrence(table).collect()))
    monkeypatch.setattr(S, "HEAVY", 7)
    assert sorted(map(tuple, S.cooccurrence(table).collect())) == whole and whole


def test_unknown_losses_are_refused(spark):
    some = [F.col("v")] * 8
    with pytest.raises(ValueError):
        V.prior_bce(*some, how="js")
    with pytest.raises(ValueError):
        V.disentangled_loss(*some, how="l2")
    empty = spark.createDataFrame([], "batch int, mu array<double>, logvar array<double>, prior_mu array<double>, prior_logvar array<double>")
    assert V.contrastive(empty).count() == 0


def test_command_line(spark, engine, sf_dir, tmp_path, capsys):
    a = cli.parser().parse_args(["demo", "x", "space", "--liked", "Space One (2000)", "--disliked-genre", "Romance", "--top-k", "3"])
    assert [i["title"] for i in cli.demo(spark, engine, a)] == ["Space Two (2001)"]
    a = cli.parser().parse_args(["pipeline", "x", "--liked", "Space One (2000)", "--context", "tonight", "--top-k", "2"])
    out = cli.pipeline(spark, engine, a)
    assert "Space One (2000)" in out["summary"] and len(out["recommendations"]) == 2
    a = cli.parser().parse_args(["pipeline", "x", "--summary", "romance please", "--disliked", "sci-fi"])
    assert cli.pipeline(spark, engine, a) == {"summary": "romance please", "recommendations": cli.demo(spark, engine, cli.parser().parse_args(["demo", "x", "romance please", "--disliked-genre", "sci-fi"]))}
    assert cli.main(["text-training", sf_dir, "--output-dir", str(tmp_path / "texts")]) == 0
    assert json.loads(capsys.readouterr().out)["columns"] == ["user_id", "description"] and spark.read.parquet(str(tmp_path / "texts")).count() > 0
    with pytest.raises(SystemExit):
        cli.main(["unknown"])


def test_evaluation_report(spark, sf_dir, tmp_path):
    a = cli.parser().parse_args(["evaluate", sf_dir, "--output-dir", str(tmp_path)])
    report = cli.evaluate(spark, A.positives(spark, sf_dir), A.catalog(spark, sf_dir), a)
    assert [m["model"] for m in report["models"]] == ["content", "ease", "ease_mmr", "hybrid", "item_cf", "popularity"]
    (file,) = tmp_path.glob("*.json")
    assert json.loads(file.read_text())["models"] == report["models"] and len(report["dataset"]) == 64


def test_masked_mean_and_mixture(spark):
    one = spark.range(1)
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    value = lambda c: one.select(c.alias("v")).first().v
    tokens = F.array(arr(1, 2), arr(3, 4), arr(9, 9))
    assert value(V.masked_mean(tokens, F.array(F.lit(1), F.lit(1), F.lit(0)))) == [2.0, 3.0] and value(V.masked_mean(tokens, F.array(*[F.lit(0)] * 3))) == [0.0, 0.0]
    normal = lambda x, m, v: -0.5 * (v + np.log(2 * np.pi) + (x - m) ** 2 / np.exp(v))
    z, m, lv = np.array([0.3, -1.0]), np.array([0.1, 0.5]), np.array([0.2, -0.4])
    mixture = sum(np.log(3 / 20 * np.exp(normal(a, 0, 0)) + 3 / 4 * np.exp(normal(a, b, c)) + 1 / 10 * np.exp(normal(a, 0, 10))) for a, b, c in zip(z, m, lv, strict=True))
    assert value(V.composite_prior(arr(*z), arr(*m), arr(*lv))) == pytest.approx(mixture)
    logits, labels = np.array([1.0, 2.0]), np.array([0.0, 1.0])
    likelihood = float(((logits - np.log(np.exp(logits).sum())) * labels).sum())
    got = value(V.composite_elbo(arr(*logits), arr(*labels), arr(*z), arr(*m), arr(*lv), arr(*m), arr(*lv), F.lit(0.5)))
    assert got == pytest.approx(0.5 * (normal(z, m, lv).sum() - mixture) - likelihood)


def test_texts_to_items(spark, history, catalog):
    """The older text recommender: fused vectors, cosine, boosts of liked titles, disliked genres left out."""
    words = {"space": [1.0, 0.0], "love": [0.0, 2.0]}
    engine = Engine(history, catalog, 10, encoder=lambda texts: np.array([words[t.strip()] for t in texts]))
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "item_index long, embedding array<double>")
    asked = spark.createDataFrame([(1, "space", " ", [], [], 1.0), (2, "space", "love", ["Mix (2003)"], [" romance"], 0.75), (3, None, "love", ["Love One (2002)", "?"], [], 1.0), (4, "", None, [], [], 1.0)], "query_id long, summary string, context string, liked array<string>, disliked_genres array<string>, alpha double")
    got = {}
    for r in engine.recommend_texts(asked, vectors, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.title, round(r.score, 6), r.rank_label))
    fused = np.array([0.75, 0.25]) / np.hypot(0.75, 0.25)
    assert got == {
        1: [("Space One (2000)", 1.0, "Rank #1"), ("Space Two (2001)", 0.8, "Rank #2"), ("Mix (2003)", 0.6, "Rank #3")],
        2: [("Space One (2000)", round(float(fused[0]), 6), "Rank #1"), ("Space Two (2001)", round(float(fused @ [0.8, 0.6]), 6), "Rank #2")],  # a tie
        3: [("Love One (2002)", 1.15, "Rank #1"), ("Mix (2003)", 0.8, "Rank #2"), ("Space Two (2001)", 0.6, "Rank #3")],
    }
    with pytest.raises(ValueError):
        Engine(history, catalog, 10).recommend_texts(asked, vectors)
    with pytest.raises(ValueError):
        engine.recommend_users(history)
    scored = Engine(history, catalog, 10, scorer=neural.SoftmaxHead(np.ones((1, 4)), np.arange(4.0)))
    own = spark.createDataFrame([(0, [1.0])], "user_id long, vector array<double>")
    assert [r.item_index for r in scored.recommend_users(history, 2, vectors=own).orderBy("rank").collect()] == [3, 2]


def test_ease_comparison_equals_plain_numpy(spark, sf_dir):
    from lumenreel.plans import evaluate

    p = evaluate.Protocol(A.positives(spark, sf_dir), A.catalog(spark, sf_dir))
    got = {r.model: r for r in p.ease_comparison().collect()}
    items = sorted(r[0] for r in p.catalog.select("item_index").collect())
    at = {x: i for i, x in enumerate(items)}
    rows = p.history.collect()
    users = {u: k for k, u in enumerate(sorted({r.user_id for r in rows}))}
    x = np.zeros((len(users), len(items)))
    for r in rows:
        x[users[r.user_id], at[r.item_index]] = 1
    inverse = np.linalg.inv(x.T @ x + 500 * np.eye(len(items)))
    b = inverse / -np.diag(inverse)
    np.fill_diagonal(b, 0)
    scores = np.where(x > 0, -np.inf, np.round(x @ b, 9))
    test = {r.user_id for r in p.users.where("NOT is_validation").collect()}
    goals = [(r.user_id, r.target) for r in p.targets.collect() if r.user_id in test]
    ranks = []
    for user, target in goals:
        line = scores[users[user]]
        best = sorted(range(len(items)), key=lambda i: (-line[i], i))[:10]
        ranks.append(best.index(at[target]) + 1 if at[target] in best else None)
    hits = [r for r in ranks if r]
    assert got["ease"].users == len(goals) and got["ease"].recall == pytest.approx(len(hits) / len(goals)) and got["ease"].ndcg == pytest.approx(sum(1 / np.log2(r + 1) for r in hits) / len(goals))
    assert got["ease_mmr"].penalty in evaluate.PENALTIES and got["ease_mmr"].users == len(goals)
    searched = p.penalty_search("ease").collect()
    assert len(searched) == 5 and searched[0].penalty == got["ease_mmr"].penalty
    p.release()


def test_remap_union_anneal_and_orders(spark):
    assert spark.range(1).select(X.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))).alias("u")).first().u == ["b", "a", "c"]
    assert [V.anneal(s, 10) for s in (0, 2, 9)] == [0.0, 0.2, 0.5]
    users = I.permuted_users([5, 3, 9, 1], 7)
    assert sorted(users) == [1, 3, 5, 9] and users == I.permuted_users([9, 5, 1, 3], 7)
    movies = spark.createDataFrame([(10, "x"), (11, "y")], "movie_id int, title string")
    assert [tuple(r) for r in I.remap(movies, spark.createDataFrame([(11, 0)], "movie_id int, new int"), "movie_id", "new").select("movie_id", "title").collect()] == [(0, "y")]
    vote = R.by_vote(spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", 3.0)], "title string, vote_average double"))
    assert [(r.title, r["rank"], r.rank_label) for r in vote.orderBy("rank").collect()] == [("c", 1, "Rank #1"), ("d", 2, "Rank #2"), ("a", 3, "Rank #3"), ("b", 4, "Rank #4")]


def test_means_at_lengths_and_top_genres(spark):
    ranked = spark.createDataFrame([(1, r, r) for r in range(1, 31)], "user_id long, rank int, item_index long")
    own = spark.createDataFrame([(1, 1), (1, 15), (1, 30)], "user_id long, item_index long")
    got = {r.k: (r.users, round(r.recall, 6), r.mrr) for r in M.many_positive_means(ranked, own).collect()}
    assert got == {10: (1, round(1 / 3, 6), 1.0), 20: (1, round(2 / 3, 6), 1.0), 50: (1, 1.0, 1.0)}
    changes = spark.createDataFrame([(1, "a", 1.0, 2.0), (2, "b", 3.0, 4.0)], "user_id long, up_genre string, change_down double, change_up double")
    only = M.mean_changes(changes, spark.createDataFrame([("b",)], "genre string")).collect()
    assert {(r.up_genre, r.users, r.change_down) for r in only} == {(None, 2, 2.0), ("b", 1, 3.0)}
    mean = M.mean_of(spark.createDataFrame([(1.0, 2.0, 6.0)], "a double, b double, c double"), ["a", "b", "c"], "m").first()
    assert mean.m == 3.0


def test_similar_items_are_read_by_item(spark, sf_dir, monkeypatch):
    """Where all similar items do not fit in memory, those of the profiles alone are read, with the same sums; genres are read by block."""
    history, catalog = I.history_of(I.leave_one_out(A.positives(spark, sf_dir))), A.catalog(spark, sf_dir)
    side = ItemSide(catalog, S.popularity(history, catalog), 64)
    side.with_similar(S.item_similarity(side.placed(history)), placed=True)
    profiles = [np.array([0, 70, 130]), np.array([], np.int64), np.array([5, 6])]
    whole = similar_to(side.items, profiles)
    monkeypatch.setattr(folders, "MOST_KEPT", 0)
    sizes, read = [], folders.read_ranges
    monkeypatch.setattr(folders, "read_ranges", lambda path, ranges: [sizes.append(len(b)) or b for b in read(path, ranges)])
    by_item = similar_to(side.items, profiles)
    assert all((a == b).all() for a, b in zip(whole, by_item, strict=True)) and len(whole[0])
    assert sum(sizes) < side.items.n_similar * 12 / 2
    assert [x for s in itemside.portions(side.items, profiles, 1) for x in range(s.start, s.stop)] == [0, 1, 2]
    assert len(list(itemside.portions(side.items, profiles, 1))) > 1
    monkeypatch.setattr(itemside.Items, "whole", lambda *_: 1 / 0)
    assert len(S._Lists(side.items).has) == len(S._Lists(side.items).starts)


def test_collaborative_scores_without_a_join(spark):
    history = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 3)], "user_id long, item_index long")
    catalog = spark.createDataFrame([(i, ["a"]) for i in (1, 2, 3)], "item_index long, genres array<string>")
    similarity = S.item_similarity(history)
    want = history.join(similarity, history.item_index == similarity.item_i).groupBy("user_id", "item_j").agg(F.round(F.sum("sim"), 9))
    side = ItemSide(catalog, S.popularity(history, catalog), 2)
    side.with_similar(S.item_similarity(side.placed(history)), placed=True)
    scores = S.collaborative(history, side)
    assert sorted((r.user_id, r.item_index, round(r.score, 9)) for r in scores.collect()) == sorted(map(tuple, want.collect()))
    assert "MapInPandas" in scores._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_made_by_tasks_in_proportion(spark, monkeypatch):
    rows = spark.createDataFrame([(u, (u * 7 + i * i) % 40) for u in range(30) for i in range(12)], "user_id long, item_index long").distinct()
    whole = sorted(map(tuple, S.cooccurrence(rows).collect()))
    monkeypatch.setattr(S, "PAIRS", 100)
    monkeypatch.setattr(S, "HEAVY", 9)  # some users are cut
    cut = S.cooccurrence(rows)
    parts = S._parts(rows)
    assert parts > 8 and "hashpartitioning(user_id#" in (plan := cut._jdf.queryExecution().executedPlan().toString()) and f", {parts}), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, cut.collect())) == whole and whole


def test_genres_are_counted_by_tasks_in_proportion(spark, monkeypatch):
    """Each user's rows in one of as many partitions as the rows ask for; genres meet in no other shuffle."""
    monkeypatch.setattr(I, "PART", 10)
    history = spark.createDataFrame([(u, i) for u in range(12) for i in range(5)], "user_id long, item_index long")
    catalog = spark.createDataFrame([(i, ["a", f"g{i}"]) for i in range(5)], "item_index long, genres array<string>")
    shares = S.genre_proportions(history, catalog)
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert ", 6), REPARTITION_BY_NUM" in plan and "hashpartitioning(user_id#" in plan and ", genre#" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    assert {(r.user_id, r.genre): r.share for r in shares.collect()} == {(u, g): 0.5 if g == "a" else 0.1 for u in range(12) for g in ["a", *[f"g{i}" for i in range(5)]]}


def plain_cold_start(rows, catalog, popularity):
    """Lists of requests (genres, disliked, excluded, k) by plain loops."""
    out = {}
    for r in rows:
        raw = {i: sum(g in genres for g in r.genres) / max(len(r.genres), 1) for i, _, genres in catalog}
        low, span = min(raw.values()), max(raw.values()) - min(raw.values())
        best = {}
        for i, title, genres in catalog:
            if title in r.excluded or {g.lower() for g in genres} & set(r.disliked):
                continue
            content = (raw[i] - low) / span if span > 1e-12 else 0.0
            key = (-round(0.85 * content + 0.15 * popularity[i] if r.genres else popularity[i], 9), i)
            best[title] = min(best.get(title, key), key)
        out[r.request_id] = [(i, round(-s, 6)) for s, i in sorted(best.values())[: r.top_k]]
    return out


def test_cold_start_by_lists(spark):
    """Requests meet no table of items: shared titles, dislikes and exclusions, lists longer than what is allowed."""
    genres = lambda i: ["Aa", "Bb", "Cc", "Dd"][i % 3 : i % 3 + 1 + i % 2]
    items = [(i, f"title {i // 4 if i < 80 else i}", genres(i)) for i in range(200)]
    catalog = spark.createDataFrame(items, "item_index long, norm_title string, genres array<string>")
    popularity = {i: ((i * 37) % 50) / 49 for i, _, _ in items}
    popular = spark.createDataFrame(list(popularity.items()), "item_index long, popularity double")
    asked = [(n, 1 + n % 60 if n % 7 else 300, [["Aa"], [], ["Aa", "Cc"], ["Bb", "Dd"]][n % 4], [["cc"], [], ["aa", "zz"]][n % 3], [f"title {n}", "title 3"] if n % 2 else []) for n in range(40)]
    schema = "request_id long, top_k int, genres array<string>, disliked array<string>, excluded array<string>"
    rows = spark.createDataFrame(asked, schema).withColumn("liked_items", F.array().cast("array<bigint>"))
    answers = Q.cold_start(rows, catalog, popular)
    got = {}
    for r in answers.orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append((r.item_index, round(r.score, 6)))
    assert got == plain_cold_start(rows.collect(), items, popularity)
    plan = answers._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lists_by_genres_read_few_signatures(spark):
    """Of many signatures that tie, those with the smallest items are read, not the head of every one."""
    n = 4000
    catalog = spark.range(n).select(F.col("id").alias("item_index"), F.array(F.concat(F.lit("g"), (F.col("id") % 400).cast("string"))).alias("genres"))
    lists = S._Lists(ItemSide(catalog, catalog.select("item_index", F.lit(0.5).alias("popularity"))).items)
    read = 0

    class Counted(np.ndarray):
        def __getitem__(self, at):
            nonlocal read
            out = super().__getitem__(at)
            read += np.size(out)
            return out

    lists.seen = lists.seen.view(Counted)
    places, scores = lists.best(np.ones(400), 0.0, np.arange(400), np.arange(0), (np.empty(0, np.int64), np.empty(0)), 10)
    assert lists.items[places].tolist() == list(range(10)) and (scores == 1).all() and read < 400


def test_columns_without_a_matrix_equal_the_dense_inverse(spark, monkeypatch):
    """Three sets of users and items that nothing connects, one user of very many items, items without users: no block is written."""
    rng = np.random.default_rng(3)
    pairs = {(u, int(i) * 3 + u % 3) for u in range(60) for i in rng.integers(0, 30, 2 + u % 6)} | {(60, i) for i in range(0, 90, 3)} | {(61, 2)}
    pairs = [(u, i) for u, i in sorted(pairs) if i < 87]  # 87 and above have no users
    history = spark.createDataFrame(pairs, "user_id long, item_index long")
    catalog = spark.range(100).select(F.col("id").alias("item_index"), F.concat(F.lit("t"), "id").alias("norm_title"), F.array(F.concat(F.lit("g"), (F.col("id") % 4).cast("string"))).alias("genres"))
    popular = S.popularity(history, catalog)
    x = np.zeros((62, 100))
    x[tuple(np.array(pairs).T)] = 1
    p = np.linalg.inv(x.T @ x + 5 * np.eye(100))
    b = p / -np.diag(p)
    np.fill_diagonal(b, 0)
    dense = ItemSide(catalog, popular, 7)
    by_blocks = linear.fit(history, dense, 5.0)
    assert by_blocks.groups is None
    for name, value in (("GROUP", 40), ("PART", 30), ("WIDE", 5), ("TASK", 8), ("LONG", 4), ("ROWS", 16)):
        monkeypatch.setattr(linear.sparse, name, value)
    monkeypatch.setattr(linear, "MOST_FILES", 0)
    monkeypatch.setattr(linear, "USERS_OF_TASK", 6)
    asked = [(n, 12, ["g1", "g2"][: n % 3], [[3], [], [4, 9, 50], [95], [95, 2]][n % 5], [[], ["g3"]][n % 2], ["t7"]) for n in range(15)]
    rows = spark.createDataFrame(asked, "request_id long, top_k int, genres array<string>, liked_items array<long>, disliked array<string>, excluded array<string>")
    key = lambda df: sorted((r.request_id, r["rank"], r.item_index, round(r.score, 8), round(r.ease, 8)) for r in df.collect())
    for rounds in (linear.sparse.LABELS, 0):  # without rounds, all is one group
        monkeypatch.setattr(linear.sparse, "LABELS", rounds)
        side = ItemSide(catalog, popular, 7)
        weights = linear.fit(history, side, 5.0)
        assert len(weights.groups) >= 3 if rounds else len(weights.groups) == 1
        assert not weights.files and sum(len(g.parts) for g in weights.groups) > len(weights.groups)
        assert np.allclose(whole_weights(weights, side), b, atol=1e-10)
        checked = linear.check(history, side, weights, 5.0).toPandas().sort_values("item_index")
        most = np.where(np.eye(100) > 0, -np.inf, b).max(axis=0)
        assert len(checked) == 100 and checked.deviation.max() < 1e-9 and np.allclose(checked.own_inverse, np.diag(p)) and np.allclose(checked.weight_sum, b.sum(axis=0)) and np.allclose(checked.largest_weight, most)
        got = {}
        for r in S.recommend_users(history, side, {"ease": "ease"}, 9, weights).orderBy("user_id", "rank").collect():
            got.setdefault(r.user_id, []).append(r.item_index)
        want = np.where(x > 0, -np.inf, np.round(x @ b, 9) + 0.0)
        assert got == {u: sorted(range(100), key=lambda i: (-want[u, i], i))[:9] for u in range(62) if x[u].any()}
        assert key(Q.answer(rows, side, weights)) == key(Q.answer(rows, dense, by_blocks))


@pytest.mark.parametrize("penalty", [500.0, 20.0, 0.05])
def test_columns_are_solved_in_single_precision(monkeypatch, penalty):
    """Few products are made in double precision, none of them whole for the diagonal, and both are as exact as before."""
    sparse, rng, double = linear.sparse, np.random.default_rng(5), [0]
    x = (rng.random((300, 200)) < 0.05).astype(float)
    x[:, 0] = 1  # of every user
    part = {"at": np.append(0, np.cumsum(x.sum(axis=1))).astype(np.int64), "place": np.nonzero(x)[1]}
    monkeypatch.setattr(sparse.folders, "read_arrays", lambda path, keep=True: part)
    product = sparse.product

    def counted(group, places, d, *rest):
        double[0] += d.dtype == np.float64
        return product(group, places, d, *rest)

    monkeypatch.setattr(sparse, "product", counted)
    group, places, p = sparse.Group(200, 300, parts=[f"memory {penalty}"]), np.arange(200), np.linalg.inv(x.T @ x + penalty * np.eye(200))
    assert np.allclose(sparse.own_inverse(group, places, 3, 200, penalty, 1 << 20), np.diag(p)[3:], rtol=1e-9, atol=0)
    assert double[0] == 0 or penalty < 500
    double[0] = 0
    assert np.abs(sparse.solved(group, places, x[:40].T.copy(), penalty) - p @ x[:40].T).max() < 1e-11 / min(penalty, 1)
    assert double[0] <= 3 or penalty < 1


def test_lists_of_the_linear_autoencoder_are_made_once(spark, sf_dir, monkeypatch):
    """Those of validation and test users, plain and reranked; and what is checked needs no diagonal beforehand."""
    from lumenreel.plans.queries import QUERIES

    asked, solved = [], []
    recommend, by_columns = linear.recommend, linear._by_columns
    monkeypatch.setattr(linear, "recommend", lambda *a: asked.append(a[-1]) or recommend(*a))
    monkeypatch.setattr(linear, "_by_columns", lambda *a: solved.append(by_columns(*a)) or solved[-1])
    monkeypatch.setattr(linear, "MOST_FILES", 0)
    p = evaluate.Protocol(adapter.positives(spark, sf_dir), adapter.catalog(spark, sf_dir))
    p.ease_comparison()
    p.release()
    assert asked == [50]
    rows = QUERIES["ease_identity"](spark, sf_dir)
    assert not any(g.diagonal for g in solved[-1].groups) and rows.where("deviation <> 0").isEmpty()


def test_encoder_decoder_by_blocks_equals_the_whole(spark, monkeypatch):
    """Lists over several blocks of items, with ties and users of nearly all items; a task holds a block of logits."""
    rng, n = np.random.default_rng(5), 2500
    layer = lambda a, b: (np.round(rng.normal(0, 1, (a, b)), 1), rng.normal(0, 1, b))
    first, second, third, last = layer(n, 4), layer(4, 4), layer(2, 4), layer(4, n)
    last[0][:, 1::2], last[1][1::2] = last[0][:, ::2], last[1][::2]  # items tie in pairs
    ids = np.sort(rng.permutation(9000)[:n])
    pairs = {(u, int(i)) for u in range(40) for i in rng.choice(ids, 1 + u)} | {(40, int(i)) for i in ids[:-3]}
    history = spark.createDataFrame(sorted(pairs), "user_id long, item_index long")
    whole = neural.make("vae", encoder=[first, second], decoder=[third, last], latent=2)
    none = (np.eye(4), np.zeros(4))
    inner = neural.make("vae", encoder=[(np.eye(4), first[1]), second], decoder=[third, none], latent=2, normalize=False)
    at = iter(range(0, n, neural.WIDE))

    def rows(size):
        begin = next(at)
        return first[0][begin : begin + size]

    blocks = neural.write_blocks(spark.createDataFrame([(int(i),) for i in ids], "item_index long"), inner, rows, iter([*last[0], last[1]]))
    assert len(blocks.files) == 3
    key = lambda df: sorted((r.user_id, r["rank"], r.item_index, round(r.score, 7)) for r in df.collect())
    got = key(neural.score_blocks(history, blocks, 7))
    assert got == key(neural.score_users(history, whole, ids, 7)) and len(got) == 40 * 7 + 3
    monkeypatch.setattr(neural, "CELLS", 5 * n)
    assert key(neural.score_users(history, whole, ids, 7)) == got


def test_blocks_are_scored_for_items_that_can_be_best(spark, monkeypatch, tmp_path):
    """Hidden values of two axes: logits are made of few items, and lists are those of all of them."""
    rng, n = np.random.default_rng(6), 20 * neural.WIDE
    first, last = rng.normal(0, 0.01, (n, 8)), rng.normal(0, 1, (8, n))
    second, third = (rng.normal(0, 0.3, (8, 4)), np.zeros(4)), (rng.normal(0, 0.3, (2, 8)), np.zeros(8))
    bias = rng.normal(0, 1e-4, n)
    history = spark.createDataFrame([(u, int(i)) for u in range(50) for i in rng.choice(n, 6, replace=False)], "user_id long, item_index long")
    none = (np.eye(8), np.zeros(8))
    inner = neural.make("vae", encoder=[none, second], decoder=[third, none], latent=2, normalize=False)
    at = iter(range(0, n, neural.WIDE))
    blocks = neural.write_blocks(spark.range(n).withColumnRenamed("id", "item_index"), inner, lambda size: first[(b := next(at)) : b + size], iter([*last, bias]))
    whole = neural.make("vae", encoder=[(first, np.zeros(8)), second], decoder=[third, (last, bias)], latent=2)
    key = lambda df: sorted((r.user_id, r["rank"], r.item_index, round(r.score, 7)) for r in df.collect())
    want, best_of_rows = key(neural.score_users(history, whole, np.arange(n), 5)), neural.best_of_rows

    def counted(scores, k):
        with open(tmp_path / "widths", "a") as f:
            f.write(f"{scores.shape[1]}\n")
        return best_of_rows(scores, k)

    monkeypatch.setattr(neural, "best_of_rows", counted)
    assert key(neural.score_blocks(history, blocks, 5)) == want and len(want) == 50 * 5
    assert sum(map(int, (tmp_path / "widths").read_text().split())) < n / 4
