"""The registered queries of the recommendation operators, over the adapter's tables, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import folders
from ..functions import text as X
from ..functions import vectors as V
from ..operators import interactions as I
from ..operators import linear, nearest
from ..operators import metrics as M
from ..operators import models as S
from ..operators import neural
from ..operators import ranking as R
from ..operators import requests as Q
from ..operators.itemside import ItemSide
from ..sources import adapter as A
from ..sources import readers
from ..streaming.counts import windowed_counts
from . import evaluate
from .evaluate import Protocol

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True, recursive: str = ""):
    """Registers a query; sql goes on from the adapter's tables if base holds, as a recursive one if it says so."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH {recursive}{A.SQL}, {sql}" if sql.lstrip().split()[1] == "AS" else f"WITH {A.SQL} {sql}") if base else sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


# Interactions


@query("SELECT DISTINCT user_id, item_index FROM positives")
def binary_interactions(spark: SparkSession, d: str) -> DataFrame:
    return I.binary_matrix(A.positives(spark, d))


@query("SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1)::BIGINT AS row_id FROM (SELECT DISTINCT user_id FROM positives)")
def dense_user_ids(spark, d):
    return I.dense_ids(A.positives(spark, d), "user_id", "row_id")


@query("SELECT user_id, movie_id, arg_max(rating, (pos, rating)) AS rating FROM ratings GROUP BY ALL")
def last_rating_matrix(spark, d):
    return I.last_rating_matrix(A.ratings(spark, d))


@query("""i AS (SELECT movie_id FROM ratings GROUP BY 1 HAVING count(*) >= 25 ORDER BY count(*) DESC, movie_id LIMIT 1000),
a AS (SELECT * FROM ratings WHERE movie_id IN (SELECT movie_id FROM i)),
u AS (SELECT user_id FROM a GROUP BY 1 HAVING count(*) >= 10 ORDER BY count(*) DESC, user_id LIMIT 1000),
k AS (SELECT * FROM a WHERE user_id IN (SELECT user_id FROM u))
SELECT user_id, movie_id, rating, pos, dense_rank() OVER (ORDER BY user_id) - 1 AS new_user, dense_rank() OVER (ORDER BY movie_id) - 1 AS new_movie FROM k""")
def rating_subset(spark, d):
    return I.subset(A.ratings(spark, d), 25, 1000, 10, 1000).select("user_id", "movie_id", "rating", "pos", "new_user", "new_movie")


_SPLIT = """n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_index DESC) AS r FROM positives),
split AS (SELECT user_id, item_index, ts, r = 1 AS is_target FROM n WHERE n >= 5),
targets AS (SELECT user_id, item_index AS target FROM split WHERE is_target),
history AS (SELECT DISTINCT user_id, item_index FROM split WHERE NOT is_target)"""


@query(f"{_SPLIT} SELECT * FROM split")
def leave_one_out_split(spark, d):
    return I.leave_one_out(A.positives(spark, d))


_VALID = f"""{_SPLIT}, users AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id::VARCHAR || '2026')) <= greatest(1, floor(count(*) OVER () / 5)) AS is_validation FROM targets)"""


@query(f"{_VALID} SELECT * FROM users")
def validation_mask(spark, d):
    return I.validation_users(I.targets_of(I.leave_one_out(A.positives(spark, d))).select("user_id"))


@query("""SELECT e.key::INT AS id, (SELECT substr(string_agg(s, ' ' ORDER BY k), 1, 80) FROM (SELECT unnest(range(3)) AS k) q,
  LATERAL (SELECT n_name AS s FROM nation WHERE n_nationkey = e.key + q.k)) AS summary FROM (SELECT r_regionkey AS key FROM region) e""", base=False)
def saved_summaries(spark, d):
    nation = A.table(spark, d, "nation")
    saved = nation.select(F.concat(F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ".0").otherwise("")).alias("key"), F.col("n_name").alias("summary"))
    asked = A.table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("r_regionkey") + i).alias("keys"))
    return I.lookup_variants(asked, saved, 3, 80)


@query("SELECT user_id, event_type, count(*) AS n, count(DISTINCT props) AS n_props, round(sum(value), 4) AS total FROM events GROUP BY ALL HAVING count(*) >= 2", base=False)
def event_counts(spark, d):
    rows = A.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.countDistinct("props").alias("n_props"), F.round(F.sum("value"), 4).alias("total"))
    return rows.where("n >= 2")


@query("SELECT DISTINCT user_id, (props->>'$.k')::INT AS k FROM events", base=False)
def event_properties(spark, d):
    rows = A.table(spark, d, "events")
    return rows.select("user_id", F.from_json("props", "k int")["k"].alias("k")).distinct()


# Item models


@query(f"""{_SPLIT}, c AS (SELECT catalog.item_index, count(DISTINCT user_id) AS n FROM catalog LEFT JOIN history USING (item_index) GROUP BY 1), l AS (SELECT *, ln(1 + n::DOUBLE) AS v FROM c)
SELECT item_index, n, round((v - (SELECT min(v) FROM l)) / (SELECT max(v) - min(v) FROM l), 6) AS popularity FROM l""")
def popularity_scores(spark, d):
    history = I.history_of(I.leave_one_out(A.positives(spark, d)))
    return S.popularity(history, A.catalog(spark, d)).select("item_index", "n", r6("popularity").alias("popularity"))


_PAIRS = f"{_SPLIT}, pairs AS (SELECT a.item_index AS item_i, b.item_index AS item_j, count(*) AS n FROM history a JOIN history b USING (user_id) WHERE a.item_index < b.item_index GROUP BY ALL)"


@query(f"{_PAIRS} SELECT * FROM pairs")
def item_cooccurrence(spark, d):
    return S.cooccurrence(folders.stored(I.history_of(I.leave_one_out(A.positives(spark, d))), "history"))


@query(f"""{_PAIRS}, c AS (SELECT item_index, count(*)::DOUBLE AS c FROM history GROUP BY 1), b AS (SELECT * FROM pairs UNION ALL SELECT item_j, item_i, n FROM pairs)
SELECT item_i, item_j, round(n * pow(i.c, -0.3) * pow(j.c, -0.7) * n / (n + 10.0::DOUBLE), 6) AS sim FROM b JOIN c i ON i.item_index = item_i JOIN c j ON j.item_index = item_j""")
def shrunk_similarity(spark, d):
    sims = S.item_similarity(folders.stored(I.history_of(I.leave_one_out(A.positives(spark, d))), "history"), 0.3, 10)
    return sims.select("item_i", "item_j", r6("sim").alias("sim"))


@query(f"""{_SPLIT}, g AS (SELECT user_id, unnest(genres) AS genre FROM history JOIN catalog USING (item_index)), c AS (SELECT user_id, genre, count(*) AS n FROM g GROUP BY ALL)
SELECT user_id, genre, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM c""")
def genre_proportions(spark, d):
    history = folders.stored(I.history_of(I.leave_one_out(A.positives(spark, d))), "history")
    return S.genre_proportions(history, A.catalog(spark, d)).select("user_id", "genre", r6("share").alias("share"))


@query(f"""{_SPLIT}, own AS (SELECT DISTINCT user_id, unnest(genres) AS genre FROM history JOIN catalog USING (item_index)), s AS (SELECT user_id, count(*) AS size FROM own GROUP BY 1),
i AS (SELECT DISTINCT item_index, unnest(genres) AS genre FROM catalog), h AS (SELECT user_id, item_index, count(*) AS hits FROM own JOIN i USING (genre) GROUP BY ALL),
x AS (SELECT h.user_id, item_index, hits / size::DOUBLE AS content FROM h JOIN s USING (user_id) WHERE NOT EXISTS (FROM history y WHERE y.user_id = h.user_id AND y.item_index = h.item_index)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY content DESC, item_index) AS rank FROM x) SELECT user_id, item_index, round(content, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10""")
def content_top_10(spark, d):
    history, catalog = folders.stored(I.history_of(I.leave_one_out(A.positives(spark, d))), "history"), A.catalog(spark, d)
    ranked = S.recommend_users(history, ItemSide(catalog, S.popularity(history, catalog)), {"content": S.Blend(1.0, 0.0)})
    return ranked.select("user_id", "item_index", r6("score").alias("score"), "rank")


@query(f"""{_PAIRS}, c AS (SELECT item_index, count(*)::DOUBLE AS c FROM history GROUP BY 1), b AS (SELECT * FROM pairs UNION ALL SELECT item_j, item_i, n FROM pairs),
s AS (SELECT item_i, item_j, n * pow(i.c, -0.5) * pow(j.c, -0.5) AS sim FROM b JOIN c i ON i.item_index = item_i JOIN c j ON j.item_index = item_j),
x AS (SELECT h.user_id, item_j AS item_index, sum(sim) AS score FROM history h JOIN s ON h.item_index = item_i GROUP BY ALL)
SELECT user_id, count(*) AS n, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM x GROUP BY 1""")
def collaborative_scores(spark, d):
    history, catalog = folders.stored(I.history_of(I.leave_one_out(A.positives(spark, d))), "history"), A.catalog(spark, d)
    side = ItemSide(catalog, S.popularity(history, catalog))
    side.with_similar(S.item_similarity(side.placed(history)), placed=True)
    scores = S.collaborative(history, side)
    return scores.groupBy("user_id").agg(F.count("*").alias("n"), r6(F.max("score")).alias("best"), F.round(F.sum("score"), 4).alias("total"))


_COMPONENTS = f"""{_PAIRS}, c AS (SELECT item_index, count(*)::DOUBLE AS c FROM history GROUP BY 1), b AS (SELECT * FROM pairs UNION ALL SELECT item_j, item_i, n FROM pairs),
sims AS (SELECT item_i, item_j, n * pow(i.c, -0.5) * pow(j.c, -0.5) AS sim FROM b JOIN c i ON i.item_index = item_i JOIN c j ON j.item_index = item_j),
cf AS (SELECT h.user_id, item_j AS item_index, sum(sim) AS v FROM history h JOIN sims ON h.item_index = item_i GROUP BY ALL),
own AS (SELECT DISTINCT user_id, unnest(genres) AS genre FROM history JOIN catalog USING (item_index)), size AS (SELECT user_id, count(*) AS size FROM own GROUP BY 1),
ig AS (SELECT DISTINCT item_index, unnest(genres) AS genre FROM catalog), ct AS (SELECT user_id, item_index, count(*) AS hits FROM own JOIN ig USING (genre) GROUP BY ALL),
pc AS (SELECT catalog.item_index, ln(1 + count(user_id)::DOUBLE) AS v FROM catalog LEFT JOIN history USING (item_index) GROUP BY 1),
pop AS (SELECT item_index, (v - (SELECT min(v) FROM pc)) / (SELECT max(v) - min(v) FROM pc) AS popularity FROM pc),
raw AS (SELECT u.user_id, p.item_index, coalesce(cf.v, 0) AS cf, coalesce(ct.hits, 0) / size.size::DOUBLE AS ct, p.popularity FROM (SELECT DISTINCT user_id FROM history) u CROSS JOIN pop p
  JOIN size USING (user_id) LEFT JOIN cf ON cf.user_id = u.user_id AND cf.item_index = p.item_index LEFT JOIN ct ON ct.user_id = u.user_id AND ct.item_index = p.item_index),
parts AS (SELECT user_id, item_index, popularity, CASE WHEN max(cf) OVER w - min(cf) OVER w > 1e-12 THEN (cf - min(cf) OVER w) / (max(cf) OVER w - min(cf) OVER w) ELSE 0 END AS cf,
  CASE WHEN max(ct) OVER w - min(ct) OVER w > 1e-12 THEN (ct - min(ct) OVER w) / (max(ct) OVER w - min(ct) OVER w) ELSE 0 END AS ct FROM raw WINDOW w AS (PARTITION BY user_id)),
open AS (SELECT p.* FROM parts p ANTI JOIN history h ON h.user_id = p.user_id AND h.item_index = p.item_index)"""
_HYBRID = "round(0.8::DOUBLE * cf + 0.15::DOUBLE * ct + 0.05::DOUBLE * popularity, 9)"


@query(f"""{_COMPONENTS}, r AS (SELECT user_id, item_index, {_HYBRID} AS score, row_number() OVER (PARTITION BY user_id ORDER BY {_HYBRID} DESC, item_index) AS rank FROM open)
SELECT user_id, rank::INT AS rank, item_index, round(score, 6) AS score FROM r WHERE rank <= 10""")
def hybrid_recommendations(spark, d):
    p = Protocol(A.positives(spark, d), A.catalog(spark, d))
    return p.lists({"hybrid": S.Weights()}).select("user_id", "rank", "item_index", r6("score").alias("score"))


_METRICS = """, ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, user_id ORDER BY score DESC, item_index) AS rank FROM scored) WHERE rank <= 10),
hit AS (SELECT model, count(*) AS hits, sum(1 / log2(rank + 1)) AS gain, sum(1 / rank::DOUBLE) AS rr FROM ranked JOIN goal ON ranked.user_id = goal.user_id AND item_index = target GROUP BY 1),
lists AS (SELECT model, count(DISTINCT item_index) AS items, avg(popularity) AS mp FROM ranked GROUP BY 1),
jac AS (SELECT a.model, a.user_id, avg(CASE WHEN len(list_distinct(x.genres || y.genres)) > 0 THEN len(list_intersect(x.genres, y.genres)) / len(list_distinct(x.genres || y.genres))::DOUBLE ELSE 0 END) AS j
  FROM ranked a JOIN ranked b ON a.model = b.model AND a.user_id = b.user_id AND a.rank < b.rank JOIN catalog x ON x.item_index = a.item_index JOIN catalog y ON y.item_index = b.item_index GROUP BY ALL),
dv AS (SELECT model, avg(1 - j) AS diversity FROM jac GROUP BY 1)
SELECT model, (SELECT count(*) FROM goal) AS users, round(coalesce(hits, 0) / (SELECT count(*) FROM goal), 6) AS recall, round(coalesce(gain, 0) / (SELECT count(*) FROM goal), 6) AS ndcg,
  round(coalesce(rr, 0) / (SELECT count(*) FROM goal), 6) AS mrr, round(items / (SELECT count(*) FROM catalog), 6) AS coverage, round(diversity, 6) AS diversity, round(mp, 6) AS mean_popularity
FROM lists LEFT JOIN hit USING (model) LEFT JOIN dv USING (model)"""
_USERS = """, users AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id::VARCHAR || '2026')) <= greatest(1, floor(count(*) OVER () / 5)) AS is_validation FROM targets),
goal AS (SELECT targets.* FROM targets JOIN users USING (user_id) WHERE {which}),
scored AS (SELECT model, o.user_id, item_index, popularity, round((a * cf + b * ct + c * popularity) / (a + b + c), 9) AS score FROM open o JOIN users USING (user_id) CROSS JOIN w WHERE {which})"""


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select("model", "users", *[r6(c).alias(c) for c in ("recall", "ndcg", "mrr", "coverage", "diversity", "mean_popularity")])


@query(_COMPONENTS + """, w AS (SELECT * FROM (VALUES ('popularity', 0::DOUBLE, 0::DOUBLE, 1::DOUBLE), ('content', 0, 1, 0), ('item_cf', 1, 0, 0), ('hybrid', 0.8, 0.15, 0.05)) w(model, a, b, c))"""
       + _USERS.format(which="NOT is_validation") + _METRICS)
def model_comparison(spark, d):
    return _rounded(Protocol(A.positives(spark, d), A.catalog(spark, d)).comparison())


_GRID = "w AS (SELECT a || '/' || b || '/' || c AS model, a, b, c FROM (SELECT unnest([0.6, 0.8, 1.0]::DOUBLE[]) AS a), (SELECT unnest([0.0, 0.15, 0.3]::DOUBLE[]) AS b), (SELECT unnest([0.0, 0.05, 0.1]::DOUBLE[]) AS c))"


@query(_COMPONENTS + ", " + _GRID + _USERS.format(which="is_validation") + """, ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, user_id ORDER BY score DESC, item_index) AS rank FROM scored) WHERE rank <= 10),
hit AS (SELECT model, sum(1 / log2(rank + 1)) AS gain FROM ranked JOIN goal ON ranked.user_id = goal.user_id AND item_index = target GROUP BY 1)
SELECT model, round(coalesce(gain, 0) / (SELECT count(*) FROM goal), 6) AS ndcg, a AS collaborative, b AS content, c AS popularity FROM w LEFT JOIN hit USING (model)""")
def weight_search(spark, d):
    return Protocol(A.positives(spark, d), A.catalog(spark, d)).weight_search().withColumn("ndcg", r6("ndcg"))


@query(f"""{_SPLIT}, pc AS (SELECT catalog.item_index, ln(1 + count(user_id)::DOUBLE) AS v FROM catalog LEFT JOIN history USING (item_index) GROUP BY 1),
pop AS (SELECT item_index, round((v - (SELECT min(v) FROM pc)) / (SELECT max(v) - min(v) FROM pc), 9) AS score FROM pc),
x AS (SELECT u.user_id, pop.item_index, score FROM (SELECT DISTINCT user_id FROM history) u CROSS JOIN pop ANTI JOIN history h ON h.user_id = u.user_id AND h.item_index = pop.item_index),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_index) AS rank FROM x)
SELECT count(*) AS users, round(avg(coalesce(1 / log2(rank + 1), 0)), 6) AS ndcg, round(avg(CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS recall
FROM targets t LEFT JOIN (FROM r WHERE rank <= 10) r ON r.user_id = t.user_id AND r.item_index = t.target""")
def loo_popularity_metrics(spark, d):
    """Popularity lists without a list: a target's rank is its place in the catalog less the user's items before it."""
    split = I.leave_one_out(A.positives(spark, d))
    history, targets = I.history_of(split), I.targets_of(split)
    popular = S.popularity(history, A.catalog(spark, d)).select("item_index", F.round("popularity", S.DIGITS).alias("score"))
    ranks = R.rank_among_unseen(targets.withColumnRenamed("target", "item_index"), history, R.placed(popular))
    met = ranks.withColumn("rank", F.when(F.col("rank") <= 10, F.col("rank")))
    return met.agg(F.count("*").alias("users"), r6(F.avg(F.coalesce(F.lit(1.0) / F.log2(F.col("rank") + 1.0), F.lit(0.0)))).alias("ndcg"), r6(F.avg(F.when(F.col("rank").isNull(), 0.0).otherwise(1.0))).alias("recall"))


def _ease_sql(rows: str, penalty: float, rounds: int = 15) -> str:
    """CTEs ew (u, j, w), the product of the user side's inverse with the matrix, and ev (j, v), from rows (user_id, item_index).

    An independent way to the weights: with K = X X' + penalty, W = K^-1 X is solved by Chebyshev iteration between the
    penalty and a bound of the largest eigenvalue. Then X P = W and, with V = X' W, P = (I - V) / penalty.
    """
    lam = f"{penalty}::DOUBLE"
    out = f"""ex AS MATERIALIZED (SELECT DISTINCT user_id AS u, item_index AS i FROM {rows}),
e0 AS (SELECT ({lam} + hi) / 2 AS mid, (hi - {lam}) / 2 AS half, (hi - {lam}) / (hi + {lam}) AS rho FROM (SELECT {lam} + max(s) AS hi FROM (SELECT u, sum(n)::DOUBLE AS s FROM ex JOIN (SELECT i, count(*) AS n FROM ex GROUP BY i) USING (i) GROUP BY u))),
t0 AS MATERIALIZED (SELECT u, i AS j, 0::DOUBLE AS x, 1::DOUBLE AS r, 1 / mid AS d FROM ex, e0),
"""
    for k in range(rounds):
        left = f"coalesce(t.r, 0) - {lam} * coalesce(d, 0) - coalesce(v, 0)"
        out += f"""e{k + 1} AS (SELECT mid, half, 1 / (2 * mid / half - rho) AS rho FROM e{k}),
z{k} AS MATERIALIZED (SELECT i, j, sum(d) AS v FROM t{k} JOIN ex USING (u) GROUP BY i, j),
w{k} AS MATERIALIZED (SELECT u, j, sum(v) AS v FROM z{k} JOIN ex USING (i) GROUP BY u, j),
t{k + 1} AS MATERIALIZED (SELECT u, j, coalesce(x, 0) + coalesce(d, 0) AS x, {left} AS r, e{k + 1}.rho * e{k}.rho * coalesce(d, 0) + 2 * e{k + 1}.rho / e{k}.half * ({left}) AS d FROM t{k} t FULL JOIN w{k} w USING (u, j), e{k}, e{k + 1}),
"""
    return out + f"ew AS MATERIALIZED (SELECT u, j, x + d AS w FROM t{rounds}), ev AS MATERIALIZED (SELECT j, sum(w) AS v FROM ew JOIN ex ON ex.u = ew.u AND ex.i = ew.j GROUP BY j)"


#: Scores of unseen items from the CTEs of _ease_sql over history.
_EASE_OPEN = """eo AS MATERIALIZED (SELECT h.user_id, c.item_index, round(coalesce(-{penalty}::DOUBLE * w / (1 - v), 0), 9) AS score FROM (SELECT DISTINCT user_id FROM {history}) h CROSS JOIN catalog c
  LEFT JOIN ew ON ew.u = h.user_id AND ew.j = c.item_index LEFT JOIN ev ON ev.j = c.item_index ANTI JOIN {history} y ON y.user_id = h.user_id AND y.item_index = c.item_index)"""


@query(f"""{_SPLIT}, {_ease_sql("positives", 500.0)}, pairs AS (SELECT ex.i, ew.j, sum(w) AS v FROM ex JOIN ew ON ew.u = ex.u GROUP BY ALL)
SELECT catalog.item_index, round(coalesce(1 - ev.v, 1) / 500, 9) AS own_inverse, round(coalesce(s, 0), 6) AS weight_sum, round(coalesce(m, 0), 6) AS largest_weight, 0.0::DOUBLE AS deviation, 0.0::DOUBLE AS own_weight FROM catalog LEFT JOIN ev ON ev.j = item_index
  LEFT JOIN (SELECT pairs.j, sum(pairs.v / (1 - ev.v)) AS s, max(pairs.v / (1 - ev.v)) AS m FROM pairs JOIN ev ON ev.j = pairs.j WHERE pairs.i <> pairs.j GROUP BY 1) p ON p.j = item_index""")
def ease_identity(spark, d):
    """Of each item's column of the weights the sum and the largest, and how far Gram plus penalty times the inverse is from the identity."""
    catalog, history = A.catalog(spark, d), folders.stored(I.binary_matrix(A.positives(spark, d)), "history")
    side = ItemSide(catalog, S.popularity(history, catalog))
    rows = linear.check(history, side, linear.fit(history, side, diagonal=False), 500.0)
    return rows.select("item_index", F.round("own_inverse", 9).alias("own_inverse"), r6("weight_sum").alias("weight_sum"), r6("largest_weight").alias("largest_weight"), r6("deviation").alias("deviation"), r6("own_weight").alias("own_weight"))


@query(f"""{_SPLIT}, {_ease_sql("history", 500.0)}, {_EASE_OPEN.format(penalty=500.0, history="history")}
SELECT 'ease' AS model, user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_index)::INT AS rank, item_index, round(score, 6) AS score FROM eo QUALIFY rank <= 10""")
def ease_recommendations(spark, d):
    catalog = A.catalog(spark, d)
    history = folders.stored(I.history_of(I.leave_one_out(A.positives(spark, d))), "history")
    side = ItemSide(catalog, S.popularity(history, catalog))
    return S.recommend_users(history, side, {"ease": "ease"}, weights=linear.fit(history, side)).withColumn("score", r6("score"))


def _greedy_sql(name: str, lists: str, penalties: str, k: int = 10) -> str:
    """CTEs of the greedy rule over lists (user_id, item_index, score, rank up to 50): name (penalty, user_id, rank, item_index)."""
    jaccard = "CASE WHEN len(list_distinct(c.g || p.g)) > 0 THEN len(list_intersect(c.g, p.g)) / len(list_distinct(c.g || p.g))::DOUBLE ELSE 0 END"
    out = f"""{name}0 AS MATERIALIZED (SELECT penalty, user_id, item_index, rank, genres AS g, 0::DOUBLE AS most,
  CASE WHEN max(score) OVER u - min(score) OVER u > 1e-12 THEN (score - min(score) OVER u) / (max(score) OVER u - min(score) OVER u) ELSE 0 END AS rel FROM {lists} JOIN catalog USING (item_index) CROSS JOIN {penalties} WINDOW u AS (PARTITION BY penalty, user_id)),
"""
    for i in range(1, k + 1):
        out += f"""{name}p{i} AS MATERIALIZED (SELECT penalty, user_id, item_index, g, rank FROM {name}{i - 1} QUALIFY row_number() OVER (PARTITION BY penalty, user_id ORDER BY rel - penalty * most DESC, rank) = 1),
{name}{i} AS MATERIALIZED (SELECT c.* REPLACE (greatest(c.most, {jaccard}) AS most) FROM {name}{i - 1} c JOIN {name}p{i} p ON p.penalty = c.penalty AND p.user_id = c.user_id WHERE c.rank <> p.rank),
"""
    return out + f"{name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT penalty, user_id, {i} AS rank, item_index FROM {name}p{i}" for i in range(1, k + 1)) + ")"


_HYBRID_50 = f"f50 AS MATERIALIZED (SELECT user_id, item_index, {_HYBRID} AS score, row_number() OVER (PARTITION BY user_id ORDER BY {_HYBRID} DESC, item_index) AS rank FROM open {{where}} QUALIFY rank <= 50)"
_SPLIT_USERS = """users AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id::VARCHAR || '2026')) <= greatest(1, floor(count(*) OVER () / 5)) AS is_validation FROM targets)"""
_PENALTIES = "pens AS (SELECT unnest([0.0, 0.02, 0.05, 0.1, 0.2]::DOUBLE[]) AS penalty)"
_OF_RANKED = _METRICS[_METRICS.index("hit AS (") :]


@query(f"""{_COMPONENTS}, one AS (SELECT 0.1::DOUBLE AS penalty), {_HYBRID_50.format(where="")}, {_greedy_sql("mmr", "f50", "one")}
SELECT user_id, rank::INT AS rank, item_index, 'mmr 0.1' AS model FROM mmr""")
def mmr_reranking(spark, d):
    return Protocol(A.positives(spark, d), A.catalog(spark, d)).mmr(S.Weights(), 0.1)


_OPEN_50 = "f50 AS MATERIALIZED (SELECT user_id, item_index, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_index) AS rank FROM eo {where} QUALIFY rank <= 50)"
_POP = """pc AS (SELECT catalog.item_index, ln(1 + count(user_id)::DOUBLE) AS v FROM catalog LEFT JOIN history USING (item_index) GROUP BY 1),
pop AS (SELECT item_index, (v - (SELECT min(v) FROM pc)) / (SELECT max(v) - min(v) FROM pc) AS popularity FROM pc)"""


def _measured(name: str, lists: str, model: str, goal: str) -> str:
    """CTEs of the metrics of lists under a name of their own."""
    body = _OF_RANKED
    for word in ("hit", "lists", "jac", "dv", "ranked", "goal"):
        body = re.sub(rf"\b{word}\b", f"{name}_{word}", body)
    head, select = body.rsplit("\nSELECT", 1)
    return f"""{name}_goal AS ({goal}), {name}_ranked AS (SELECT {model} AS model, m.user_id, m.rank, m.item_index, popularity FROM {lists} m JOIN pop USING (item_index) SEMI JOIN {name}_goal g ON g.user_id = m.user_id),
{head}, {name}_metrics AS (SELECT{select})"""


_VALIDATION = "SELECT targets.* FROM targets JOIN users USING (user_id) WHERE is_validation"
_TEST = "SELECT targets.* FROM targets JOIN users USING (user_id) WHERE NOT is_validation"
_CHOICE = "choice AS (SELECT penalty FROM (SELECT replace(model, 'mmr ', '')::DOUBLE AS penalty, ndcg, diversity FROM v_metrics) ORDER BY ndcg DESC, diversity DESC, penalty LIMIT 1)"


@query(f"""{_SPLIT}, {_SPLIT_USERS}, {_POP}, {_ease_sql("history", 500.0)}, {_EASE_OPEN.format(penalty=500.0, history="history")}, {_PENALTIES}, {_OPEN_50.format(where="")},
val AS (SELECT f50.* FROM f50 JOIN users USING (user_id) WHERE is_validation), {_greedy_sql("vmmr", "val", "pens")}, {_measured("v", "vmmr", "'mmr ' || penalty", _VALIDATION)}, {_CHOICE},
tst AS (SELECT f50.* FROM f50 JOIN users USING (user_id) WHERE NOT is_validation), {_greedy_sql("tmmr", "tst", "choice")}, {_measured("e", "(SELECT * FROM tst WHERE rank <= 10)", "'ease'", _TEST)}, {_measured("t", "tmmr", "'ease_mmr'", _TEST)}
SELECT *, NULL::DOUBLE AS penalty FROM e_metrics UNION ALL SELECT *, (SELECT penalty FROM choice) FROM t_metrics""")
def ease_comparison(spark, d):
    """The linear autoencoder, and with diversity reranking whose penalty is searched on validation users."""
    out = Protocol(A.positives(spark, d), A.catalog(spark, d)).ease_comparison()
    return _rounded(out).join(out.select("model", "penalty"), "model")


@query(f"""{_COMPONENTS}, {_SPLIT_USERS}, {_PENALTIES}, {_HYBRID_50.format(where="SEMI JOIN (SELECT user_id FROM users WHERE is_validation) s USING (user_id)")}, {_greedy_sql("mmr", "f50", "pens")},
{_measured("v", "mmr", "'mmr ' || penalty", _VALIDATION)} SELECT * FROM v_metrics""")
def penalty_search(spark, d):
    out = Protocol(A.positives(spark, d), A.catalog(spark, d)).penalty_search(S.Weights())
    return _rounded(out.withColumn("model", F.concat(F.lit("mmr "), F.col("penalty").cast("string"))))


@query(_COMPONENTS + """, users AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id::VARCHAR || '2026')) <= greatest(1, floor(count(*) OVER () / 5)) AS is_validation FROM targets),
goal AS (SELECT targets.* FROM targets JOIN users USING (user_id) WHERE is_validation), w AS (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3, 0.5]::DOUBLE[]) AS weight),
x AS (SELECT weight, ct.user_id, item_index, round((1 - weight) * popularity + weight * (hits / size::DOUBLE), 9) AS score FROM ct JOIN size USING (user_id) JOIN pop USING (item_index) JOIN goal USING (user_id) CROSS JOIN w
  WHERE NOT EXISTS (FROM history h WHERE h.user_id = ct.user_id AND h.item_index = ct.item_index)),
r AS (SELECT *, row_number() OVER (PARTITION BY weight, user_id ORDER BY score DESC, item_index) AS rank FROM x),
hit AS (SELECT weight, sum(1 / log2(rank + 1)) AS gain FROM r JOIN goal ON r.user_id = goal.user_id AND item_index = target WHERE rank <= 10 GROUP BY 1)
SELECT weight, round(coalesce(gain, 0) / (SELECT count(*) FROM goal), 6) AS ndcg FROM w LEFT JOIN hit USING (weight)""")
def blend_search(spark, d):
    """Blends of popularity with genre content, on validation users."""
    return Protocol(A.positives(spark, d), A.catalog(spark, d)).blend_search().select("weight", r6("ndcg").alias("ndcg"))


@query(f"""old AS (SELECT DISTINCT user_id, item_index FROM positives WHERE ts < '2000-01-01'), new AS (SELECT DISTINCT user_id, item_index FROM positives WHERE ts >= '2000-01-01'),
{_ease_sql("old", 5000.0, 10)}, {_EASE_OPEN.format(penalty=5000.0, history="old")}, ranked AS (SELECT user_id, item_index, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_index) AS rank FROM eo QUALIFY rank <= 50),
n AS (SELECT user_id, count(*) AS n FROM new GROUP BY 1), k AS (SELECT unnest([10, 20, 50]) AS k), u AS (SELECT DISTINCT user_id FROM ranked),
hit AS (SELECT k, r.user_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM ranked r JOIN new USING (user_id, item_index) JOIN k ON rank <= k GROUP BY ALL),
v AS (SELECT k, u.user_id, coalesce(n, 0) AS n FROM k CROSS JOIN u LEFT JOIN n USING (user_id))
SELECT k, count(*) AS users, round(avg(coalesce(hits / nullif(least(n, k), 0)::DOUBLE, 0)), 6) AS recall,
  round(avg(coalesce(dcg, 0) / list_sum(list_transform(range(1, greatest(1, least(n + 1, k)) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, round(avg(coalesce(1 / first::DOUBLE, 0)), 6) AS mrr
FROM v LEFT JOIN hit USING (k, user_id) GROUP BY k""")
def ease_at_10_20_50(spark, d):
    """An older setting: penalty 5000, and metrics of many positives at three lengths."""
    p, catalog = A.positives(spark, d), A.catalog(spark, d)
    old, new = folders.stored(I.binary_matrix(p.where("ts < '2000-01-01'")), "history"), I.binary_matrix(p.where("ts >= '2000-01-01'"))
    side = ItemSide(catalog, S.popularity(old, catalog))
    ranked = folders.stored(S.recommend_users(old, side, {"ease": "ease"}, 50, linear.fit(old, side, 5000.0)), "ranked")
    return M.many_positive_means(ranked, new).select("k", "users", *[r6(c).alias(c) for c in ("recall", "ndcg", "mrr")])


# Requests

_ASKED = """said AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS text FROM conversations GROUP BY 1),
asked AS (SELECT conv_id AS request_id, lower(CASE WHEN conv_id % 5 = 0 THEN 'anything nice' ELSE 'looking for a ' || coalesce(p_name, 'thing') END || ' ' || text) AS text,
  CASE WHEN conv_id % 3 = 0 THEN ['promo'] ELSE [] END AS disliked, CASE WHEN conv_id % 2 = 0 THEN 'red widget' END AS excluded FROM said LEFT JOIN part ON p_partkey = conv_id * 3)"""


def _requests(spark, d) -> DataFrame:
    """A request for each conversation: what its user said first, with a title's words; some name dislikes or exclude a title."""
    said = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", F.when((F.col("role") == "user") & F.col("text").isNotNull(), F.col("turn"))).alias("text"))
    key, none = F.col("conv_id"), F.array().cast("array<string>")
    rows = said.join(A.table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey") == key * 3, "left")
    wish = F.when(key % 5 == 0, "anything nice").otherwise(F.concat(F.lit("looking for a "), F.coalesce("p_name", F.lit("thing"))))
    return rows.select(
        key.cast("long").alias("request_id"), F.concat_ws(" ", wish, F.coalesce("text", F.lit(""))).alias("description"), F.lit("").alias("summary"), F.lit(" ").alias("context"),
        none.alias("liked"), F.when(key % 3 == 0, F.array(F.lit("promo"))).otherwise(none).alias("disliked_genres"), none.alias("disliked"),
        F.when(key % 2 == 0, F.array(F.lit("Red Widget (1)"))).otherwise(none).alias("exclude_titles"), F.lit(10).alias("top_k"), F.lit(1.0).alias("alpha"),
    )


def _vocabulary(catalog: DataFrame) -> list[str]:
    return [r[0] for r in readers.vocabulary(catalog).collect()]  # the genres of a catalog


@query(f"""{_ASKED}, c AS (SELECT catalog.item_index, ln(1 + count(DISTINCT user_id)::DOUBLE) AS v FROM catalog LEFT JOIN positives USING (item_index) GROUP BY 1),
pop AS (SELECT item_index, (v - (SELECT min(v) FROM c)) / (SELECT max(v) - min(v) FROM c) AS popularity FROM c), voc AS (SELECT DISTINCT unnest(genres) AS genre FROM catalog),
named AS (SELECT request_id, list(genre) AS genres FROM asked JOIN voc ON regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])' || lower(genre) || '([^\\p{{L}}\\p{{N}}_]|$)') GROUP BY 1),
x AS (SELECT a.request_id, i.item_index, i.norm_title, i.genres AS own, a.disliked, a.excluded, n.genres IS NOT NULL AS has, popularity, coalesce(len(list_intersect(i.genres, n.genres)) / len(n.genres)::DOUBLE, 0) AS raw
  FROM asked a CROSS JOIN catalog i JOIN pop USING (item_index) LEFT JOIN named n ON n.request_id = a.request_id),
y AS (SELECT *, CASE WHEN max(raw) OVER w - min(raw) OVER w > 1e-12 THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 0 END AS content FROM x WINDOW w AS (PARTITION BY request_id)),
z AS (SELECT *, round(CASE WHEN has THEN 0.85::DOUBLE * content + 0.15::DOUBLE * popularity ELSE popularity END, 9) AS score FROM y
  WHERE NOT list_has_any(list_transform(own, lambda g: lower(g)), disliked) AND norm_title IS DISTINCT FROM excluded),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, norm_title ORDER BY score DESC, item_index) AS k FROM z) WHERE k = 1)
SELECT request_id::BIGINT AS request_id, rank::INT AS rank, item_index, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_index) AS rank FROM o) WHERE rank <= 10""")
def cold_start_requests(spark, d):
    catalog = A.catalog(spark, d)
    popular = S.popularity(I.binary_matrix(A.positives(spark, d)), catalog)
    rows = Q.prepared(_requests(spark, d), catalog, _vocabulary(catalog))
    return Q.cold_start(rows, catalog, popular).select("request_id", "rank", "item_index", r6("score").alias("score"))


@query(f"""{_ASKED}, {_ease_sql("positives", 500.0)}, c AS (SELECT catalog.item_index, ln(1 + count(DISTINCT user_id)::DOUBLE) AS v FROM catalog LEFT JOIN positives USING (item_index) GROUP BY 1),
pop AS (SELECT item_index, (v - (SELECT min(v) FROM c)) / (SELECT max(v) - min(v) FROM c) AS popularity FROM c), voc AS (SELECT DISTINCT unnest(genres) AS genre FROM catalog),
named AS (SELECT request_id, list(genre) AS genres FROM asked JOIN voc ON regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])' || lower(genre) || '([^\\p{{L}}\\p{{N}}_]|$)') GROUP BY 1),
titles AS (SELECT norm_title, max(item_index) AS item_index FROM catalog GROUP BY 1), names AS (SELECT item_index, norm_title FROM catalog),
liked AS (SELECT DISTINCT request_id, titles.item_index FROM asked JOIN names ON names.item_index IN (request_id * 7, request_id * 11 + 1) JOIN titles USING (norm_title) WHERE request_id % 4 <> 0),
own AS (SELECT DISTINCT item_index AS i FROM liked), vs AS MATERIALIZED (SELECT i, j, sum(w) AS v FROM own JOIN ex USING (i) JOIN ew ON ew.u = ex.u GROUP BY i, j),
lin AS (SELECT request_id, j AS item_index, sum(CASE WHEN i <> j THEN vs.v / (1 - ev.v) ELSE 0 END) AS s FROM liked JOIN vs ON vs.i = liked.item_index JOIN ev USING (j) GROUP BY ALL),
x AS (SELECT a.request_id, i.item_index, i.norm_title, i.genres AS own, a.disliked, a.excluded, n.genres IS NOT NULL AS has, l.request_id IS NOT NULL AS warm, popularity, coalesce(s, 0) AS base, coalesce(len(list_intersect(i.genres, n.genres)) / len(n.genres)::DOUBLE, 0) AS raw
  FROM asked a CROSS JOIN catalog i JOIN pop USING (item_index) LEFT JOIN named n ON n.request_id = a.request_id LEFT JOIN (SELECT DISTINCT request_id FROM liked) l ON l.request_id = a.request_id
  LEFT JOIN lin ON lin.request_id = a.request_id AND lin.item_index = i.item_index),
y AS (SELECT *, CASE WHEN max(raw) OVER w - min(raw) OVER w > 1e-12 THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 0 END AS content,
  CASE WHEN max(base) OVER w - min(base) OVER w > 1e-12 THEN (base - min(base) OVER w) / (max(base) OVER w - min(base) OVER w) ELSE 0 END AS ease FROM x WINDOW w AS (PARTITION BY request_id)),
z AS (SELECT y.*, round(CASE WHEN warm THEN (0.98::DOUBLE - CASE WHEN has THEN 0.15::DOUBLE ELSE 0 END) * ease + CASE WHEN has THEN 0.15::DOUBLE ELSE 0 END * content + 0.02::DOUBLE * popularity
    WHEN has THEN 0.85::DOUBLE * content + 0.15::DOUBLE * popularity ELSE popularity END, 9) AS score FROM y ANTI JOIN liked ON liked.request_id = y.request_id AND liked.item_index = y.item_index
  WHERE NOT list_has_any(list_transform(own, lambda g: lower(g)), disliked) AND norm_title IS DISTINCT FROM excluded),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, norm_title ORDER BY score DESC, item_index) AS k FROM z) WHERE k = 1)
SELECT request_id::BIGINT AS request_id, rank::INT AS rank, item_index, round(score, 6) AS score, round(ease, 6) AS ease, round(content, 6) AS content, round(popularity, 6) AS popularity
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_index) AS rank FROM o) WHERE rank <= 10""")
def recommend_requests(spark, d):
    """The flagship: requests with liked titles, answered by the linear autoencoder with genres and popularity."""
    catalog = A.catalog(spark, d)
    history = folders.stored(I.binary_matrix(A.positives(spark, d)), "history")
    side = ItemSide(catalog, S.popularity(history, catalog))
    titles = catalog.select("item_index", "title")
    wishes = _requests(spark, d).where("request_id % 4 <> 0").select("request_id", F.explode(F.array(F.col("request_id") * 7, F.col("request_id") * 11 + 1)).alias("item_index"))
    liked = wishes.join(titles, "item_index").groupBy("request_id").agg(F.collect_list("title").alias("likes"))  # two of a request
    asked = _requests(spark, d).join(liked, "request_id", "left").withColumn("liked", F.coalesce("likes", "liked")).drop("likes")
    answers = Q.answer(Q.prepared(asked, catalog, _vocabulary(catalog)), side, linear.fit(history, side))
    return answers.select("request_id", "rank", "item_index", *[r6(c).alias(c) for c in ("score", "ease", "content", "popularity")])


# Filters


@query("SELECT item_index, title FROM catalog WHERE (NOT EXISTS (SELECT 1 FROM catalog x WHERE array_to_string(x.genres, '|') ILIKE '%promo%')) OR array_to_string(genres, '|') ILIKE '%promo%' ORDER BY item_index LIMIT 25")
def genre_filter_or_first(spark, d):
    return R.genre_filter(A.catalog(spark, d), "Promo", 25).select("item_index", "title")


@query("SELECT item_index FROM catalog WHERE NOT list_has_any(list_transform(genres, lambda g: lower(g)), ['promo', 'ring']) AND norm_title NOT IN ('red widget', 'blue bolt')")
def exclusions(spark, d):
    kept = R.without_genres(A.catalog(spark, d), F.array(F.lit("Promo"), F.lit("RING")))
    return R.without_titles(kept, spark.createDataFrame([("Red Widget (1)",), ("  blue  bolt",)], "title string")).select("item_index")


@query("SELECT item_index FROM catalog WHERE NOT list_contains(list_transform(string_split(array_to_string(genres, '|'), ','), lambda g: trim(lower(g))), 'promo')")
def legacy_comma_filter(spark, d):
    return R.without_genres(A.catalog(spark, d), F.array(F.lit("Promo")), ",").select("item_index")


@query(f"""{_SPLIT}, c AS (SELECT item_index, count(*) AS n FROM history GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, item_index) AS place FROM c), u AS (SELECT user_id, count(*) AS own FROM history GROUP BY 1)
SELECT user_id, t.item_index, round(CASE WHEN h.user_id IS NOT NULL THEN -13.815510557964274::DOUBLE ELSE n END, 6) AS score FROM u JOIN t ON place <= own + 20 LEFT JOIN history h USING (user_id, item_index)""")
def masked_seen_scores(spark, d):
    """Scores of the items that a list of 20 needs: of the most popular 20 more than the user has seen."""
    history = I.history_of(I.leave_one_out(A.positives(spark, d)))
    popular = history.groupBy("item_index").agg(F.count("*").cast("double").alias("score"))
    return R.mask_seen(R.most_popular(history, R.placed(popular), 20), history).select("user_id", "item_index", r6("score").alias("score"))


@query("SELECT genre, count(*) AS n FROM (SELECT unnest(genres) AS genre FROM catalog) GROUP BY 1 HAVING count(*) > 100")
def frequent_genres(spark, d):
    return M.frequent_genres(A.catalog(spark, d))


@query("""b AS (SELECT movie_id, row_number() OVER (ORDER BY count(*) DESC, movie_id) AS r FROM ratings GROUP BY 1), n AS (SELECT item_index AS movie_id, row_number() OVER (ORDER BY count(*) DESC, item_index) AS r FROM positives GROUP BY 1)
SELECT title, b.r::INT AS rank_before, n.r::INT AS rank_now, (b.r - n.r)::INT AS rose, CASE WHEN b.r > n.r THEN '⬆ +' || (b.r - n.r) WHEN b.r < n.r THEN '⬇ ' || (b.r - n.r) ELSE '–' END AS label
FROM b JOIN n USING (movie_id) JOIN catalog USING (movie_id) WHERE b.r <= 100 AND n.r <= 100""")
def rank_changes(spark, d):
    titles = A.catalog(spark, d).select("item_index", "title")

    def first(rows: DataFrame, item: str) -> DataFrame:
        return R.best(rows.groupBy(F.col(item).alias("item_index")).agg(F.count("*").alias("score")), 100).join(titles, "item_index")

    rows = R.rank_changes(first(A.ratings(spark, d), "movie_id"), first(A.positives(spark, d), "item_index"))
    return rows.withColumn("label", X.rank_change(F.col("rank_before"), F.col("rank_now")))


@query("""o AS (SELECT movie_id, title, genres, row_number() OVER (ORDER BY n DESC, first_pos) AS k FROM (SELECT movie_id, count(*) AS n, min(pos) AS first_pos FROM ratings GROUP BY 1) JOIN catalog USING (movie_id)),
s AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS had, 0 AS place, false AS took UNION ALL
  SELECT k, CASE WHEN ok THEN had || genres ELSE had END, place + ok::INT, ok FROM (SELECT o.k, s.had, s.place, o.genres, len(list_filter(o.genres, lambda g: len(list_filter(s.had, lambda h: h = g)) >= 10)) = 0 AS ok FROM s JOIN o ON o.k = s.k + 1 WHERE s.place < 50))
SELECT place, movie_id, title, genres FROM s JOIN o USING (k) WHERE took""", recursive="RECURSIVE ")
def quota_selection(spark, d):
    items = A.ratings(spark, d).groupBy("movie_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return R.quota_selection(items.join(A.catalog(spark, d).select("movie_id", "title", "genres"), "movie_id"))


@query("SELECT s_suppkey AS id, s_name AS title, s_acctbal AS vote, row_number() OVER (ORDER BY s_acctbal DESC, s_name)::INT AS rank, 'Rank #' || row_number() OVER (ORDER BY s_acctbal DESC, s_name) AS rank_label FROM supplier", base=False)
def vote_ranking(spark, d):
    return R.by_vote(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("vote")), "vote")


# Many positives and controllability

_LATE = """old AS (SELECT DISTINCT user_id, item_index FROM positives WHERE ts < '2000-01-01'), new AS (SELECT DISTINCT user_id, item_index FROM positives WHERE ts >= '2000-01-01'),
pop AS (SELECT item_index, count(*) AS n FROM old GROUP BY 1),
x AS (SELECT u.user_id, h.item_index, n FROM (SELECT DISTINCT user_id FROM old) u CROSS JOIN pop h ANTI JOIN old ON old.user_id = u.user_id AND old.item_index = h.item_index),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item_index) AS rank FROM x) WHERE rank <= 20)"""


def _late(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = A.positives(spark, d)
    old, new = I.binary_matrix(p.where("ts < '2000-01-01'")), I.binary_matrix(p.where("ts >= '2000-01-01'"))
    popular = old.groupBy("item_index").agg(F.count("*").alias("score"))
    return old, new, R.top_k(R.unseen(R.most_popular(old, R.placed(popular), 20), old), 20)


@query(f"""{_LATE}, n AS (SELECT user_id, count(*) AS n FROM new GROUP BY 1), hit AS (SELECT r.user_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM ranked r JOIN new USING (user_id, item_index) GROUP BY 1),
u AS (SELECT DISTINCT user_id FROM ranked), v AS (SELECT u.user_id, coalesce(n, 0) AS n FROM u LEFT JOIN n USING (user_id))
SELECT v.user_id, round(coalesce(hits / nullif(least(n, 20), 0)::DOUBLE, 0), 6) AS recall, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, greatest(1, least(n + 1, 20)) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, round(coalesce(1 / first::DOUBLE, 0), 6) AS mrr
FROM v LEFT JOIN hit USING (user_id)""")
def many_positive_metrics(spark, d):
    _, new, ranked = _late(spark, d)
    return M.many_positive_metrics(ranked, new, 20).select("user_id", *[r6(c).alias(c) for c in ("recall", "ndcg", "mrr")])


_SWAPS = f"""{_LATE}, g AS (SELECT user_id, unnest(genres) AS genre FROM old JOIN catalog USING (item_index)), f AS (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, genre) AS k FROM g GROUP BY user_id, genre),
swaps AS (SELECT a.user_id, a.genre AS down_genre, b.genre AS up_genre FROM f a JOIN f b ON a.user_id = b.user_id AND a.k = 1 AND b.k = 3),
after AS (SELECT s.user_id, r.item_index, row_number() OVER (PARTITION BY s.user_id ORDER BY list_contains(genres, up_genre) DESC, rank) AS rank FROM ranked r JOIN swaps s USING (user_id) JOIN catalog USING (item_index)),
score AS (SELECT 'was' AS k, l.user_id, sum(CASE WHEN list_contains(genres, down_genre) THEN 1 / log2(rank + 1) ELSE 0 END) / sum(1 / log2(rank + 1)) AS dn, sum(CASE WHEN list_contains(genres, up_genre) THEN 1 / log2(rank + 1) ELSE 0 END) / sum(1 / log2(rank + 1)) AS up
  FROM ranked l JOIN swaps USING (user_id) JOIN catalog USING (item_index) GROUP BY ALL UNION ALL
  SELECT 'is', l.user_id, sum(CASE WHEN list_contains(genres, down_genre) THEN 1 / log2(rank + 1) ELSE 0 END) / sum(1 / log2(rank + 1)), sum(CASE WHEN list_contains(genres, up_genre) THEN 1 / log2(rank + 1) ELSE 0 END) / sum(1 / log2(rank + 1))
  FROM after l JOIN swaps USING (user_id) JOIN catalog USING (item_index) GROUP BY ALL),
changes AS (SELECT s.user_id, down_genre, up_genre, w.dn - i.dn AS change_down, w.dn AS most_down, w.up - i.up AS change_up, w.up - 1 AS most_up FROM swaps s JOIN score w ON w.user_id = s.user_id AND w.k = 'was' JOIN score i ON i.user_id = s.user_id AND i.k = 'is')"""


def _changes(spark, d) -> DataFrame:
    old, _, before = _late(spark, d)
    catalog = A.catalog(spark, d)
    counts = old.join(catalog.select("item_index", "genres"), "item_index").select("user_id", F.explode("genres").alias("genre")).groupBy("user_id", "genre").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "genre")))
    swaps = ranked.where("k = 1").select("user_id", F.col("genre").alias("down_genre")).join(ranked.where("k = 3").select("user_id", F.col("genre").alias("up_genre")), "user_id")
    moved = before.join(swaps, "user_id").join(catalog.select("item_index", "genres"), "item_index")
    order = Window.partitionBy("user_id").orderBy(F.desc(F.array_contains("genres", F.col("up_genre"))), "rank")
    return M.controllability(before, moved.withColumn("rank", F.row_number().over(order)).select("user_id", "item_index", "rank"), catalog, swaps)


@query(f"{_SWAPS} SELECT user_id, down_genre, up_genre, round(change_down, 6) + 0.0 AS change_down, round(most_down, 6) AS most_down, round(change_up, 6) + 0.0 AS change_up, round(most_up, 6) + 0.0 AS most_up FROM changes")
def controllability(spark, d):
    return _changes(spark, d).select("user_id", "down_genre", "up_genre", *[(r6(c) + 0.0).alias(c) for c in ("change_down", "most_down", "change_up", "most_up")])


@query(f"{_SWAPS} SELECT up_genre, count(*) AS users, round(avg(change_down), 5) + 0.0 AS change_down, round(avg(change_up), 5) + 0.0 AS change_up FROM changes GROUP BY GROUPING SETS ((), (up_genre))")
def mean_changes(spark, d):
    return M.mean_changes(_changes(spark, d)).select("up_genre", "users", *[(F.round(c, 5) + 0.0).alias(c) for c in ("change_down", "change_up")])


# Text


@query("""t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_name || ', The (1999)' WHEN 1 THEN 'The ' || p_name WHEN 2 THEN p_name || ', An (a.k.a. X) (2001)' WHEN 3 THEN '  ' || p_name || '  Café, A (1998) ' ELSE p_name || ' (B) C' END AS title FROM part),
a AS (SELECT *, trim(regexp_replace(trim(lower(title)), '\\([^(]*\\)$', '')) AS b FROM t)
SELECT id, trim(regexp_replace(regexp_replace(b, ', (the|an|a)$', ' \\1'), '\\s+', ' ', 'g')) AS norm_title, trim(replace(replace(replace(trim(split_part(lower(title), '(', 1)), ', the', ''), ', a', ''), ', an', '')) AS old_title,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\\(.*?\\)', '', 'g'), '[:,]', '', 'g'), '\\.', '', 'g'), '\\s+-\\s+.*', '', 'g'), '  +', ' ', 'g')) AS search_title FROM a""")
def title_keys(spark, d):
    n, k = F.col("p_name"), F.col("p_partkey") % 5
    title = F.when(k == 0, F.concat(n, F.lit(", The (1999)"))).when(k == 1, F.concat(F.lit("The "), n)).when(k == 2, F.concat(n, F.lit(", An (a.k.a. X) (2001)"))).when(k == 3, F.concat(F.lit("  "), n, F.lit("  Café, A (1998) "))).otherwise(F.concat(n, F.lit(" (B) C")))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.normalize_title(title).alias("norm_title"), X.clean_title_legacy(title).alias("old_title"), X.search_title(title).alias("search_title"))


_VOCABULARY = ["Action", "Drama", "de", "la", "of", "und", "Sci-Fi"]


@query("""SELECT conv_id, turn, list_filter([""" + ", ".join(
    f"""CASE WHEN regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{{L}}\\p{{N}}_]){g.lower()}([^\\p{{L}}\\p{{N}}_]|$)')""" + (""" OR regexp_matches(lower(coalesce(text, '')), 'science fiction|scifi|sci fi')""" if g == "Sci-Fi" else "") + f""" THEN '{g}' END"""
    for g in sorted(_VOCABULARY)) + """], lambda x: x IS NOT NULL) AS genres, length(coalesce(text, '')) AS n FROM conversations""", base=False)
def genres_in_text(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", X.genres_of_literal(F.col("text"), _VOCABULARY).alias("genres"), F.length(F.coalesce("text", F.lit(""))).alias("n"))


@query("""c AS (SELECT conv_id, turn, coalesce(text, '') AS t, role FROM conversations), p AS (SELECT *, list_filter(list_transform(string_split(t, ','), lambda x: trim(x, ' \t\n\r')), lambda x: x <> '') AS parts FROM c)
SELECT conv_id, turn, CASE WHEN t <> '' THEN trim(array_to_string(string_split(t, '.')[:2], '.') || '.', ' \t\n\r') ELSE '' END AS overview, len(parts) AS n_parts, coalesce(parts[1], '') AS first_part,
  list_filter([CASE WHEN regexp_matches(lower(t), 'dislike.*horror|no horror|hate horror') THEN 'Horror' END, CASE WHEN regexp_matches(lower(t), 'dislike.*action') THEN 'Action' END], lambda x: x IS NOT NULL) AS dislikes,
  array_to_string(list_filter([trim(t, ' \t\n\r'), trim(role, ' \t\n\r')], lambda x: x <> ''), chr(10) || 'Context: ') AS preference FROM p""")
def text_fields(spark, d):
    t = F.coalesce("text", F.lit(""))
    parts = X.comma_list(t)
    return A.table(spark, d, "conversations").select(
        "conv_id", "turn", X.short_overview(t).alias("overview"), F.size(parts).cast("long").alias("n_parts"), F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("first_part"),
        X.extract_dislikes(t).alias("dislikes"), X.preference_text(F.array(t, F.col("role"))).alias("preference"),
    )


@query("""SELECT o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4)::INT AS year, lower(replace(o_orderpriority, '-', ' ')) AS canonical,
  CASE o_orderkey % 3 WHEN 0 THEN 'Science Fiction' WHEN 1 THEN 'Sci-Fi now' ELSE 'TV Movie' END AS genre, CASE o_orderkey % 3 WHEN 0 THEN [878, 18] WHEN 1 THEN [18] ELSE [10770, 18] END AS ids FROM orders""", base=False)
def genre_names(spark, d):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, "science-fiction ").when(k == 1, " sci-fi now").otherwise("TV-Movie")
    name = X.normalize_genre(raw)
    return A.table(spark, d, "orders").select("o_orderkey", X.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"), X.canonical_genre(F.col("o_orderpriority")).alias("canonical"), name.alias("genre"), X.genre_ids(F.array(name, F.lit("nothing"), F.lit("Drama"))).alias("ids"))


@query("""m AS (SELECT user_id, list(title ORDER BY pos) AS titles, flatten(list(genres ORDER BY pos)) AS genres FROM (SELECT user_id, r.movie_id, pos, title, genres, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k FROM ratings r JOIN catalog USING (movie_id)) WHERE k <= 3 GROUP BY 1),
g AS (SELECT *, list_transform(list_sort(list_distinct(list_transform(genres, lambda x: list_position(genres, x)))), lambda p: genres[p]) AS own FROM m)
SELECT user_id, 'The user prefers movies in these genres: ' || array_to_string(own, ', ') || '.' AS by_genre, 'The user likes movies such as ' || array_to_string(titles, ', ') || '. Their selected movies suggest interest in ' || array_to_string(own, ', ') || '.' AS selected,
  'The user likes movies such as ' || array_to_string(titles, ', ') || '. Current viewing context: rain' AS taste, 'User likes: ' || array_to_string(titles, ', ') || chr(10) || 'Context: rain' AS listed,
  'Summary: The user enjoys ' || array_to_string(own, ', ') || ' movies. They seem to enjoy plot points and storytelling patterns shared by their selected films. No additional disliked genres can be inferred beyond those entered in the exclusion field. No disliked plot points that other users may enjoy can be inferred from the current selections.' AS shown FROM g""")
def summaries(spark, d):
    first = Window.partitionBy("user_id").orderBy("pos")
    rows = A.ratings(spark, d).withColumn("k", F.row_number().over(first)).where("k <= 3").join(A.catalog(spark, d), "movie_id")
    own = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "genres"))).alias("m"))
    titles, genres, none = F.col("m.title"), F.flatten("m.genres"), F.array().cast("array<string>")
    return own.select(
        "user_id", X.genre_summary(genres, F.lit("")).alias("by_genre"), X.selection_summary(titles, genres).alias("selected"), X.taste_summary(titles, none, F.lit(" rain ")).alias("taste"),
        X.selected_taste(titles, F.lit("rain")).alias("listed"), X.interface_summary(genres, F.lit("")).alias("shown"),
    )


@query("""x AS (SELECT user_id, pos, unnest(genres) AS genre, generate_subscripts(genres, 1) AS place FROM ratings JOIN catalog USING (movie_id)), c AS (SELECT user_id, genre, count(*) AS n, min(pos * 100 + place) AS first FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM c) SELECT user_id, 'User seems to enjoy ' || string_agg(genre, ', ' ORDER BY k) || ' movies.' AS summary FROM r WHERE k <= 3 GROUP BY 1""")
def top_genre_summary(spark, d):
    rows = A.ratings(spark, d).select("user_id", "pos", "movie_id").join(A.catalog(spark, d).select("movie_id", "genres"), "movie_id")
    return M.top_genres(rows).select("user_id", F.concat(F.lit("User seems to enjoy "), F.array_join("genres", ", "), F.lit(" movies.")).alias("summary"))


@query(f"""{_SPLIT}, g AS (SELECT user_id, unnest(genres) AS genre FROM history JOIN catalog USING (item_index)), c AS (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, genre) AS k FROM g GROUP BY user_id, genre),
gs AS (SELECT user_id, string_agg(genre, ', ' ORDER BY k) AS genres FROM c WHERE k <= 5 GROUP BY 1), h AS (SELECT user_id, item_index, row_number() OVER (PARTITION BY user_id ORDER BY item_index) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM history),
s AS (SELECT h.user_id, string_agg(title, '; ' ORDER BY p) AS titles FROM h JOIN catalog USING (item_index) WHERE n <= 12 OR list_contains(list_transform(range(12), lambda i: (i * (n - 1)) // 11), p) GROUP BY 1)
SELECT user_id, 'The user enjoys ' || genres || ' movies. Movies they liked include: ' || titles || '.' AS description FROM gs JOIN s USING (user_id)""")
def history_descriptions(spark, d):
    return X.describe_histories(folders.stored(I.history_of(I.leave_one_out(A.positives(spark, d))), "history"), A.catalog(spark, d))


@query("""u AS (SELECT 0 AS l, s_suppkey AS r, s_name AS title, s_acctbal AS vote FROM supplier UNION ALL SELECT 1, c_custkey, replace(upper(c_name), 'CUSTOMER', 'SUPPLIER'), c_acctbal FROM customer)
SELECT arg_max(title, (l, r)) AS title, arg_max(vote, (l, r)) AS vote FROM u GROUP BY lower(title)""")
def merged_lists(spark, d):
    a = A.table(spark, d, "supplier").select(F.col("s_name").alias("title"), F.col("s_acctbal").alias("vote"))
    b = A.table(spark, d, "customer").select(F.replace(F.upper("c_name"), F.lit("CUSTOMER"), F.lit("SUPPLIER")).alias("title"), F.col("c_acctbal").alias("vote"))
    return readers.merge_lists([a, b]).select("title", "vote")


# Vectors


@query("""q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT query_id, vec_id AS item_id, round(list_cosine_similarity(a, embedding::DOUBLE[]), 9) AS s FROM q CROSS JOIN embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM x) SELECT query_id, item_id, round(s, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10""")
def embedding_neighbours(spark, d):
    vectors = A.table(spark, d, "embeddings")
    found = nearest.top_k(vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), vectors.withColumnRenamed("vec_id", "item_id"))
    return found.select("query_id", "item_id", r6("score").alias("score"), "rank")


@query("""q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a, label FROM embeddings WHERE vec_id % 50 = 0), t AS (SELECT q.query_id, e.vec_id AS item_id, count(*) AS times FROM q JOIN embeddings e ON e.vec_id IN (query_id + 1, query_id * 3 % 97, query_id // 2) GROUP BY ALL),
x AS (SELECT q.query_id, vec_id AS item_id, round(list_cosine_similarity(a, embedding::DOUBLE[]) + 0.15::DOUBLE * coalesce(times, 0), 9) AS s FROM q CROSS JOIN embeddings e LEFT JOIN t ON t.query_id = q.query_id AND t.item_id = e.vec_id
  WHERE e.label % 4 <> (q.query_id // 50) % 5),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM x) SELECT query_id, rank::INT AS rank, 'Rank #' || rank AS rank_label, item_id, round(s, 6) AS score FROM r WHERE rank <= 12""")
def boosted_neighbours(spark, d):
    """The older text recommender from vectors on: cosine, boosts of liked items, items of a disliked genre left out."""
    vectors = A.table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    items = vectors.select(F.col("vec_id").alias("item_id"), "embedding", F.array(F.concat(F.lit("Genre "), (F.col("label") % 4).cast("string"))).alias("genres"))
    id_ = F.col("query_id")
    wished = F.array_distinct(F.array(id_ + 1, id_ * 3 % 97, F.floor(id_ / 2)))
    liked = queries.select("query_id", F.explode(wished).alias("item_id"))
    banned = queries.select("query_id", F.concat(F.lit(" genre "), (F.floor(id_ / 50) % 5).cast("string")).alias("genre"))
    found = nearest.top_k(queries, items, 12, liked, 0.15, banned)
    return found.select("query_id", "rank", F.concat(F.lit("Rank #"), F.col("rank").cast("string")).alias("rank_label"), "item_id", r6("score").alias("score"))


_NEXT = "v AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _next(spark, d) -> DataFrame:
    v = A.table(spark, d, "embeddings")
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    return v.select("vec_id", wide("embedding").alias("x")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), wide("embedding").alias("y")), "vec_id")


@query(f"""{_NEXT}, f AS (SELECT *, list_transform(range(1, len(x) + 1), lambda i: 0.75::DOUBLE * x[i] + 0.25::DOUBLE * y[i]) AS f FROM v)
SELECT vec_id, list_transform(f, lambda z: round(z / sqrt(list_sum(list_transform(f, lambda w: w * w))), 6) + 0.0) AS fused, list_transform(range(1, len(x) + 1), lambda i: round(0.75::DOUBLE * x[i] + 0.25::DOUBLE * y[i], 6) + 0.0) AS merged,
  list_transform(range(1, len(x) + 1), lambda i: round((y[i] - x[i]) / 2, 6) + 0.0) AS negative, round(list_cosine_similarity(x, y), 6) + 0.0 AS cosine FROM f""")
def vector_fusion(spark, d):
    rounded = lambda v: F.transform(v, lambda x: F.round(x, 6))
    x, y = F.col("x"), F.col("y")
    return _next(spark, d).select("vec_id", rounded(V.fuse(x, y)).alias("fused"), rounded(V.merge_latents(x, y, 0.25)).alias("merged"), rounded(V.merge_latents(x, y, 0.5, True)).alias("negative"), r6(V.cosine(x, y)).alias("cosine"))


@query(f"""{_NEXT}, l AS (SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda z: exp(z - list_max(x))))) AS lse, len(x) AS n, list_transform(y, lambda z: CASE WHEN z > 0 THEN 1.0::DOUBLE ELSE 0 END) AS t FROM v)
SELECT vec_id, round(list_sum(list_transform(range(1, n + 1), lambda i: greatest(x[i], 0) - x[i] * t[i] + ln(1 + exp(-abs(x[i]))))) / n, 6) AS bce, round(-list_sum(list_transform(range(1, n + 1), lambda i: (x[i] - lse) * t[i])) / n, 6) AS softmax_bce,
  round(-0.5::DOUBLE * list_sum(list_transform(range(1, n + 1), lambda i: 1 + y[i] - x[i] * x[i] - exp(y[i]))) / n, 6) AS kl, round(list_sum(list_transform(range(1, n + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]) + pow(exp(x[i] / 2) - exp(y[i] / 2), 2))), 6) AS ot,
  round(0.5::DOUBLE * list_sum(list_transform(range(1, n + 1), lambda i: y[i] - x[i] + (exp(x[i]) + pow(x[i] - y[i], 2)) / exp(y[i]) - 1)), 6) AS kl_between,
  round(list_sum(list_transform(range(1, n + 1), lambda i: -0.5::DOUBLE * (y[i] + ln(2 * pi()) + pow(x[i] - x[1], 2) / exp(y[i])))), 5) AS log_normal FROM l""")
def loss_terms(spark, d):
    x, y = F.col("x"), F.col("y")
    labels = F.transform(y, lambda z: F.when(z > 0, 1.0).otherwise(0.0))
    e = lambda v: F.transform(v, F.exp)
    return _next(spark, d).select(
        "vec_id", r6(V.bce_with_logits(x, labels)).alias("bce"), r6(V.softmax_bce(x, labels)).alias("softmax_bce"), r6(V.kl_standard(x, y)).alias("kl"), r6(V.bures_wasserstein(x, e(x), y, e(y))).alias("ot"),
        r6(V.kl_between(x, x, y, y)).alias("kl_between"), F.round(V.log_normal(x, F.transform(x, lambda z: F.get(x, F.lit(0))), y), 5).alias("log_normal"),
    )


_BATCH = f"""{_NEXT}, l AS (SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda z: exp(z - list_max(x))))) AS lx, list_max(y) + ln(list_sum(list_transform(y, lambda z: exp(z - list_max(y))))) AS ly, len(x) AS n,
  list_transform(x, lambda z: z / 2) AS h, list_transform(y, lambda z: CASE WHEN z > 0 THEN 1.0::DOUBLE ELSE 0 END) AS t, list_transform(range(1, len(x) + 1), lambda i: (x[i] + y[i]) / 2) AS m FROM v),
k AS (SELECT *, list_max(m) + ln(list_sum(list_transform(m, lambda z: exp(z - list_max(m))))) AS lm FROM l),
terms AS (SELECT *, -list_sum(list_transform(range(1, n + 1), lambda i: (x[i] - lx) * t[i])) / n AS bx, -list_sum(list_transform(range(1, n + 1), lambda i: (y[i] - ly) * t[i])) / n AS br, -list_sum(list_transform(range(1, n + 1), lambda i: (m[i] - lm) * t[i])) / n AS bm,
  -0.5::DOUBLE * list_sum(list_transform(h, lambda z: 1 + z - exp(z))) / n AS sh, -0.5::DOUBLE * list_sum(list_transform(y, lambda z: 1 + z - exp(z))) / n AS sy,
  -0.5::DOUBLE * list_sum(list_transform(range(1, n + 1), lambda i: 1 + h[i] - x[i] * x[i] - exp(h[i]))) / n AS kx, -0.5::DOUBLE * list_sum(list_transform(range(1, n + 1), lambda i: 1 + y[i] - y[i] * y[i] - exp(y[i]))) / n AS ky,
  list_sum(list_transform(range(1, n + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]) + pow(exp(h[i] / 2) - exp(y[i] / 2), 2))) AS ot,
  0.5::DOUBLE * list_sum(list_transform(range(1, n + 1), lambda i: y[i] - h[i] + (exp(h[i]) + pow(x[i] - y[i], 2)) / exp(y[i]) - 1)) AS kl,
  0.25::DOUBLE * list_sum(list_transform(range(1, n + 1), lambda i: 2 * ln((exp(h[i]) + exp(y[i])) / 2) - h[i] - y[i] + (exp(h[i]) + exp(y[i]) + 2 * pow((x[i] - y[i]) / 2, 2)) / ((exp(h[i]) + exp(y[i])) / 2) - 2)) AS js FROM k)"""


def _batches(spark, d) -> DataFrame:
    """Neighbouring vectors as the Gaussians and logits of a training step, 16 to a batch."""
    rows = _next(spark, d)
    middle = F.zip_with("x", "y", lambda a, b: (a + b) / 2)
    return rows.select(
        "vec_id", F.floor(F.col("vec_id") / 16).alias("batch"), F.col("x").alias("mu"), F.transform("x", lambda z: z / 2).alias("logvar"), F.col("y").alias("prior_mu"), F.col("y").alias("prior_logvar"),
        middle.alias("merged"), F.col("x").alias("text"), F.col("y").alias("rec"), F.transform("y", lambda z: F.when(z > 0, 1.0).otherwise(0.0)).alias("labels"),
    )


@query(f"""{_BATCH} SELECT vec_id, round((bm + bx + br) / 3 + 0.25::DOUBLE * (kx + ky), 6) AS prior, round((bm + bx + br) / 3 + 0.25::DOUBLE * (kx + ky) + 2 * ot, 5) AS prior_ot,
  round((bm + bx + br) / 3 + 0.25::DOUBLE * (sh + sy) + 2 * ot, 5) AS ot, round((bm + bx + br) / 3 + 0.25::DOUBLE * (sh + sy) + 2 * js, 5) AS js, round((bm + bx + br) / 3 + 2.25::DOUBLE * kl, 5) AS kl FROM terms""")
def training_losses(spark, d):
    rows = _batches(spark, d)
    own = [F.col(c) for c in ("merged", "text", "rec", "labels", "mu", "logvar", "prior_mu", "prior_logvar")]
    return rows.select(
        "vec_id", r6(V.prior_bce(*own, anneal=0.5)).alias("prior"), F.round(V.prior_bce(*own, anneal=0.5, epsilon=2.0, how="ot"), 5).alias("prior_ot"),
        *[F.round(V.disentangled_loss(*own, how=how, anneal=0.5, epsilon=2.0), 5).alias(how) for how in ("ot", "js", "kl")],
    )


@query(f"""{_BATCH}, u AS (SELECT vec_id // 16 AS batch, vec_id, x || list_transform(h, lambda z: exp(z)) AS e, y || list_transform(y, lambda z: exp(z)) AS p, bm + bx + br + sh + sy AS own FROM terms),
s AS (SELECT b.batch, b.vec_id, ln(sum(exp(list_cosine_similarity(a.e, b.p)))) AS against FROM u a JOIN u b ON a.batch = b.batch GROUP BY ALL),
c AS (SELECT batch, avg(own) AS own, -avg(list_cosine_similarity(e, p) - against) AS contrastive FROM u JOIN s USING (batch, vec_id) GROUP BY 1)
SELECT batch::BIGINT AS batch, round(contrastive, 6) AS contrastive, round((own + 0.5::DOUBLE * contrastive) / 3, 6) AS loss FROM c""")
def contrastive_losses(spark, d):
    rows = _batches(spark, d)
    return V.contrastive(rows).join(V.contrastive_loss(rows, epsilon=0.5), "batch").select("batch", r6("contrastive").alias("contrastive"), r6("loss").alias("loss"))


_SIZES = "['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD']"


@query(f"""c AS (SELECT user_id, p_type, count(*) AS n FROM ratings JOIN part ON p_partkey = movie_id GROUP BY ALL), s AS (SELECT user_id, list_transform({_SIZES}, lambda g: coalesce((map_from_entries(list((p_type, n))))[g], 0) / sum(n)::DOUBLE) AS v FROM c GROUP BY 1)
SELECT user_id, list_transform(v, lambda x: round(x, 6)) AS shares, list_transform(range(1, 7), lambda i: CASE WHEN i = 4 THEN 1.0::DOUBLE ELSE round(v[i], 6) END) AS small, [0, 0, 0, 1, 0, 0]::DOUBLE[] AS one_hot, list_transform(range(1, 7), lambda i: CASE WHEN i = 4 THEN 0.0::DOUBLE ELSE round(v[i], 6) END) AS negative,
  list_transform(range(1, 7), lambda i: round(v[CASE i WHEN 4 THEN 1 WHEN 1 THEN 4 ELSE i END], 6)) AS proportional FROM s""")
def genre_steering(spark, d):
    names = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    rows = A.ratings(spark, d).join(A.table(spark, d, "part").select(F.col("p_partkey").alias("movie_id"), "p_type"), "movie_id")
    shares = rows.groupBy("user_id").agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("p_type") == g, 1).otherwise(0)).alias(g) for g in names])
    own = shares.select("user_id", F.array(*[F.col(g) / F.col("n") for g in names]).alias("v"))
    v, g = F.col("v"), F.lit("PROMO")
    rounded = lambda x: F.transform(x, lambda y: F.round(y, 6))
    return own.select("user_id", rounded(v).alias("shares"), *[rounded(V.steer(v, names, g, m)).alias(m) for m in ("small", "one_hot", "negative")], rounded(V.steer(v, names, g, "proportional", F.lit("ECONOMY"))).alias("proportional"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL", base=False)
def hourly_events(spark, d):
    """The streaming plan over a table."""
    rows = windowed_counts(A.table(spark, d, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query()
def autoencoder_recommendations(spark, d):
    """A dense encoder-decoder over all users; its weights are fixed by a seed, as training is not the engine's."""
    items = A.catalog(spark, d).select("item_index")
    n, rng, hidden = items.distinct().count(), np.random.default_rng(0), 32
    normal = lambda a, *shape: rng.normal(0, a**-0.5, shape)

    def last() -> Iterator[np.ndarray]:
        """The last layer's rows, drawn after the first layer and those between, then its bias."""
        inner.encoder[1:] = [(normal(hidden, hidden, 16), np.zeros(16))]
        inner.decoder[:1] = [(normal(8, 8, hidden), np.zeros(hidden))]
        yield from (normal(hidden, n) for _ in range(hidden))
        yield np.zeros(n)

    none = (np.eye(hidden), np.zeros(hidden))  # the layers of items are in the blocks
    inner = neural.make("vae", encoder=[none], decoder=[none, none], latent=8, normalize=False)
    model = neural.write_blocks(items, inner, lambda size: normal(n, size, hidden), last())
    return neural.score_blocks(I.binary_matrix(A.positives(spark, d)), model)
