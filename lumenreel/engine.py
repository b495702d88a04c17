"""The service surface as tables: fit once, then answer tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .functions import vectors as V
from .operators import interactions as I
from .operators import linear, nearest, neural
from .operators import models as S
from .operators import ranking as R
from .operators import requests as Q
from .operators.itemside import ItemSide
from .sources.readers import vocabulary


class Engine:
    """Recommendations from positives (user_id, item_index) and a catalog; regularization is the linear autoencoder's."""

    def __init__(self, positives: DataFrame, catalog: DataFrame, regularization: float = 500.0, encoder=None, scorer=None):
        self.catalog = catalog
        self.encoder, self.scorer = encoder, scorer
        self.history = I.binary_matrix(positives)
        self.side = ItemSide(catalog, S.popularity(self.history, catalog))
        self.weights = linear.fit(self.history, self.side, regularization)
        self.genres = [r[0] for r in vocabulary(catalog).collect()]

    def recommend_users(self, history: DataFrame, k: int = 10, **how) -> DataFrame:
        """Lists of users by the scorer that the engine was given (see operators.neural.score_users)."""
        if self.scorer is None:
            raise ValueError("the engine has no scorer")
        return neural.score_users(history, self.scorer, self.side.ids(), k, **how)

    def recommend_texts(self, requests: DataFrame, embeddings: DataFrame, k: int = 12) -> DataFrame:
        """query_id, rank, rank_label, item_index, title and score by vectors of texts, with boosts of liked titles.

        requests: query_id, summary, context, liked, disliked_genres, alpha; embeddings: item_index, embedding. The
        engine's encoder makes a vector of each text; alpha of the summary's is fused with the rest of the context's.
        """
        if self.encoder is None:
            raise ValueError("the engine has no encoder")
        vector = neural.text_encoder(self.encoder)
        rows = requests.withColumns({"s_vec": vector(F.coalesce("summary", F.lit(""))), "c_vec": vector(F.coalesce("context", F.lit("")))})
        mixed = V.normalize(F.zip_with("s_vec", "c_vec", lambda s, c: F.col("alpha") * s + (F.lit(1.0) - F.col("alpha")) * c))
        fused = F.when(F.col("s_vec").isNull(), F.col("c_vec")).when(F.col("c_vec").isNull(), F.col("s_vec")).otherwise(mixed)
        queries = rows.select("query_id", F.transform(fused, lambda x: x.cast("double")).alias("embedding")).where("embedding IS NOT NULL")
        titles = self.catalog.select("item_index", "title", "genres")
        items = embeddings.join(titles, "item_index").withColumnRenamed("item_index", "item_id")
        liked = R.liked_boost(titles, requests.select("query_id", F.explode("liked").alias("title")))
        banned = requests.select("query_id", F.explode("disliked_genres").alias("genre"))
        found = nearest.top_k(queries, items, k, liked, 0.15, banned)
        named = found.join(titles.select(F.col("item_index").alias("item_id"), "title"), "item_id")
        return named.select("query_id", "rank", F.concat(F.lit("Rank #"), F.col("rank").cast("string")).alias("rank_label"), F.col("item_id").alias("item_index"), "title", "score")

    def describe(self) -> dict:
        return {"status": "ok", "model": "linear autoencoder with genre control", "catalog_size": self.side.items.n}

    def recommend(self, requests: DataFrame) -> DataFrame:
        """request_id and the ranked items of each request (see operators.requests)."""
        rows = Q.prepared(requests, self.catalog, self.genres)
        return Q.described(Q.answer(rows, self.side, self.weights), self.catalog)

    def summarize(self, requests: DataFrame) -> DataFrame:
        """request_id and summary of liked, disliked and context."""
        return requests.select("request_id", X.taste_summary(F.col("liked"), F.col("disliked"), F.coalesce("context", F.lit(""))).alias("summary"))

    def summarize_genres(self, requests: DataFrame) -> DataFrame:
        return requests.select("request_id", X.genre_summary(F.col("genres"), F.coalesce("context", F.lit(""))).alias("summary"))

    def recommend_genres(self, requests: DataFrame) -> DataFrame:
        """Answers to requests of genres and context (request_id, genres, context, top_k)."""
        none = F.array().cast("array<string>")
        text = X.genre_summary(F.col("genres"), F.coalesce("context", F.lit("")))
        asked = requests.select("request_id", text.alias("description"), F.lit("").alias("summary"), F.lit("").alias("context"), *[none.alias(c) for c in ("liked", "disliked_genres", "disliked", "exclude_titles")], "top_k")
        return self.recommend(asked)

    def summarize_movies(self, requests: DataFrame) -> DataFrame:
        """request_id and the summary of movie_ids, unknown ones left out."""
        rows = requests.select("request_id", F.posexplode("movie_ids").alias("pos", "movie_id")).join(self.catalog.select("movie_id", "title", "genres"), "movie_id")
        own = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "genres"))).alias("m"))
        text = X.selection_summary(F.col("m.title"), F.flatten("m.genres"))
        return requests.select("request_id").join(own, "request_id", "left").select("request_id", F.coalesce(text, F.lit("")).alias("summary"))
