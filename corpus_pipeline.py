"""A training-corpus pipeline over ``documents``: language, near copies, repeated passages, source mix, packing.

Each stage takes what the one before it kept, written as Parquet and read again. All but the last return the columns of
documents, with any others the table has: while a stage works, columns have names of their own, so none can clash with
what an operator adds. Nulls: a null text has no language and goes in the first stage; a null doc_id, lang or source is
allowed throughout. Of near copies one row stays, with or without a doc_id; different texts that share a doc_id stay both.
Empty tables give empty tables, texts are whole, however long, and repeated rows are copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm import langid, mixing, packing, simhash, substrings
from lumenreel.llm.hashing import fold
from lumenreel.llm.shared import discard, materialise

MIN_LANGUAGE_SCORE = 0.4


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by their places, and the name of each column there."""
    names = {c: f"column_{i}_" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose best language is unlikely."""
    model = langid.learn(docs.select("doc_id", "text", "lang"), where=fold(F.col("doc_id"), 4) != 2)
    own, names = _renamed(docs)
    judged = langid.predict(own, model, names["text"])
    kept = judged.where((F.col("lang_pred") != langid.NONE) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*own.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id stays."""
    own, names = _renamed(docs)
    return simhash.keep_first(spark, own, id_col=names["doc_id"], text_col=names["text"]).toDF(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document with a smaller doc_id has; a document that keeps no word goes."""
    own, names = _renamed(docs)
    text, n_chars = names["text"], names["n_chars"]
    cut = substrings.remove_repeats(spark, own, keep_text=True, id_col=names["doc_id"], text_col=text)
    left = cut.where((F.col("n_removed") == 0) | (F.col(text) != ""))
    counted = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col(n_chars))
    return left.withColumn(n_chars, counted).select(*own.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as many times as the mix does."""
    own, names = _renamed(docs)
    mixed = mixing.mix(own, boost=mixing.by_length, extra=tuple(own.columns), id_col=names["doc_id"], text_col=names["text"], source_col=names["source"])
    taken = mixed.where("copies > 0").select(*own.columns, F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return taken.select(*own.columns).toDF(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("packing", pack_documents),
]

#: Models, fingerprints and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir), name)
        discard(docs)  # the table before, of which nothing is read again
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
