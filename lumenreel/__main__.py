"""Command line: requests answered and evaluations made over a folder of the star-schema tables, printed as JSON.

python -m lumenreel demo SF_DIR DESCRIPTION [--liked TITLE]... [--disliked-genre GENRE]... [--top-k N]
python -m lumenreel pipeline SF_DIR [--liked TITLE]... [--disliked GENRE]... [--context TEXT] [--summary TEXT] [--top-k N]
python -m lumenreel evaluate SF_DIR [--seed N] [--top-k N] [--output-dir DIR]
python -m lumenreel text-training SF_DIR [--output-dir DIR]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import requests as Q
from .plans import queries
from .plans.evaluate import Protocol
from .sources import adapter, readers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lumenreel", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    names = out.add_subparsers(dest="command", required=True)
    demo, pipeline, evaluate, training = (names.add_parser(n) for n in ("demo", "pipeline", "evaluate", "text-training"))
    for one in (demo, pipeline, evaluate, training):
        one.add_argument("sf_dir")
    demo.add_argument("description")
    demo.add_argument("--disliked-genre", action="append", default=[])
    pipeline.add_argument("--disliked", action="append", default=[])
    pipeline.add_argument("--context", default="")
    pipeline.add_argument("--summary")
    for one in (demo, pipeline):
        one.add_argument("--liked", action="append", default=[])
    evaluate.add_argument("--seed", type=int, default=2026)
    for one in (demo, pipeline, evaluate):
        one.add_argument("--top-k", type=int, default=10)
    for one in (evaluate, training):
        one.add_argument("--output-dir")
    return out


def request(spark: SparkSession, description: str = "", summary: str = "", context: str = "", liked=(), disliked_genres=(), disliked=(), top_k: int = 10) -> DataFrame:
    row = (1, description, summary, context, list(liked), list(disliked_genres), list(disliked), [], top_k, 0.75)
    return spark.createDataFrame([row], Q.SCHEMA)


def demo(spark: SparkSession, engine: Engine, a: argparse.Namespace) -> list:
    """The items of one request."""
    rows = engine.recommend(request(spark, a.description, liked=a.liked, disliked_genres=a.disliked_genre, top_k=a.top_k)).collect()
    return [i.asDict(recursive=True) for r in rows for i in r["items"]]


def pipeline(spark: SparkSession, engine: Engine, a: argparse.Namespace) -> dict:
    """A summary made of what is liked, disliked and said, unless one is given, and the items that it leads to."""
    asked = request(spark, "", a.summary or "", a.context, a.liked, (), a.disliked, a.top_k)
    if not a.summary:
        summary = engine.summarize(asked).first()["summary"]
        asked = request(spark, "", summary, a.context, a.liked, (), a.disliked, a.top_k)
    rows = engine.recommend(asked).collect()
    return {"summary": a.summary or summary, "recommendations": [i.asDict(recursive=True) for r in rows for i in r["items"]]}


def evaluate(spark: SparkSession, positives: DataFrame, catalog: DataFrame, a: argparse.Namespace) -> dict:
    """Test metrics of all models; with a folder, the report is written there too."""
    protocol = Protocol(positives, catalog, a.seed)
    models = protocol.comparison(a.top_k).withColumn("penalty", F.lit(None).cast("double")).unionByName(protocol.ease_comparison(a.top_k))
    rows = [r.asDict() for r in models.orderBy("model").collect()]  # a row for each model
    report = {"seed": a.seed, "top_k": a.top_k, "dataset": readers.fingerprint(positives.select("user_id", "item_index")), "models": rows}
    if a.output_dir:
        readers.write_report(spark, report, a.output_dir, rows[0]["users"], a.seed)
    protocol.release()
    return report


def main(args: list[str]) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("lumenreel").getOrCreate()
    positives, catalog = adapter.positives(spark, a.sf_dir), adapter.catalog(spark, a.sf_dir)
    if a.command in ("demo", "pipeline"):
        engine = Engine(positives, catalog)
        out = demo(spark, engine, a) if a.command == "demo" else pipeline(spark, engine, a)
    elif a.command == "evaluate":
        out = evaluate(spark, positives, catalog, a)
    else:  # descriptions of histories, which a text encoder is trained on elsewhere
        rows = queries.history_descriptions(spark, a.sf_dir)
        if a.output_dir:
            rows.write.mode("overwrite").parquet(a.output_dir)
        out = {"rows": rows.count(), "columns": rows.columns}
    print(json.dumps(out, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
