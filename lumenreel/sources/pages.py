"""Paged services as a Python data source, batch and stream: a page is a partition, or a step of the stream's offset.

``url`` is a template with ``{page}``; pages are JSON documents whose rows lie under ``items``. A page is asked for up to
``tries`` times. A batch reads the pages from ``first`` to ``last``. A stream goes on with the page after the last one
that its checkpoint has, up to ``step`` pages at a time, as long as the service has them, so a list that was broken off
is taken up where it was. Any URL that Python opens will do: http, https, or file for a folder of static pages.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..shipping import ship
from .readers import enrich

SCHEMA = "page int, place int, item string"


def fetch(url: str, tries: int = 3, wait: float = 0.2) -> object | None:
    """The JSON document at url; None if there is none (404, or no such file). Other failures are tried again, then raised."""
    for turn in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=30) as answer:  # noqa: S310
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if turn == tries - 1:
                raise
        except urllib.error.URLError as e:
            if isinstance(e.reason, FileNotFoundError):
                return None
            if turn == tries - 1:
                raise
        time.sleep(wait * 2**turn)
    return None


class _Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class _Service:
    def __init__(self, options: dict):
        self.url, self.items = options["url"], options.get("items", "")
        self.first, self.last = int(options.get("first", 1)), int(options.get("last", options.get("first", 1)))
        self.step, self.tries = int(options.get("step", 10)), int(options.get("tries", 3))

    def document(self, page: int):
        return fetch(self.url.replace("{page}", str(page)), self.tries)

    def rows(self, page: int):
        document = self.document(page)
        for name in filter(None, self.items.split(".")):
            document = document.get(name) if isinstance(document, dict) else None
        for place, item in enumerate(document or []):
            yield page, place, json.dumps(item)


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.service = _Service(options)

    def partitions(self) -> list[InputPartition]:
        return [_Page(p) for p in range(self.service.first, self.service.last + 1)]

    def read(self, partition: _Page | None):
        if partition is not None:
            yield from self.service.rows(partition.page)


class PagesStream(DataSourceStreamReader):
    """Offsets are the next page that has not been read."""

    def __init__(self, options: dict):
        self.service, self.next = _Service(options), None

    def initialOffset(self) -> dict:
        return {"page": self.service.first}

    def latestOffset(self) -> dict:
        page = self.service.first if self.next is None else self.next
        for _ in range(self.service.step):
            if self.service.document(page) is None:
                break
            page += 1
        self.next = page
        return {"page": page}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.next = max(self.next or 0, end["page"])
        return [_Page(p) for p in range(start["page"], end["page"])]

    def read(self, partition: _Page):
        yield from self.service.rows(partition.page)

    def commit(self, end: dict) -> None:
        self.next = max(self.next or 0, end["page"])


class Pages(DataSource):
    """Format ``pages``: page, place in it and the item as JSON."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagesStream(self.options)


def read_pages(spark: SparkSession, url: str, first: int, last: int, items: str = "results", tries: int = 3) -> DataFrame:
    """The rows of the pages from first to last (included), a partition each; pages that are not there have none."""
    ship(spark)
    spark.dataSource.register(Pages)
    return spark.read.format("pages").options(url=url, first=str(first), last=str(last), items=items, tries=str(tries)).load()


def stream_pages(spark: SparkSession, url: str, first: int = 1, items: str = "results", step: int = 10) -> DataFrame:
    ship(spark)
    spark.dataSource.register(Pages)
    return spark.readStream.format("pages").options(url=url, first=str(first), items=items, step=str(step)).load()


def popular(spark: SparkSession, url: str, pages: int, schema: str, limit: int = 100, items: str = "results") -> DataFrame:
    """The first limit items of a paged list, with its columns (schema), page and place."""
    rows = read_pages(spark, url, 1, pages, items).orderBy("page", "place").limit(limit)
    return rows.select("page", "place", F.from_json("item", schema).alias("i")).select("page", "place", "i.*")


def first_hits(titles: DataFrame, url: str, schema: str, items: str = "results", ask: Callable[[str], object | None] = fetch) -> DataFrame:
    """title and the first hit of a search for each title (url has {query}); titles without a hit have no row."""

    def look(row: dict) -> dict | None:
        document = ask(url.replace("{query}", urllib.parse.quote(row["title"], safe="")))
        hits = document.get(items) if isinstance(document, dict) else None
        return {"title": row["title"], "hit": json.dumps(hits[0])} if hits else None

    found = enrich(titles.select("title"), look, "title string, hit string")
    return found.select("title", F.from_json("hit", schema).alias("h")).select(F.col("title").alias("asked"), "h.*")


def details(rows: DataFrame, url: str, schema: str, ask: Callable[[str], object | None] = fetch) -> DataFrame:
    """The rows (id) with the document of each id (url has {id}) as a column detail, null where there is none."""

    def look(row: dict) -> dict | None:
        document = ask(url.replace("{id}", str(row["id"])))
        return None if document is None else {"id": row["id"], "detail": json.dumps(document)}

    kind = rows.schema["id"].dataType.simpleString()
    found = enrich(rows.select("id").distinct(), look, f"id {kind}, detail string")
    return rows.join(found.select("id", F.from_json("detail", schema).alias("detail")), "id", "left")
