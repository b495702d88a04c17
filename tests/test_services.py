"""Data sources of one large JSON object and of paged services, against plain reading."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lumenreel.sources import json_map, pages


def awkward_map(n):
    rng = random.Random(n)
    pieces = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "日本", "\n", "a", "\\\\", '\\"', " "]
    return {f"{i}{rng.choice(['', '.0', ' \\', '\"{', ','])}": "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 5, 40]))) for i in range(n)}


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_ranges_equal_whole_reading(spark, tmp_path, size):
    """Quotes, backslashes and braces in strings, entries across many borders, non-ASCII and escaped text."""
    for ascii_ in (True, False):
        want = awkward_map(60 if size > 10 else 12)
        path = tmp_path / f"m{ascii_}"
        path.write_text(json.dumps(want, ensure_ascii=ascii_, indent=1 if ascii_ else None))
        got = json_map.read_json_map(spark, str(path), size=size)
        assert {r.key: r.value for r in got.collect()} == want and got.count() == len(want)
        assert got.rdd.getNumPartitions() == -(-path.stat().st_size // size)


def test_lists_nested_values_and_repeated_keys(spark, tmp_path):
    (tmp_path / "l").write_text('{"1": ["a", "b,{"], "2": [], "1": ["c"], "3": {"x": [1]}, "4": "text", "5": [1, null]}')
    for size in (5, 1 << 20):
        got = json_map.read_json_map(spark, str(tmp_path / "l"), "array<string>", size)
        assert sorted((r.key, r.value) for r in got.collect() if r.value is not None) == [("1", ["a", "b,{"]), ("1", ["c"]), ("2", []), ("5", ["1", None])]
        assert sorted(r.key for r in got.collect()) == ["1", "1", "2", "3", "4", "5"]
    for text in ("{}", " { } ", ""):
        (tmp_path / "e").write_text(text)
        assert json_map.read_json_map(spark, str(tmp_path / "e"), size=3).count() == 0


@pytest.fixture
def service(tmp_path):
    for page in range(1, 5):
        (tmp_path / f"list-{page}.json").write_text(json.dumps({"results": [{"id": 10 * page + i, "title": f"T {page}{i}"} for i in range(3)]}))
    (tmp_path / "search-T 10.json").write_text(json.dumps({"results": [{"id": 10, "vote": 7.5}, {"id": 99, "vote": 1.0}]}))
    (tmp_path / "search-T 11.json").write_text(json.dumps({"results": []}))
    (tmp_path / "detail-10.json").write_text(json.dumps({"runtime": 90, "genres": ["War"]}))
    return f"file://{tmp_path}"


def test_list_search_and_detail(spark, service):
    listed = pages.popular(spark, service + "/list-{page}.json", 9, "id long, title string", limit=7)
    assert [(r.page, r.place, r.id, r.title) for r in listed.orderBy("page", "place").collect()] == [(p, i, 10 * p + i, f"T {p}{i}") for p in (1, 2, 3) for i in range(3)][:7]
    assert pages.read_pages(spark, service + "/list-{page}.json", 1, 4).rdd.getNumPartitions() == 4
    hits = pages.first_hits(listed, service + "/search-{query}.json", "id long, vote double")
    assert [tuple(r) for r in hits.collect()] == [("T 10", 10, 7.5)]
    joined = pages.details(listed, service + "/detail-{id}.json", "runtime int, genres array<string>").join(hits.select("id", "vote"), "id", "left")
    got = {r.id: (r.vote, r.detail and tuple(r.detail)) for r in joined.collect()}
    assert len(got) == 7 and got[10] == (7.5, (90, ["War"])) and got[11] == (None, None)


def test_a_page_is_tried_again(tmp_path, monkeypatch):
    calls = []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return b"[1]"

    def open_(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise pages.urllib.error.URLError("busy")
        return Answer()

    monkeypatch.setattr(pages.urllib.request, "urlopen", open_)
    assert pages.fetch("http://x", 3, 0.0) == [1] and len(calls) == 3
    calls.clear()
    with pytest.raises(pages.urllib.error.URLError):
        pages.fetch("http://x", 2, 0.0)


def test_a_stream_goes_on_after_its_last_page(spark, service, tmp_path):
    def run():
        q = pages.stream_pages(spark, service + "/list-{page}.json", step=2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.page, r.place) for r in spark.read.schema(pages.SCHEMA).parquet(str(tmp_path / "out")).collect())

    assert run() == [(p, i) for p in range(1, 5) for i in range(3)]
    (tmp_path / "list-5.json").write_text(json.dumps({"results": [{"id": 50}]}))
    assert run() == [(p, i) for p in range(1, 5) for i in range(3)] + [(5, 0)]
    assert spark.read.schema(pages.SCHEMA).parquet(str(tmp_path / "out")).where(F.col("page") == 5).count() == 1
