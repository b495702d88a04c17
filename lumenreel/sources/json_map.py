"""One large JSON object read in parts: a Python data source whose partitions are byte ranges.

Where a range begins, nothing tells whether its first byte lies in a string. So a first job scans every range for each
state it may begin in (outside strings, in one, in one after a backslash) and notes the state and the change of depth at
its end; the states of all ranges follow from these few numbers, in order. The source's partitions then begin in known
states: a range yields the entries of the object that start in it, and reads on past its end until the last one ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import folders
from ..shipping import ship

RANGE = 32 << 20
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_OPEN, _SHUT = np.frombuffer(b"{[", np.uint8), np.frombuffer(b"}]", np.uint8)


def _outside(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Which bytes lie outside strings (quotes are inside), and the state after the last one."""
    back = data == 0x5C
    if state == ESCAPED and len(data):
        back[0] = False
    # A byte is escaped if an odd run of backslashes ends before it.
    last = np.maximum.accumulate(np.where(back, -1, np.arange(len(data)))) if len(data) else np.empty(0, np.int64)
    run = np.arange(len(data)) - last  # backslashes up to and with this byte
    before = np.append(0, run[:-1]) if len(data) else run
    escaped = before % 2 == 1
    if state == ESCAPED and len(data):
        escaped[0] = True
    quote = (data == 0x22) & ~escaped
    inside = (np.cumsum(quote) + (state != OUTSIDE)) % 2 == 1
    end = OUTSIDE if not len(data) and state == OUTSIDE else state if not len(data) else OUTSIDE if not inside[-1] else ESCAPED if run[-1] % 2 == 1 else INSIDE
    return ~inside & ~quote, end


def summary(data: bytes) -> list[tuple[int, int]]:
    """For each state that a range may begin in: the state at its end and the change of depth."""
    raw, out = np.frombuffer(data, np.uint8), []
    for state in (OUTSIDE, INSIDE, ESCAPED):
        free, end = _outside(raw, state)
        out.append((end, int((np.isin(raw, _OPEN) & free).sum()) - int((np.isin(raw, _SHUT) & free).sum())))
    return out


def _starts(data: bytes, state: int, depth: int) -> tuple[np.ndarray, int | None, int, int]:
    """Places after the brace that opens the object and the commas between its entries, and that of its closing brace."""
    raw = np.frombuffer(data, np.uint8)
    free, end = _outside(raw, state)
    level = depth + np.cumsum((np.isin(raw, _OPEN) & free).astype(np.int64) - (np.isin(raw, _SHUT) & free))
    marks = np.flatnonzero(free & (((raw == 0x7B) & (level == 1)) | ((raw == 0x2C) & (level == 1))))
    close = np.flatnonzero(free & (raw == 0x7D) & (level == 0))
    return marks, int(close[0]) if len(close) else None, end, int(level[-1]) if len(level) else depth


def entries(path: str, start: int, size: int, state: int, depth: int, length: int, step: int = 1 << 20) -> Iterator[tuple[str, object]]:
    """The (key, value) pairs that begin in a range."""
    data = folders.read_range(path, start, size)
    marks, close, end, level = _starts(data, state, depth)
    if not len(marks):
        return
    at = start + size
    tail = close
    if tail is None:  # on to the end of the last entry
        while at < length:
            more = folders.read_range(path, at, step)
            next_marks, next_close, end, level = _starts(more, end, level)
            stop = min([*next_marks[:1].tolist(), *([next_close] if next_close is not None else [])], default=None)
            base, data, at = len(data), data + more, at + len(more)
            if stop is not None:
                tail = base + int(stop)
                break
    text = data[int(marks[0]) + 1 : tail if tail is not None else len(data)].strip()
    if text:
        yield from _pairs(json.loads(b"{" + text + b"}", object_pairs_hook=_Pairs))


class _Pairs(list):
    """An object's pairs in order, repeated keys and all."""


def _pairs(entries_: _Pairs) -> Iterator[tuple[str, object]]:
    for key, value in entries_:
        yield key, None if isinstance(value, _Pairs) else value


class _Range(InputPartition):
    def __init__(self, start: int, size: int, state: int, depth: int):
        self.start, self.size, self.state, self.depth = start, size, state, depth


class JsonMapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.length = options["path"], int(options["length"])
        self.ranges = json.loads(options["ranges"])
        self.lists = options.get("values", "string") != "string"

    def partitions(self) -> list[InputPartition]:
        return [_Range(*r) for r in self.ranges]

    def read(self, partition: _Range | None):
        if partition is None:  # a file without a byte has no ranges
            return
        kind = list if self.lists else str
        for key, value in entries(self.path, partition.start, partition.size, partition.state, partition.depth, self.length):
            if kind is list and isinstance(value, list):
                yield key, [x if isinstance(x, str) or x is None else json.dumps(x) for x in value]
            else:
                yield key, value if isinstance(value, kind) else None


class JsonMap(DataSource):
    """Format ``json_map``: key and value (a string, or an array of strings) of the entries of one JSON object."""

    @classmethod
    def name(cls) -> str:
        return "json_map"

    def schema(self) -> str:
        return f"key string, value {self.options.get('values', 'string')}"

    def reader(self, schema) -> DataSourceReader:
        return JsonMapReader(self.options)


def read_json_map(spark: SparkSession, path: str, values: str = "string", size: int = RANGE) -> DataFrame:
    """key and value of one JSON object's entries, in as many partitions as the file has ranges of size bytes.

    values is ``string`` or ``array<string>``; values of another kind are null. An entry belongs to the range in which it
    begins, however long it is; a key that is met twice has two rows.
    """
    ship(spark)
    fs, at = folders.file_system(path)
    length = fs.get_file_info(at).size or 0
    starts = list(range(0, length, size))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch.id:
                found = summary(folders.read_range(path, int(number) * size, min(size, length - int(number) * size)))
                yield pd.DataFrame({"number": [number], "ends": [[e for e, _ in found]], "depths": [[d for _, d in found]]})

    rows = spark.range(0, len(starts), 1, max(len(starts), 1)).mapInPandas(scan, "number long, ends array<int>, depths array<int>").collect()  # a row for each range
    state, depth, ranges = OUTSIDE, 0, []
    for r in sorted(rows, key=lambda r: r["number"]):
        start = int(r["number"]) * size
        ranges.append([start, min(size, length - start), state, depth])
        state, depth = r["ends"][state], depth + r["depths"][state]
    spark.dataSource.register(JsonMap)
    return spark.read.format("json_map").options(path=path, length=str(length), ranges=json.dumps(ranges), values=values).load()
