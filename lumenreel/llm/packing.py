"""Packing by cutting-stock column generation.

Documents become ids plus an end id and are cut into pieces of at most ``length`` ids: full pieces, then what is left.
Piece lengths are rounded up to ``grain`` ids, which gives a histogram of at most length / grain types whatever the
size of the corpus. Over this histogram a linear program chooses patterns (multisets of types that fit a sequence);
knapsack dynamic programming over the dual prices finds each new column, until Farley's bound shows that no pattern can
better the program by more than ``gap``. Pattern counts are rounded down and what they leave is packed first-fit
decreasing into a few more patterns. Then the k-th piece of a type takes the k-th slot that the patterns have for it:
ranks come from range partitions and prefix sums, so no step gathers the pieces, and a type with a third of all pieces
is dealt like any other.

Null and empty texts are the end id alone. Repeated rows and equal doc_ids are packed each on its own; null doc_ids
come first in their type. Very long texts are encoded whole, one at a time. An empty table gives no piece. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import blocks, discard, materialise, ship, utf8
from .tokens import default_tokenizer, encoder

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, length: int = 2048, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece; with_ids adds its ids as little-endian 32-bit integers."""
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def pieces(batches):
        enc = encoder(path)
        for b in blocks(batches):
            ids, at = enc.encode(utf8(b.column(1)))
            flat = np.insert(ids, at[1:], enc.dtype.type(end_id)).astype("<u4")
            at = at + np.arange(len(at))
            total = np.diff(at)
            n = -(-total // length)
            row = np.repeat(np.arange(len(n)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * length
            size = np.minimum(length, total[row] - start)
            raw = flat.tobytes()
            begin = (at[row] + start) * 4
            spans = [raw[s:e] for s, e in zip(begin.tolist(), (begin + size * 4).tolist(), strict=True)]
            out = {
                "doc_id": b.column(0).take(pa.array(row)), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int32()),
                "ids_crc32": pa.array(map(zlib.crc32, spans), pa.int64()), "doc_tokens": pa.array(total[row], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(spans, pa.binary())} if with_ids else {}))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(pieces, PIECES + (", ids binary" if with_ids else ""))


def _knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of types within capacity, by dynamic programming over the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.searchsorted(sizes, c, side="right")
        best[c] = best[c - 1]
        if fits:
            value = best[c - sizes[:fits]] + prices[:fits]
            k = int(value.argmax())
            if value[k] > best[c] + 1e-12:
                best[c], choice[c] = value[k], k
    taken, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            taken[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), taken


def _first_fit(left: np.ndarray, sizes: np.ndarray, capacity: int) -> dict[tuple, int]:
    """Patterns by first fit, largest first, each as often as it goes; they use up left."""
    found: dict[tuple, int] = {}
    left = left.copy()
    while left.any():
        p, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for k in np.flatnonzero(left)[::-1]:
            p[k] = min(left[k], room // sizes[k])
            room -= p[k] * sizes[k]
        times = int((left[p > 0] // p[p > 0]).min())
        found[tuple(p.tolist())] = found.get(tuple(p.tolist()), 0) + times
        left -= p * times
    return found


def patterns(counts: dict[int, int], capacity: int, gap: float = 1e-3, most_rounds: int = 1500) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: how many}, how often) that hold all pieces; counts: pieces by size, sizes up to capacity.

    The driver's work depends on the number of sizes alone, never on the number of pieces.
    """
    sizes = np.array(sorted(k for k, n in counts.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    pieces = np.array([counts[int(s)] for s in sizes], dtype=np.int64)
    demand = pieces.astype(np.float64)
    plain = _first_fit(pieces, sizes, capacity)
    pool = np.array(list(plain), dtype=np.float64)  # known patterns, tried before a knapsack is solved
    # Revised simplex from the patterns of a single size: columns of the basis, its inverse, and their use x.
    columns = np.diag(capacity // sizes).astype(np.float64)
    inverse = np.diag(1.0 / columns.diagonal())
    x = inverse @ demand
    bound = demand @ sizes / capacity  # prices in proportion to sizes are feasible
    centre = sizes / capacity
    for round_ in range(most_rounds):
        if x.sum() <= bound * (1 + gap):
            break
        price = inverse.sum(axis=0)  # duals: every pattern costs one sequence
        worth = pool @ price
        if worth.max() > 1 + 1e-6:
            taken = pool[worth.argmax()]
        else:
            # Prices between the duals and the best feasible ones settle faster; the duals decide at the end.
            for mix in (0.3, 1.0):
                value, taken = _knapsack(np.maximum(mix * price + (1 - mix) * centre, 0), sizes, capacity)
                feasible = np.maximum(mix * price + (1 - mix) * centre, 0) / max(value, 1)
                if demand @ feasible > bound:
                    bound, centre = demand @ feasible, feasible
                if taken @ price > 1 + 1e-9:
                    break
            else:
                break
        step = inverse @ taken
        ratio = np.where(step > 1e-10, x / np.where(step > 1e-10, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = taken
        x = x - ratio[out] * step
        x[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        if round_ % 200 == 199:
            inverse = np.linalg.inv(columns)
            x = np.maximum(inverse @ demand, 0)
    left, found = pieces.copy(), {}
    for k in range(len(sizes)):
        p = columns[:, k].round().astype(np.int64)
        times = int(min([x[k] + 1e-6, *(left[p > 0] // p[p > 0])]))
        if times > 0:
            found[tuple(p.tolist())] = found.get(tuple(p.tolist()), 0) + times
            left -= p * times
    # What rounding left is a few pieces for each pattern, whatever the size of the corpus.
    for p, times in _first_fit(left, sizes, capacity).items():
        found[p] = found.get(p, 0) + times
    if sum(plain.values()) < sum(found.values()):  # a handful of pieces
        found = plain
    return [({int(sizes[k]): int(n) for k, n in enumerate(p) if n}, times) for p, times in sorted(found.items(), reverse=True)]


def assign(pieces: DataFrame, length: int = 2048, grain: int = 8, gap: float = 1e-3) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, start and length, and any others)."""
    spark = pieces.sparkSession
    order = ["type", "doc_id", "start", "ids_crc32", "row"]
    # Written first: range bounds are sampled from this, which would run the encoding a second time. The row's number
    # lets equal pieces, a third of all perhaps, be cut into ranges too.
    typed = materialise(pieces.withColumns({"type": F.ceil(F.col("length") / F.lit(grain)).cast("int"), "row": F.monotonically_increasing_id()}), "pieces")
    ranged = materialise(typed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    discard(typed)
    per_part = ranged.groupBy("part", "type").agg(F.count("*").alias("n"))
    # Range partitions hold neighbouring types, so this has at most as many rows as there are types and partitions.
    base = per_part.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    counts = {r["type"]: r["n"] for r in ranged.groupBy("type").agg(F.count("*").alias("n")).collect()}  # at most length / grain rows
    slots, sequences, used = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in patterns(counts, length // grain, gap):
        for size, many in pattern.items():
            slots.append((size, used[size], used[size] + many * times, many, sequences))
            used[size] += many * times
        sequences += times
    table = spark.createDataFrame(slots, "type int, low long, high long, many long, first long")  # rows: a pattern for each type and a few more, each of length / grain types at most
    ranked = (
        ranged.join(F.broadcast(base), ["part", "type"])
        .withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("part", "type").orderBy("doc_id", "start", "ids_crc32", "row")) - 1)
        .join(F.broadcast(table), "type")
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumn("sequence_id", F.expr("first + (rank - low) div many"))
    )
    before = Window.partitionBy("sequence_id").orderBy(F.desc("type"), "rank").rowsBetween(Window.unboundedPreceding, -1)  # a sequence's pieces
    return ranked.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(*pieces.columns, "sequence_id", "offset")


def pack(spark: SparkSession, docs: DataFrame, length: int = 2048, grain: int = 8, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    return assign(cut(docs, length, tokenizer, end_id, with_ids), length, grain).withColumn("length", F.col("length").cast("long"))
