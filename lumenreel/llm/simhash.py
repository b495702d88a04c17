"""SimHash near-duplicates with pigeonring filtering.

Fingerprints have 64 bits, by majority over the XXH64 of word shingles. They are cut into a ring of four segments of 16
bits. Two fingerprints that differ in at most three bits have a place in the ring from which every chain of consecutive
segments stays within its share of the budget: no difference in the first segment, at most one in the first two, two in
the first three, three in all. So each different fingerprint is dealt, for each of the four places, by the first two
segments as they are and with one zero bit of the second raised: pairs that pass the chain of two meet in a bucket. There
the chain of three is checked where buckets are large, and the full distance always, by bit counts.

Equal fingerprints meet before this, in an aggregation, so a group of copies is one fingerprint. Inside a bucket only
the links of a spanning forest leave the task, never all pairs. A bucket has different fingerprints with 32 bits in
common; a large one is cut further by the other two segments, of which one differs in one bit at most.

Null and empty texts, and texts without words, have fingerprint zero and are linked like any other. Null doc_ids take
part and never name a component, unless all of its are null. Repeated rows repeat in the result. Very long texts are
whole; their shingles are hashed in parts. Extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import blocks, discard, materialise, ship, utf8

SEED = 42
SHINGLE = 3
PLAIN_RUN = 12  # up to so many fingerprints, a bucket's pairs are compared by shifts
LARGE_RUN = 8192
TILE = 16_384  # fingerprints that 256 others are compared with at once


def fingerprint(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit fingerprints of UTF-8 texts."""
    import xxhash

    digest, parts, counts = xxhash.xxh64_digest, [], np.zeros(len(texts), dtype=np.int64)
    sums = np.zeros((len(texts), 64), dtype=np.int64)

    def add(rows: list[int]) -> None:
        """Adds the bits of the gathered hashes to their documents."""
        sizes = [len(p) for p in parts]
        bits = np.unpackbits(np.frombuffer(b"".join(h for p in parts for h in p), dtype=np.uint8).reshape(-1, 8), axis=1)
        np.add.at(sums, rows, np.add.reduceat(bits, np.cumsum([0, *sizes[:-1]]), axis=0, dtype=np.int32))
        parts.clear()

    rows, waiting = [], 0
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        norm = b" ".join(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        k = min(shingle, len(words))
        n = len(words) - k + 1
        starts = ((ends - sizes)[:n]).tolist()
        stops = ends[k - 1 :].tolist()
        counts[i] = n
        for at in range(0, n, 1 << 17):  # a long text in parts
            parts.append([digest(norm[s:e], SEED) for s, e in zip(starts[at : at + (1 << 17)], stops[at : at + (1 << 17)], strict=True)])
            rows.append(i)
            waiting += len(parts[-1])
            if waiting >= 1 << 17:
                add(rows)
                rows, waiting = [], 0
    if rows:
        add(rows)
    return np.packbits(sums * 2 > counts[:, None], axis=1).view(">i8")[:, 0].astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and a hash of the text, thash, of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in blocks(batches, 2 << 20):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fp": fingerprint(utf8(b.column(1)), shingle), "thash": b.column(2)})

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("thash")).mapInArrow(run, "doc_id long, fp long, thash long")


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the chains of two segments from each place of the ring, and the fingerprint of each key."""
    u = fps.view(np.uint64)
    keys, owners = [], []
    for place in range(4):
        turned = (u << np.uint64(16 * place) | u >> np.uint64((64 - 16 * place) % 64)) if place else u
        chain = turned >> np.uint64(32)
        name = np.uint64(place << 32)
        keys.append(chain | name)
        owners.append(fps)
        for bit in range(16):
            zero = (chain >> np.uint64(bit)) & np.uint64(1) == 0
            keys.append(chain[zero] | np.uint64(1 << bit) | name)
            owners.append(fps[zero])
    return np.concatenate(keys).astype(np.int64), np.concatenate(owners)


def forest(fps: np.ndarray, most: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what distances up to most connect, fewer than there are fingerprints."""
    rest, out = fps, []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            parent = np.full(len(rest), -1)
            for at in range(0, len(front), 256):
                open_ = np.flatnonzero(parent < 0)
                for some in range(0, len(open_), TILE):
                    left = open_[some : some + TILE]
                    near = np.bitwise_count((front[at : at + 256, None] ^ rest[None, left]).view(np.uint64)) <= most
                    hit = near.any(axis=0)
                    parent[left[hit]] = near[:, hit].argmax(axis=0) + at
            found = parent >= 0
            out.append((front[parent[found]], rest[found]))
            front, rest = rest[found], rest[~found]
    return out


def _large(fps: np.ndarray, place: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """As forest() for the pairs of a bucket of this place, cut by its third or fourth segment with one bit free."""
    u, out = fps.view(np.uint64), []
    for seg in (2, 3):
        part = (u >> np.uint64((48 - 16 * (place + seg)) % 64)) & np.uint64(0xFFFF)
        keys, owner = [part], [fps]
        for bit in range(16):
            zero = (part >> np.uint64(bit)) & np.uint64(1) == 0
            keys.append(part[zero] | np.uint64(1 << bit))
            owner.append(fps[zero])
        k, f = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(k, kind="stable")
        k, f = k[order], f[order]
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        for group in np.split(f, cuts):
            out += forest(group, most)
    return out


def link(keys: np.ndarray, fps: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of keys, which are sorted."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    plain = np.repeat((sizes > 1) & (sizes <= PLAIN_RUN), sizes)
    k, f = keys[plain], fps[plain]
    for shift in range(1, PLAIN_RUN):
        if len(k) <= shift:
            break
        x, y = f[:-shift], f[shift:]
        near = (k[:-shift] == k[shift:]) & (np.bitwise_count((x ^ y).view(np.uint64)) <= most) & (x != y)
        a.append(x[near])
        b.append(y[near])
    for i in np.flatnonzero(sizes > PLAIN_RUN):
        group = fps[starts[i] : starts[i] + sizes[i]]
        links = forest(group, most) if sizes[i] <= LARGE_RUN else _large(group, int(keys[starts[i]] >> 32), most)
        a += [x for x, _ in links]
        b += [y for _, y in links]
    return np.concatenate(a), np.concatenate(b)


def near_links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Links a, b between different fingerprints (column fp) that connect all that differ in most bits at most, 3 or fewer."""
    if most > 3:
        raise ValueError("the ring of four segments holds for at most 3 bits")
    ship(distinct.sparkSession)

    def deal(batches):
        for b in batches:
            for at in range(0, b.num_rows, 50_000):
                keys, fps = bucket_keys(b.column(0).slice(at, 50_000).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_pydict({"key": keys, "fp": fps})

    def meet(batches):
        done = lambda x, y: pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)})
        waiting: list = []
        for b in batches:
            k, f = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(k):
                continue
            waiting.append((k, f))
            if k[0] == k[-1] and len(waiting) > 1 and waiting[0][0][0] == k[0]:
                continue  # still in the bucket that began before
            keys, fps = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            cut = int(np.searchsorted(keys, keys[-1]))
            yield done(*link(keys[:cut], fps[:cut], most))
            waiting = [(keys[cut:], fps[cut:])]
        if waiting:
            keys, fps = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            yield done(*link(keys, fps, most))

    dealt = distinct.select("fp").mapInArrow(deal, "key long, fp long")
    return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(meet, "a long, b long")


def _rooted(distinct: DataFrame, most: int) -> DataFrame:
    """Adds to the rows of distinct, one for each fingerprint fp, the root of its component."""
    roots = components(near_links(distinct, most))
    rooted = materialise(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root")), "rooted")
    discard(roots)
    return rooted


def near_duplicates(spark: SparkSession, docs: DataFrame, most: int = 3, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    own = materialise(fingerprints(docs, shingle, id_col, text_col).select("doc_id", "fp"), "fingerprints")
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    rooted = _rooted(distinct, most)
    discard(distinct)
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(names, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(spark: SparkSession, docs: DataFrame, most: int = 3, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with all their columns, one of each component.

    The row with the smallest doc_id stays (a null one counts as the largest), of those the one with the smallest hash
    of its text, and of rows equal in both any one. So different texts that share a doc_id stay, and copies without
    doc_id go. Rows equal in doc_id and text meet in an aggregation, before they are held against the components.
    """
    own = fingerprints(docs, shingle, id_col, text_col)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash"))
    distinct = materialise(own.groupBy("fp").agg(least.alias("first")), "distinct")
    rooted = _rooted(distinct, most)
    discard(distinct)
    winners = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.thash")
    key = lambda id_, h: [F.xxhash64(id_, h).alias("k1"), F.xxhash64(h, F.lit("second"), id_).alias("k2")]
    thash = F.xxhash64(F.col(text_col).cast("string"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *key(F.col(id_col).cast("long"), thash))
    rows = keyed.groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return rows.join(winners.select(*key(F.col("doc_id"), F.col("thash"))), ["k1", "k2"], "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])
