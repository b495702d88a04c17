"""MinHash near-duplicates with sequential Bayesian verification.

A document's set has its different shingles, each as a 64-bit hash. Equal sets meet first, by a 128-bit digest, so a
group of copies is one node whatever its size. A signature has ``BANDS`` x ``ROWS`` minima, 16 bits of each. Nodes that
agree in a whole band are candidates; two sets of similarity 0.85 agree in none of the bands once in 5e7 pairs. Candidates
are compared in batches of ``BATCH`` minima: after each, a pair goes if the posterior probability that it is similar
enough (uniform prior, so a beta distribution) is below ``MISS``. Survivors are confirmed on the full sets.

No bucket gives all its pairs. A task orders a bucket's survivors by their agreement and sends a spanning forest, whose
pairs are confirmed by a join with the sets; in most buckets all hold, and all that is similar there is connected. The
nodes of the other buckets meet again with their full sets: the task goes through the survivors, passes over those that
links already connect, confirms the rest, and sends the links that joined something, fewer than the bucket has nodes.

A bucket of more than ``MOST`` nodes (or ``MOST_HASHES`` hashes in their sets) is first dealt into tiles by a hash of the
node, which connects groups of near copies. Where several groups remain, its nodes meet again under pairs of bands (two similar sets that agree in one band
and no other are as rare as a miss: once in 2e6 pairs), and a place of more than ``MOST`` there is compared tile by tile.
Buckets of one group are done. So no task holds more than two tiles, and nothing is left out for its size.

Every join is a merge join by hint: all tables grow with the documents, and a broadcast passes through the driver. By
the size of its files Spark takes the nodes for small, whose bands, 24 rows of each, are not.

Texts without words and null texts have an empty set, are linked with nothing and name themselves. Null doc_ids take part
and never name a component unless all of its are null, whose rows then are kept. Repeated rows repeat in the result. Very
long texts are whole. Extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .hashing import mix, span_hashes
from .shared import blocks, discard, give_back, materialise, ship, utf8

WORDS = 5
LEAST = 85  # similarity in hundredths
BANDS, ROWS, BATCH = 24, 4, 16
MISS = 1e-6
MOST = 1024
MOST_HASHES = 4 << 20
BITS = 64 << 20  # bytes of a bucket's sets as rows of bits

_ODD = np.random.default_rng(20_13).integers(1 << 62, 1 << 63, BANDS * ROWS + 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The different shingles of a text as sorted hashes; with fewer words, the whole sequence as one."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    (word,) = span_hashes(np.frombuffer(b" ".join(parts), np.uint8), (ends - sizes, ends))
    k = min(words, len(word))
    h = np.zeros(len(word) - k + 1, np.uint64)
    for i in range(k):
        h += mix(word[i : i + len(h)] + _ODD[-1 - i]) * _ODD[-1 - words - i]
    return np.unique(mix(h + np.uint64(k)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS x ROWS 16-bit minima for each set, none of which is empty."""
    h = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    turned = np.empty_like(h)
    for i in range(BANDS * ROWS):
        np.multiply(h, _ODD[i], out=turned)
        out[:, i] = np.minimum.reduceat(turned, starts)
    return (mix(out) & np.uint64(0xFFFF)).astype("<u2")


@functools.cache
def least_matches(least: int = LEAST, miss: float = MISS) -> list[int]:
    """Of the first 1, 2, ... batches, how many minima must agree so that the posterior of being similar is not below miss."""
    out, t = [], least / 100
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss and m < n:  # P(similarity >= t | m of n) with a uniform prior is a binomial sum
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.astype("<u8").tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key (a hash of id and text), n (set size), digest and signature of every row; the last two are null for empty sets."""
    ship(docs.sparkSession)
    shape = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])

    def run(batches):
        for b in blocks(batches, 2 << 20):
            sets = [shingles(t, words) for t in utf8(b.column(1))]
            some = [i for i, s in enumerate(sets) if len(s)]
            signed, digests = [None] * len(sets), [None] * len(sets)
            if some:
                for i, row in zip(some, signatures([sets[i] for i in some]), strict=True):
                    signed[i], digests[i] = row.tobytes(), _digest(sets[i])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signed, pa.binary())], schema=shape)

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, row_key long, n long, digest binary, signature binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(id_.alias("id"), text.alias("text"), F.xxhash64(id_, F.lit("row"), text).alias("row_key"))


def full_sets(docs: DataFrame, nodes: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node and its set's hashes for nodes (node, digest, row_key): the rows of these keys are read again."""
    ship(docs.sparkSession)

    def run(batches):
        for b in blocks(batches, 2 << 20):
            sets = [shingles(t, words) for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_pydict({"digest": pa.array([_digest(s) for s in sets], pa.binary()), "hashes": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    rows = _keyed(docs, id_col, text_col).join(nodes.select("row_key").hint("merge"), "row_key", "left_semi").select("text").mapInArrow(run, "digest binary, hashes array<long>")
    return rows.join(nodes.select("digest", "node").hint("merge"), "digest").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _survivors(sig: np.ndarray, n: np.ndarray, root: np.ndarray, bands: list[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a bucket's members that may be similar enough, and how many minima agree.

    bands: the pair's first agreeing bands must be these, so that of all buckets one has it; none: any pair.
    """
    i, j = np.triu_indices(len(n), 1)
    may = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]))
    i, j = i[may], j[may]
    if bands and len(i):
        whole = sig.view("<u8")
        upto = bands[-1] + 1
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            same = whole[i[part], :upto] == whole[j[part], :upto]
            may = same[:, bands].all(axis=1) & (same.sum(axis=1) == len(bands))
            i[part] = np.where(may, i[part], -1)
        i, j = i[i >= 0], j[i >= 0]
    count = np.zeros(len(i), np.int64)
    for at, need in zip(range(0, BANDS * ROWS, BATCH), least_matches(least), strict=True):
        for some in range(0, len(i), 1 << 16):
            part = slice(some, some + (1 << 16))
            count[part] += (sig[i[part], at : at + BATCH] == sig[j[part], at : at + BATCH]).sum(axis=1)
        left = count >= need
        i, j, count = i[left], j[left], count[left]
    return i, j, count


def _forest(n: int, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], holds=None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of a spanning forest by agreement; holds(i, j) says of many pairs which are links, all if it is None."""
    i, j, count = pairs
    label, order = np.arange(n), np.lexsort((pairs[1], pairs[0], -count))
    taken: list[int] = []
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        part = part[label[i[part]] != label[j[part]]]
        if holds is not None and len(part):
            part = part[holds(i[part], j[part])]
        for p in part.tolist():
            x, y = label[i[p]], label[j[p]]
            if x != y:
                label[label == x] = y
                taken.append(p)
    return i[taken], j[taken]


def _similar(sets: list[np.ndarray], least: int):
    """A function of places i and j: which pairs of the sets are similar enough, exactly."""
    words, of = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), n)
    wide = -(-len(words) // 64)
    linked = lambda both, i, j: 100 * both >= least * (n[i] + n[j] - both)
    if len(sets) * wide * 8 > BITS:  # few sets, very long ones
        cuts = np.append(0, np.cumsum(n))
        own = [of[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        return lambda i, j: linked(np.array([n[x] + n[y] - len(np.union1d(own[x], own[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True)]), i, j)
    bits = np.zeros((len(sets), wide), np.uint64)
    np.bitwise_or.at(bits, (row, of >> 6), np.uint64(1) << (of & 63).astype(np.uint64))

    def holds(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        both, step = np.empty(len(i), np.int64), max(1, (1 << 20) // wide)
        for at in range(0, len(i), step):
            both[at : at + step] = np.bitwise_count(bits[i[at : at + step]] & bits[j[at : at + step]]).sum(axis=1, dtype=np.int64)
        return linked(both, i, j)

    return holds


def _send(members: DataFrame, least: int, exact: bool) -> DataFrame:
    """key, a and b of the pairs that buckets send; members: key, bands, node, root, n, signature, and hashes if exact.

    Without the sets a bucket sends a forest of survivors, with them links alone, which connect all that is similar.
    """

    def bucket(own: pa.Table) -> pa.RecordBatch | None:
        own = own.sort_by("node")
        node, root, n = (own.column(c).to_numpy() for c in ("node", "root", "n"))
        sig = np.frombuffer(b"".join(own.column("signature").to_pylist()), "<u2").reshape(len(node), -1)
        pairs = _survivors(sig, n, root, own.column("bands")[0].as_py(), least)
        if not len(pairs[0]):
            return None
        holds = _similar([own.column("hashes")[i].values.to_numpy().view(np.uint64) for i in range(len(node))], least) if exact else None
        i, j = _forest(len(node), pairs, holds)
        return pa.RecordBatch.from_pydict({"key": np.full(len(i), own.column("key")[0].as_py()), "a": node[i], "b": node[j]}) if len(i) else None

    def run(batches):
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            held = table if held is None else pa.concat_tables([held, table])
            keys = held.column("key").to_numpy()
            if keys[0] == keys[-1]:
                continue  # still in one bucket
            edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            held = held.combine_chunks()
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if e - s > 1 and (out := bucket(held.slice(s, e - s))) is not None:
                    yield out
            held = held.slice(int(edges[-1]))
        if held is not None and held.num_rows > 1 and (out := bucket(held)) is not None:
            yield out
        give_back()

    columns = ["key", "bands", "node", "root", "n", "signature"] + ["hashes"] * exact
    return members.select(*columns).repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """a, b and linked (100 x intersection >= least x union) of the pairs, from the nodes' full sets."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"of_{name}"))
    met = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").withColumn("both", F.size(F.array_intersect("of_a", "of_b")))
    return met.select("a", "b", (F.lit(100) * F.col("both") >= F.lit(least) * (F.size("of_a") + F.size("of_b") - F.col("both"))).alias("linked"))


def _links(members: DataFrame, sets: DataFrame, least: int) -> list[DataFrame]:
    """Stored tables of links (a, b) that connect what similar pairs of the buckets connect. members is stored."""
    sent = materialise(_send(members, least, False), "sent")
    judged = materialise(confirm(sent.select("a", "b").distinct(), sets, least), "judged")
    found = [materialise(judged.where("linked").select("a", "b"), "links")]
    open_ = materialise(sent.join(judged.where("NOT linked").hint("merge"), ["a", "b"]).select("key").distinct(), "open")
    if not open_.isEmpty():
        whole = members.join(open_.hint("merge"), "key", "left_semi").join(sets.hint("merge"), "node")
        found.append(materialise(_send(whole, least, True).select("a", "b").distinct(), "links"))
    for table in (sent, judged, open_):
        discard(table)
    return found


def _union(tables: list[DataFrame], spark: SparkSession) -> DataFrame:
    none = spark.createDataFrame([], "a long, b long")
    return functools.reduce(lambda x, y: x.unionByName(y), tables, none)


def similar_links(spark: SparkSession, docs: DataFrame, nodes: DataFrame, least: int = LEAST, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> list[DataFrame]:
    """Stored tables of links (a, b) between nodes (a stored table: node, digest, row_key, n, signature)."""
    band = F.posexplode(F.array(*[F.substring("signature", 1 + 2 * ROWS * i, 2 * ROWS) for i in range(BANDS)])).alias("band", "minima")
    keys = nodes.select("node", "n", band).select("node", "n", "band", F.xxhash64("band", "minima").alias("key"))
    tiles = F.ceil(F.greatest(F.col("size") / MOST, F.col("hashes") / MOST_HASHES)).cast("int").alias("tiles")
    sizes_of = lambda rows, *more: rows.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("hashes"), *more)
    shared = sizes_of(keys).where("size > 1").select("key", tiles)
    met = materialise(keys.join(shared.hint("merge"), "key").drop("n"), "buckets")
    involved = met.select("node").distinct().join(nodes.hint("merge"), "node")
    signed = nodes.select("node", F.col("node").alias("root"), "n", "signature")
    tile = F.pmod(F.xxhash64("node", F.lit("tile")), F.col("tiles"))
    large = F.col("tiles") > 1
    dealt = met.select("node", F.when(large, F.xxhash64("key", tile)).otherwise(F.col("key")).alias("key"), F.when(large, F.array().cast("array<int>")).otherwise(F.array("band")).alias("bands"))
    members = materialise(dealt.join(signed.hint("merge"), "node"), "members")
    sets = materialise(full_sets(docs, involved, words, id_col, text_col), "sets")
    found = _links(members, sets, least)
    discard(members)
    hot = met.where(large).select("node", "band", "key")
    if not hot.isEmpty():
        roots = components(_union(found, spark))
        rooted = nodes.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", "signature")
        many = hot.join(roots.hint("merge"), "node", "left").groupBy("key").agg(F.min(F.coalesce("root", "node")).alias("low"), F.max(F.coalesce("root", "node")).alias("high")).where("low < high").select("key")
        again = hot.withColumnRenamed("band", "first").join(many.hint("merge"), "key", "left_semi").join(nodes.select("node", "n", band).hint("merge"), "node").where("band > first")
        twice = materialise(again.select("node", "n", F.array("first", "band").alias("bands"), F.xxhash64("key", "band", "minima").alias("key")), "twice")
        root = F.coalesce("root", "node")
        ends = [F.min(root).alias("low"), F.max(root).alias("high")]
        sizes = sizes_of(twice.join(roots.hint("merge"), "node", "left"), *ends).where("low < high").select("key", tiles)
        own = F.pmod(F.xxhash64("node", F.lit("tile")), F.col("tiles")).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
        placed = twice.join(sizes.hint("merge"), "key").select("node", "bands", "key", own.alias("tile"), others).where("other <> tile OR other = 0")
        # With one tile, tile 0 meets itself; else each two tiles meet, which holds the pairs inside either.
        cell = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
        blocks_ = placed.select("node", "bands", F.when(F.col("tile") == F.col("other"), F.xxhash64("key", F.lit("whole"))).otherwise(cell).alias("key"))
        members = materialise(blocks_.join(rooted.hint("merge"), "node"), "members")
        found += _links(members, sets, least)
        for table in (members, roots, twice):
            discard(table)
    for table in (met, sets):
        discard(table)
    return found


def near_duplicates(spark: SparkSession, docs: DataFrame, least: int = LEAST, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    own = materialise(sketches(docs, words, id_col, text_col), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    grouped = own.where("digest IS NOT NULL").groupBy("digest").agg(first, F.first("n").alias("n"), F.first("signature").alias("signature"))
    nodes = materialise(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", "first.doc_id", "first.row_key", "n", "signature"), "nodes")
    found = similar_links(spark, docs, nodes, least, words, id_col, text_col)
    roots = components(_union(found, spark))
    rooted = nodes.join(roots.hint("merge"), "node", "left").select("digest", "doc_id", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialise(rooted.join(names.hint("merge"), "root").select(F.col("digest").alias("of"), "component_id"), "named")
    for table in (*found, roots, nodes):
        discard(table)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = own.join(named.hint("merge"), F.col("digest") == F.col("of"), "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
