"""Substring deduplication by super-k-mers.

A window is ``width`` consecutive words of one document. A word goes if a window that covers it also starts in a
document with a smaller doc_id; windows are judged on the input. Words are runs of anything but ASCII white space.

Each window has a minimiser, the smallest hash among its runs of ``M`` words; hashes of runs with few letters count as
large, so that common function words seldom become minimisers. Consecutive windows that share the minimiser travel as
one packed string (a super-k-mer) to its bucket, and equal windows always meet there. A task sends its super-k-mers to
one destination, which holds many buckets, as one compressed value. There, buckets that one document fills alone are
passed over; else windows are compared as whole strings and sorted by document, so counts are exact and hashes only say
who meets.

Hot passages: within a batch a super-k-mer that a smaller document has word for word is decided on the spot and only
the first travels, so a passage in a third of all documents reaches its bucket about once a batch. A destination over
``OVERFLOW`` bytes is not gathered either: its windows leave one by one and are compared by an aggregation.

Null and empty texts have no words and stay; so do texts under width words. A null doc_id counts as the largest.
Repeated rows (equal doc_id and text) are the same document and are treated alike; rows that share a doc_id do not
remove each other's words, and neither do rows without one. Very long texts are whole. Extra columns are ignored, or kept
with ``keep_text``, but for one named n_removed, which is made anew; an empty table gives no rows.

A destination is meant to hold ``SHARE`` bytes of packed strings: their number follows from the size of the input that
Spark's statistics give, and a wrong estimate costs time only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import mix, runs_of, span_hashes
from .shared import blocks, give_back, materialise, ship, stored_bytes, utf8

WIDTH = 13
M = 3
FEW_BYTES = 12
OVERFLOW = 96 << 20
SHARE = 48 << 20
PACKED = 4  # bytes of packed strings for a byte of the stored table, about
MOST_SHARED = 100_000  # repeated doc_ids that are sent to every task
LAST = (1 << 63) - 1

FLUSH = 8 << 20  # bytes of text after which a task sends what it has packed
_FLOW = "dest int, sure boolean, raw long, blob binary"
_FLAGS = "ord long, variant long, pos int, n int, `window` binary"
_PLANES = (("key", "<u4"), ("ord", "<i8"), ("variant", "<i8"), ("pos", "<i4"), ("n", "<i4"))


def _word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes where single spaces or newlines lie between words."""
    return runs_of((buf != 32) & (buf != 10))


def super_kmers(texts: list[bytes], width: int = WIDTH) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed strings of all texts, with the text, the first window's position, the number of windows and the key of each."""
    norms = [b" ".join(t.split()) for t in texts]
    joined = b"\n".join(norms)
    none = np.empty(0, np.int64)
    if not joined:
        return [], none, none, none, none
    buf = np.frombuffer(joined, dtype=np.uint8)
    starts, ends = _word_bounds(buf)
    (word,) = span_hashes(buf, (starts, ends))
    text_at = np.cumsum([0] + [len(x) + 1 for x in norms[:-1]])
    first_word = np.searchsorted(starts, text_at)
    counts = np.diff(np.append(first_word, len(starts)))
    owner = np.repeat(np.arange(len(texts)), counts)
    if len(word) < width:
        return [], none, none, none, none
    n = len(word) - M + 1
    run = word[:n].copy()
    for k in range(1, M):
        run = run * np.uint64(0x100000001B3) + word[k : n + k]
    run = mix(run) >> np.uint64(1)
    run |= ((ends[M - 1 :] - starts[:n]) < FEW_BYTES).astype(np.uint64) << np.uint64(63)
    span, least = 1, run
    want = width - M + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: len(run) - want + 1], least[want - span : len(run) - span + 1])
    valid = np.flatnonzero(owner[: len(least)] == owner[width - 1 :])
    if not len(valid):
        return [], none, none, none, none
    key = least[valid]
    new = np.append(True, (key[1:] != key[:-1]) | (valid[1:] != valid[:-1] + 1) | (owner[valid[1:]] != owner[valid[:-1]]))
    at = np.flatnonzero(new)
    first, n_windows = valid[at], np.diff(np.append(at, len(valid)))
    packed = [joined[s:e] for s, e in zip(starts[first].tolist(), ends[first + n_windows + width - 2].tolist(), strict=True)]
    return packed, owner[first], first - first_word[owner[first]], n_windows, key[at].view(np.int64)


def _blob(planes: dict[str, np.ndarray], packed: list[bytes]) -> tuple[int, bytes]:
    """Super-k-mers as one compressed value: their numbers by columns (documents as steps), then their strings."""
    columns = [(np.diff(planes[k], prepend=0) if k == "ord" else planes[k]).astype(t).tobytes() for k, t in _PLANES]
    raw = b"".join([len(planes["pos"]).to_bytes(8, "little"), *columns, b"\n".join(packed)])
    return len(raw), pa.Codec("zstd").compress(raw, asbytes=True)


def _unblob(size: int, blob: bytes) -> tuple[dict[str, np.ndarray], list[bytes]]:
    raw = pa.Codec("zstd").decompress(blob, size, asbytes=True)
    n, at, planes = int.from_bytes(raw[:8], "little"), 8, {}
    for k, t in _PLANES:
        planes[k] = np.frombuffer(raw, t, n, at)
        at += planes[k].nbytes
    planes["ord"] = np.cumsum(planes["ord"])
    return planes, raw[at:].split(b"\n") if len(raw) > at else []


def _deal(batches, width: int, dests: int):
    """Packs the super-k-mers of a task by destination. Those that a smaller document of the batch has need no trip."""
    held: list[tuple[dict[str, np.ndarray], np.ndarray, list[bytes]]] = []
    size = 0

    def flush():
        planes = {k: np.concatenate([h[0][k] for h in held]) for k, _ in _PLANES}
        packed = [p for h in held for p in h[2]]
        dest = np.concatenate([h[1] for h in held])
        out = {"dest": [], "sure": [], "raw": [], "blob": []}
        order = np.argsort(dest, kind="stable")
        cuts = np.flatnonzero(np.append(True, dest[order][1:] != dest[order][:-1])) if len(order) else []
        for rows in np.split(order, cuts[1:]) if len(order) else []:
            to = int(dest[rows[0]])
            raw, blob = _blob({k: v[rows] for k, v in planes.items()}, [packed[i] for i in rows.tolist()] if to < dests else [])
            for k, v in (("dest", to if to < dests else int(planes["ord"][rows[0]] % dests)), ("sure", to >= dests), ("raw", raw), ("blob", blob)):
                out[k].append(v)
        return pa.RecordBatch.from_pydict({"dest": pa.array(out["dest"], pa.int32()), "sure": pa.array(out["sure"], pa.bool_()), "raw": pa.array(out["raw"], pa.int64()), "blob": pa.array(out["blob"], pa.binary())})

    for b in blocks(batches, 2 << 20):
        ord_ = b.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(ord_, kind="stable")
        texts = utf8(b.column(2).take(pa.array(order)))
        ord_, variant = ord_[order], b.column(1).to_numpy(zero_copy_only=False)[order]
        packed, owner, pos, n, key = super_kmers(texts, width)
        seen: dict[bytes, int] = {}
        decided = np.fromiter((seen.setdefault(p, d) < d for p, d in zip(packed, ord_[owner].tolist(), strict=True)), dtype=bool, count=len(packed))
        u = key.view(np.uint64)
        dest = np.where(decided, dests, (u % np.uint64(dests)).astype(np.int64))
        held.append(({"key": (u // np.uint64(dests)).astype(np.uint32), "ord": ord_[owner], "variant": variant[owner], "pos": pos, "n": n}, dest, packed))
        size += sum(map(len, texts))
        if size >= FLUSH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _runs(row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges consecutive positions of a row: the row, the first position and how many."""
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1))) if len(row) else np.empty(0, np.int64)
    return row[new], pos[new], np.diff(np.append(new, len(row)))


def _windows(packed: list[bytes], width: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All windows of the packed strings, with the string and the place in it of each."""
    joined = b"\n".join(packed)
    starts, ends = _word_bounds(np.frombuffer(joined, dtype=np.uint8))
    lengths = np.cumsum([0] + [len(p) + 1 for p in packed[:-1]])
    first = np.searchsorted(starts, lengths)
    words = np.diff(np.append(first, len(starts)))
    n = words - width + 1
    row = np.repeat(np.arange(len(packed)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = first[row] + place
    return pa.array([joined[s:e] for s, e in zip(starts[at].tolist(), ends[at + width - 1].tolist(), strict=True)], pa.binary()), row, place


def _flags(planes: dict[str, np.ndarray], pos: np.ndarray, n: np.ndarray, window=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"ord": planes["ord"], "variant": planes["variant"].astype(np.int64), "pos": pos.astype(np.int32), "n": n.astype(np.int32), "window": pa.nulls(len(pos), pa.binary()) if window is None else window})


def _compare(planes: dict[str, np.ndarray], packed: list[bytes], width: int):
    """Windows of complete buckets that a smaller document has too."""
    order = np.lexsort((planes["ord"], planes["key"]))
    key, ord_ = planes["key"][order], planes["ord"][order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    rows = order[np.repeat(ord_[starts] != ord_[starts + sizes - 1], sizes)]  # buckets that documents share
    for part in _whole_buckets(rows, planes["key"], [len(packed[i]) for i in rows.tolist()]):
        some = {k: v[part] for k, v in planes.items()}
        windows, row, place = _windows([packed[i] for i in part.tolist()], width)
        code = windows.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        doc = some["ord"][row]
        by = np.lexsort((doc, code))
        head = np.append(True, code[by][1:] != code[by][:-1]) if len(by) else np.empty(0, bool)
        least = np.empty(code.max() + 1 if len(code) else 0, dtype=np.int64)
        least[code[by][head]] = doc[by][head]
        hit = doc > least[code]
        r, p, many = _runs(row[hit], place[hit])
        yield _flags({k: v[r] for k, v in some.items()}, some["pos"][r] + p, many)


def _whole_buckets(rows: np.ndarray, key: np.ndarray, sizes: list[int], most: int = 2 << 20):
    """Cuts rows, sorted by key, into parts of about most bytes that hold whole buckets."""
    if not len(rows):
        return
    step = np.cumsum(sizes) // most
    change = np.flatnonzero(key[rows][1:] != key[rows][:-1]) + 1
    cuts = change[np.append(True, step[change][1:] != step[change][:-1])] if len(change) else change
    yield from np.split(rows, cuts)


def _singly(planes: dict[str, np.ndarray], packed: list[bytes], width: int):
    for at in range(0, len(packed), 20_000):
        part = slice(at, at + 20_000)
        windows, row, place = _windows(packed[part], width)
        some = {k: v[part][row] for k, v in planes.items()}
        yield _flags(some, some["pos"] + place, np.ones(len(row), dtype=np.int32), windows)


def _meet(batches, width: int, overflow: int):
    """Blobs arrive sorted by destination; one destination is in memory at a time, if it is not too large."""
    here, size, large = None, 0, False
    waiting: list[tuple[dict[str, np.ndarray], list[bytes]]] = []

    def settle():
        if waiting:
            yield from _compare({k: np.concatenate([w[0][k] for w in waiting]) for k, _ in _PLANES}, [p for w in waiting for p in w[1]], width)

    for batch in batches:
        for dest, sure, raw, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            planes, packed = _unblob(raw, blob)
            if sure:
                yield _flags(planes, planes["pos"], planes["n"])
                continue
            if dest != here:
                yield from settle()
                here, size, large, waiting = dest, 0, False, []
            size += raw
            if large or size > overflow:
                for w in [*waiting, (planes, packed)]:
                    yield from _singly(*w, width)
                waiting, large = [], True
            else:
                waiting.append((planes, packed))
    yield from settle()
    give_back()


def repeated_windows(docs: DataFrame, width: int = WIDTH, overflow: int = OVERFLOW) -> DataFrame:
    """ord, variant and the runs (pos, n) of windows to remove; docs: ord, variant, text."""
    if width < M + 1:
        raise ValueError(f"a window needs more than {M} words")
    dests = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(stored_bytes(docs) * PACKED // SHARE, 1 << 30))
    dealt = docs.select("ord", "variant", "text").mapInArrow(lambda it: _deal(it, width, dests), _FLOW)
    met = dealt.repartition("dest").sortWithinPartitions("dest").mapInArrow(lambda it: _meet(it, width, overflow), _FLAGS)
    flags = materialise(met, "windows")
    sure, single = flags.where("`window` IS NULL").drop("window"), flags.where("`window` IS NOT NULL")
    if single.isEmpty():
        return sure
    least = single.groupBy("window").agg(F.min("ord").alias("least"))
    return sure.unionByName(single.join(least, "window").where("ord > least").select("ord", "variant", "pos", "n"))


def _with_variants(docs: DataFrame, id_col: str, text: F.Column) -> DataFrame:
    """Adds ord, and variant: 0, but where texts share a doc_id or have none a hash of the text, which tells them apart."""
    ids = docs.select(F.col(id_col).cast("long").alias("ord")).where("ord IS NOT NULL")
    shared = materialise(ids.groupBy("ord").count().where("count > 1").select(F.col("ord").alias("s_ord")), "shared")
    keyed = docs.withColumn("ord", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)))
    thash = F.xxhash64(text)
    alone = F.when(F.col(id_col).isNull(), thash).otherwise(F.lit(0))
    if shared.isEmpty():
        return keyed.withColumn("variant", alone)
    if shared.limit(MOST_SHARED + 1).count() <= MOST_SHARED:
        shared = F.broadcast(shared)
    return keyed.join(shared, F.col("ord") == F.col("s_ord"), "left").withColumn("variant", F.when(F.col("s_ord").isNotNull(), thash).otherwise(alone)).drop("s_ord")


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = WIDTH, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text", overflow: int = OVERFLOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    keep_text puts the kept words (joined by a space) into text instead, and keeps all columns of docs.
    """
    ship(spark)
    columns = [c for c in docs.columns if c.lower() != "n_removed"]
    whole = docs.select(F.struct(*columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = _with_variants(whole, "doc_id", F.col("text"))
    runs = repeated_windows(keyed, width, overflow)
    own = runs.groupBy("ord", "variant").agg(F.collect_set(F.struct("pos", "n")).alias("run"))  # of one document; its repeated rows have the same
    marks = own.select("ord", "variant", F.col("run.pos").alias("pos"), F.col("run.n").alias("n"))
    rest = ["row"] if keep_text else ["doc_id", "text"]
    joined = keyed.select("ord", "variant", *rest).join(marks, ["ord", "variant"], "left")

    def kept(t: bytes, pos: list | None, n: list | None) -> tuple[int, int, bytes]:
        words = t.split()
        if not pos:
            return len(words), 0, b" ".join(words)
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, pos, 1)
        np.add.at(edge, np.add(pos, n) + width - 1, -1)
        stay = np.cumsum(edge[:-1]) == 0
        left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
        return len(words), len(words) - len(left), b" ".join(left)

    def digest(batches):
        for b in blocks(batches):
            out = [kept(t, p, n) for t, p, n in zip(utf8(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_words": pa.array([x[0] for x in out], pa.int64()), "n_removed": pa.array([x[1] for x in out], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())})

    def rewrite(batches):
        for b in blocks(batches):
            texts = b.column(0).to_pylist()
            out = [None if t is None else kept(t.encode(), p, n)[1:] for t, p, n in zip(texts, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            # A text that loses nothing stays as it was, white space and all.
            new = [t if x is None or not x[0] else x[1].decode() for t, x in zip(texts, out, strict=True)]
            yield pa.RecordBatch.from_pydict({"text": pa.array(new, pa.string()), "n_removed": pa.array([0 if x is None else x[0] for x in out], pa.int64()), "row": b.column(3)})

    if not keep_text:
        return joined.select("doc_id", "text", "pos", "n").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    flat = joined.select(F.col("row")[text_col].cast("string").alias("text"), "pos", "n", F.col("row").dropFields(text_col).alias("row"))
    row = flat.schema["row"].dataType.simpleString()
    done = flat.mapInArrow(rewrite, f"text string, n_removed long, row {row}")
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns], "n_removed")


#: The same result from all windows as strings.
ORACLE_SQL = """
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS ord, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
x AS (SELECT r, ord, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT r, ord, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT win, min(ord) AS least FROM x GROUP BY 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM x JOIN m USING (win) WHERE ord > least),
t AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT t.r, string_agg(word, ' ' ORDER BY t.p) AS kept, count(*) AS n FROM t ANTI JOIN g ON g.r = t.r AND g.p = t.p GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)
"""
