"""Toxicity by a factorization machine over hashed terms.

Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased. A word and its first 4 to 9 bytes (which
stand for a stem under its inflections) are hashed to 64 bits; a term is such a hash with one of the levels "at least
once", "twice" and "three times" in the text, in a table of ``TABLE`` places that every term shares: none is dropped. A
text is the set of its terms' places. The machine scores a set by a bias, a weight for each term and the inner product of
the factors of each pair (scaled by the set's size), so a pair such as an insult and the mention of a group counts beyond
the sum of its terms.

It learns from a bounded sample of labelled documents (``PER_CLASS`` expected of each label and ``MOST_BYTES`` of terms,
by a hash of doc_id). A term's weight begins as its significance: the log ratio of how often either label has it, over its
standard error, less ``LEAST_SIGN``. A learned document sees the significance that the others give, without its own count,
so that terms of one document do not teach what they cannot repeat. Weights and factors then take adaptive gradient steps
on batches; the settings were chosen by cross-validation on learning folds alone.

Scoring reads whole texts and nothing else. Null and empty texts have the bias alone. A document with a null doc_id is
scored and never learned from; of several labels of a document the largest counts, and null labels do not. Without
both labels every score is near 0. Rows that repeat score alike. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import fold, runs_of, share, span_hashes
from .shared import blocks, discard, materialise, ship, utf8

PER_CLASS = 4000
MOST_BYTES = 200 << 20
TABLE = 1 << 18
RANK = 4
SPREAD = 4.0  # of a set's terms in the factors' sums, over the root of their number
LEAST_SIGN = 2.0
PRIOR = 2.0  # documents that a term is taken to have beside its own, by the labels' shares
EPOCHS, BATCH = 12, 64
PREFIXES = range(4, 10)

_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TERM = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])
_LEVELS = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F], dtype=np.uint64)


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and of their beginnings, and the text of each."""
    buf = np.frombuffer(b" ".join(texts).translate(_LOW), dtype=np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    starts, ends = runs_of(_TERM[buf])
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    spans, owners = [(starts, ends)], [owner]
    for n in PREFIXES:
        long = ends - starts >= n
        spans.append((starts[long], starts[long] + n))
        owners.append(owner[long])
    found = span_hashes(buf, *spans)
    found[0] = found[0] ^ np.uint64(0xD1342543DE82EF95)  # a whole word is not the beginning of another
    return np.concatenate(found), np.concatenate(owners)


def leveled(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and their texts: each hash of a text once for every level its count reaches."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(h)))
    h, owner = h[first], owner[first]
    return np.concatenate([h[n > k] ^ _LEVELS[k] for k in range(3)]), np.concatenate([owner[n > k] for k in range(3)])


def places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The table's places of the terms of all texts, each once for a text, and the text of each."""
    h, owner = leveled(*hashes(texts))
    key = np.unique(owner * TABLE + (h & np.uint64(TABLE - 1)).astype(np.int64))
    return key % TABLE, key // TABLE


@dataclass
class Machine:
    weight: np.ndarray  # of each place of the table
    factor: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        at, owner = places(texts)
        n = len(texts)
        spread = _spread(np.bincount(owner, minlength=n))
        cross = np.zeros(n)
        for f in range(self.factor.shape[1]):
            v = self.factor[at, f]
            cross += np.bincount(owner, v, minlength=n) ** 2 - np.bincount(owner, v * v, minlength=n)
        return _sigmoid(self.bias + np.bincount(owner, self.weight[at], minlength=n) + spread**2 * cross / 2)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _spread(n: np.ndarray) -> np.ndarray:
    return SPREAD / np.sqrt(np.maximum(n, 1))


def significance(bad: np.ndarray, n: np.ndarray, all_bad: np.ndarray | float, all_fine: np.ndarray | float) -> np.ndarray:
    """How surely a term that bad of its n documents have with label 1 leans to a label, beyond LEAST_SIGN; 0 below."""
    share = all_bad / (all_bad + all_fine)
    p, q = bad + PRIOR * share, n - bad + PRIOR * (1 - share)
    z = np.log((p / all_bad) / (q / all_fine)) / np.sqrt(1 / p + 1 / q)
    return np.sign(z) * np.maximum(np.abs(z) - LEAST_SIGN, 0)


def fit(sets: list[np.ndarray], labels: np.ndarray, size: int = TABLE, begin: float = 0.5, rate: float = 0.1, pace: float = 0.1, decay: float = 1e-3, shrink: float = 2.0) -> Machine:
    """Learns from sets of places below size and labels 0 or 1, both of which occur."""
    rng = np.random.default_rng(0)
    lengths = np.array([len(s) for s in sets])
    every = np.concatenate(sets).astype(np.int32)
    starts = np.cumsum(lengths) - lengths
    all_bad, all_fine = float(labels.sum()), float((1 - labels).sum())
    n, bad = np.zeros(size), np.zeros(size)
    for first in range(0, len(sets), BATCH):
        part = np.concatenate(sets[first : first + BATCH])
        n += np.bincount(part, minlength=size)
        bad += np.bincount(part, np.repeat(labels[first : first + BATCH], lengths[first : first + BATCH]), minlength=size)
    # A document's own count is left out: what one with label 0 and one with label 1 sees of each term.
    others = [significance(np.maximum(bad - y, 0), np.maximum(n - 1, np.maximum(bad - y, 0)), max(all_bad - y, 1), max(all_fine - (1 - y), 1)) for y in (0, 1)]
    w, v = np.full(size, begin), rng.normal(0, 0.01, (RANK, size))
    bias = float(np.log(all_bad / all_fine))
    wn, vn, bn = np.ones(size), np.full((RANK, size), 0.1), 1.0
    for _ in range(EPOCHS):
        order = rng.permutation(len(sets))
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            size_of = lengths[rows]
            index = np.repeat(starts[rows] - (np.cumsum(size_of) - size_of), size_of) + np.arange(size_of.sum())
            at, of = every[index], np.repeat(np.arange(len(rows)), size_of)
            x = np.where(labels[rows][of] > 0, others[1][at], others[0][at])
            spread = _spread(size_of)
            factors = v[:, at]
            sums = np.stack([np.bincount(of, f, minlength=len(rows)) for f in factors])
            cross = (sums**2).sum(axis=0) - np.bincount(of, (factors**2).sum(axis=0), minlength=len(rows))
            g = _sigmoid(bias + np.bincount(of, w[at] * x, minlength=len(rows)) + spread**2 * cross / 2) - labels[rows]
            step = np.bincount(at, g[of] * x, minlength=size) + decay * (w - begin)
            wn += step * step
            w -= rate * step / np.sqrt(wn)
            pull = (g * spread**2)[of]
            for f in range(RANK):
                step = np.bincount(at, pull * (sums[f][of] - factors[f]), minlength=size) + shrink * v[f]
                vn[f] += step * step
                v[f] -= pace * step / np.sqrt(vn[f])
            bn += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(bn)
    return Machine(w * significance(bad, n, all_bad, all_fine), np.ascontiguousarray(v.T), bias)


def learn(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, per_class: int = PER_CLASS) -> Machine:
    """Fits a machine on labelled documents outside the held fold of doc_id; labels: doc_id, toxic."""
    ship(docs.sparkSession)
    usable = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), parts) != held)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    usable = materialise(usable, "labels")
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, min(1.0, per_class / sizes.get(1, 1))).otherwise(min(1.0, per_class / sizes.get(0, 1)))
    drawn = usable.where(share(F.col("doc_id"), "toxicity") < rate)  # about per_class rows of each label

    def sets(batches):
        for b in blocks(batches, 2 << 20):
            at, owner = places(utf8(b.column(0)))
            cuts = np.searchsorted(owner, np.arange(b.num_rows + 1))
            at = at.astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([at[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["doc_id", "toxic", "terms"])

    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id_"), F.col("text").cast("string").alias("text_"))
    joined = own.join(F.broadcast(drawn), F.col("id_") == F.col("doc_id")).select("text_", "id_", F.col("toxic").cast("int").alias("toxic"))
    sample = materialise(joined.select(F.col("text_").alias("text"), F.col("id_").alias("doc_id"), "toxic").mapInArrow(sets, "doc_id long, toxic int, terms binary"), "sample")
    discard(usable)
    size = sample.agg(F.sum(F.octet_length("terms"))).first()[0] or 0
    rows = sample.where(share(F.col("doc_id"), "terms") < MOST_BYTES / max(size, 1)).collect()
    discard(sample)
    rows.sort(key=lambda r: (r["doc_id"], r["terms"]))
    labels_ = np.array([r["toxic"] for r in rows], dtype=np.float64)
    if not labels_.any() or labels_.all():
        return Machine(np.zeros(TABLE), np.zeros((TABLE, RANK)), -30.0)
    return fit([np.frombuffer(r["terms"], "<i4") for r in rows], labels_)


def score(spark: SparkSession, docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every document."""
    ship(spark)
    sent = spark.sparkContext.broadcast(machine)  # bounded by the terms of the sample

    def run(batches):
        for b in blocks(batches, 2 << 20):
            p = sent.value.scores(utf8(b.column(1)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": p, "predicted": (p >= threshold).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def toxic_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    out = score(spark, docs, learn(docs, labels, parts, held), threshold)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "score", "predicted")
