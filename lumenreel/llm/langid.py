"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, anything but letters becomes a space, and runs of 2 and 3 characters are hashed to ``DIM``
buckets. A feature is the bucket's share of the text's n-grams times its inverse document frequency, which is counted
over all documents that may be learned from. Weights are learned with follow-the-regularised-leader (per-coordinate
rates, L1 and L2 penalties) on a bounded sample, ``PER_LANG`` expected documents of each language by a hash of doc_id;
a fifth of the sample is held back to fit one temperature, which calibrates the scores. Every value of
lang is learned; the sample has ``MOST_ROWS`` rows at most, so with very many values each has fewer.

Prediction reads whole texts and nothing else. A text that is null or has no letter is ``und`` with score 0, and so is
every text if there is nothing to learn from. Equal scores go to the first language in order. Documents with a null
doc_id or lang are not learned from. Rows that repeat are predicted alike. Very long texts are whole. Extra columns are
kept by ``predict``, but for columns named lang_pred or score, which it makes anew. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import fold, share
from .shared import blocks, discard, materialise, ship

DIM = 1 << 16
PER_LANG = 600
MOST_ROWS = 150_000  # of the whole sample; with over 250 languages each has fewer than PER_LANG
EPOCHS = 3
GRAMS = (2, 3)
NONE = "und"

_letters: np.ndarray | None = None


def _code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, other than letters as spaces, each text followed by two; and the offset of each."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    low = [("" if t is None else t.lower()) + "  " for t in texts]
    at = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in low], out=at[1:])
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(_letters[cp], cp, np.uint32(32)).astype(np.uint32), at


def _grams(cp: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that start at each code point; the last two have shorter ones."""
    h = cp * np.uint32(0x9E3779B1)
    out = []
    for n in range(2, max(GRAMS) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + cp[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F)
            out.append(np.concatenate([(mixed >> np.uint32(16)), np.zeros(n - 1, np.uint32)]).astype(np.uint16))
    return out


def counts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and how many n-grams of each, by text."""
    cp, at = _code_points(texts)
    grams = _grams(cp)
    out = []
    for s, e in zip(at[:-1].tolist(), (at[1:] - 2).tolist(), strict=True):
        n = np.bincount(np.concatenate([g[s:e] for g in grams]), minlength=0)
        idx = np.flatnonzero(n)
        out.append((idx, n[idx]))
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # DIM x languages: weight times inverse document frequency
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: none) and its probability, for each text."""
        cp, at = _code_points(texts)
        some = np.add.reduceat(cp != 32, at[:-1]) > 0 if len(texts) else np.empty(0, bool)
        if not self.langs or not some.any():
            return np.full(len(texts), -1), np.zeros(len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        for g in _grams(cp):
            for k in range(len(self.langs)):  # the two pads of a text hold n-grams of the next: taken off
                line = self.table[:, k][g]
                line[at[1:] - 1] = 0
                line[at[1:] - 2] = 0
                total[:, k] += np.add.reduceat(line, at[:-1], dtype=np.float64)
        logits = (total / np.maximum(len(GRAMS) * (np.diff(at) - 2), 1)[:, None] + self.bias) / self.temperature
        p = _softmax(logits)
        best = logits.argmax(axis=1)
        return np.where(some, best, -1), np.where(some, p[np.arange(len(p)), best], 0.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray, float]], df: np.ndarray, n_docs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, scale: float = 100.0) -> Model:
    """Learns from (lang, buckets, counts, a number in [0, 1)) rows; those below 0.2 fit the temperature alone."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    data = [(langs.index(lang), idx, cnt / max(cnt.sum(), 1) * idf[idx] * scale, u) for lang, idx, cnt, u in rows]
    train, held = [d for d in data if d[3] >= 0.2] or data, [d for d in data if d[3] < 0.2]
    z, n = np.zeros((DIM + 1, len(langs))), np.zeros((DIM + 1, len(langs)))  # the last row is the bias

    def weights(zi: np.ndarray, ni: np.ndarray, penalty: float) -> np.ndarray:
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(train)):
            k, idx, x, _u = train[i]
            zi, ni = z[idx], n[idx]
            w, b = weights(zi, ni, l1), weights(z[DIM], n[DIM], 0.0)
            g = _softmax(x @ w + b)
            g[k] -= 1
            grad = x[:, None] * g
            z[idx] = zi + grad - (np.sqrt(ni + grad**2) - np.sqrt(ni)) / alpha * w
            n[idx] = ni + grad**2
            z[DIM] += g - (np.sqrt(n[DIM] + g**2) - np.sqrt(n[DIM])) / alpha * b
            n[DIM] += g**2
    w, b = weights(z[:DIM], n[:DIM], l1), weights(z[DIM], n[DIM], 0.0)
    logits = np.array([x @ w[idx] + b for _, idx, x, _ in held]).reshape(-1, len(langs))
    gold = np.array([k for k, *_ in held], dtype=np.int64)
    steps = np.geomspace(0.25, 8, 61)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(gold)), gold], 1e-12)).mean() for t in steps] if len(gold) else [0]
    return Model(langs, (w * idf[:, None] * scale).astype(np.float32), b, float(steps[int(np.argmin(loss))]) if len(gold) else 1.0)


def learn(docs: DataFrame, per_lang: int = PER_LANG, where: Column | None = None) -> Model:
    """Fits a model on the documents (doc_id, text, lang) that where holds for."""
    ship(docs.sparkSession)
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang", F.coalesce(where, F.lit(False)).alias("use") if where is not None else F.lit(True).alias("use")).where("use")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    per_lang = min(per_lang, MOST_ROWS / max(len(sizes), 1))
    rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_lang / n))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    picked = usable.select("text", "lang", (share(F.col("doc_id"), "langid") < F.coalesce(rates[F.col("lang")], F.lit(0.0))).alias("drawn"), share(F.col("doc_id"), "held").alias("u"))

    def count(batches):
        df, n = np.zeros(DIM, dtype=np.int64), 0
        for b in blocks(batches, 2 << 20):
            drawn, langs, us = b.column(2).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            out = []
            for i, (idx, cnt) in enumerate(counts(b.column(0).to_pylist())):
                df[idx] += 1
                n += 1
                if drawn[i]:
                    out.append({"bucket": -2, "n": 0, "lang": langs[i], "u": us[i], "idx": idx.astype("<u2").tobytes(), "cnt": cnt.astype("<u4").tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=shape)
        some = np.flatnonzero(df)
        none = lambda k: pa.nulls(len(some) + 1, k)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], n), pa.int64()), none(pa.string()), none(pa.float64()), none(pa.binary()), none(pa.binary())], schema=shape)

    shape = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("lang", pa.string()), ("u", pa.float64()), ("idx", pa.binary()), ("cnt", pa.binary())])
    counted = materialise(picked.mapInArrow(count, "bucket int, n long, lang string, u double, idx binary, cnt binary"), "langid")
    df, n_docs = np.zeros(DIM), 0
    for r in counted.where("bucket >= -1").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # DIM + 1 rows at most
        if r["bucket"] < 0:
            n_docs = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    sample = counted.where("bucket = -2").select("lang", "idx", "cnt", "u").collect()  # about per_lang rows for each language
    discard(counted)
    rows = [(r["lang"], np.frombuffer(r["idx"], "<u2").astype(np.int64), np.frombuffer(r["cnt"], "<u4"), r["u"]) for r in sample]
    return fit(sorted(rows, key=lambda r: (r[3], r[0], len(r[1]))), df, n_docs)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to docs, in place of columns of these names."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM numbers for each language

    def run(batches):
        m = sent.value
        for b in blocks(batches, 2 << 20):
            best, p = m.scores(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([NONE if k < 0 else m.langs[k] for k in best.tolist()], pa.string()), pa.array(p, pa.float64())], ["row", "lang_pred", "score"])

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    packed = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*kept).alias("row"))
    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "lang_pred", "score")


def identify(spark: SparkSession, docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from the folds of doc_id other than the held one."""
    model = learn(docs, where=fold(F.col("doc_id"), parts) != held)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
