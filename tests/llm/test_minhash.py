"""MinHash near-duplicates against all pairs of full sets, and the posterior bound against its definition."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenreel.llm import minhash as M

SCHEMA = "doc_id long, text string, root string, node long, key string, n int, a string"


def plain(rows):
    """Components by all pairs of sets of strings."""
    sets = []
    for _, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    groups = {}
    for i, (id_, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(id_)
    name = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    out = []
    for i, (id_, _) in enumerate(rows):
        component = name[find(i)] if sets[i] else id_
        out.append((id_, len(sets[i]), component, id_ == component))
    return sorted(out, key=repr)


def held(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()], key=repr)


def corpus(groups=60, seed=11, large=0):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq") + rng.choice("rstuvw")
    texts = []

    def edited(words, edits):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = word()
        return " ".join(words)

    passage = [word() for _ in range(60)]
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 6, 20, 60, 150, 400]))]
        if g % 4 == 0:
            base += passage  # shared by many, far from enough for a link
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            texts.append(edited(base, rng.choice([0, 0, 1, 1, 2, 3, 5])))
    base = [word() for _ in range(220)]
    texts += [edited(base, rng.choice([1, 2, 3, 4, 6])) for _ in range(large)]  # chains of near copies around the border
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "ONE"), (5005, "É é"), (5006, "é é"), (5007, "a " * 4000), (5008, "A " * 3000), (None, texts[0]), (None, "no id at all here, none"), (None, "no id at all here, none"), (7, texts[9]), (7, texts[7]), (None, "")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 1, "clash") for r in rows], SCHEMA).repartition(3)


def test_equals_all_pairs(spark):
    rows = corpus()
    assert held(M.near_duplicates(spark, frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize(("most", "hashes"), [(1024, 4 << 20), (40, 4 << 20), (6, 4 << 20), (1024, 900)])
def test_large_groups(spark, monkeypatch, most, hashes):
    """Groups of near copies whose similarities lie about the border, in tiles and under two bands."""
    monkeypatch.setattr(M, "MOST", most)
    monkeypatch.setattr(M, "MOST_HASHES", hashes)
    rows = corpus(25, 5, 160)
    assert held(M.near_duplicates(spark, frame(spark, rows))) == plain(rows)


def test_empty_table(spark):
    assert M.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_texts(spark):
    text = " ".join(f"w{i * 7919 % 1000}x{i % 977}" for i in range(200_000))
    rows = [(1, text), (2, text + " more"), (3, text.replace("w1x", "q")), (4, text[: len(text) // 2])]
    got = held(M.near_duplicates(spark, frame(spark, rows)))
    assert got == plain(rows) and got[0][1] > 190_000


def test_posterior_bound():
    """A pair goes where less than MISS of the beta posterior lies above the threshold, by numeric integration."""
    x = (np.arange(400_000) + 0.5) / 400_000
    for batch, need in enumerate(M.least_matches()):
        n = M.BATCH * (batch + 1)

        def above(m, n=n):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            w = np.exp(log - log.max())
            return w[x >= 0.85].sum() / w.sum()

        assert above(need) >= M.MISS * 0.99 and (need == 0 or above(need - 1) < M.MISS * 1.01)


def test_bands_miss_no_border_pair():
    """Pairs of similarity 0.85 agree in a band, and their agreement estimates the similarity."""
    rng = np.random.default_rng(4)
    missed, agreed = 0, []
    for _ in range(400):
        h = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = np.sort(h[:370]), np.sort(h[30:])  # 340 of 400
        sig = M.signatures([a, b])
        agreed.append((sig[0] == sig[1]).mean())
        missed += not (sig.view("<u8")[0] == sig.view("<u8")[1]).any()
    assert missed == 0 and abs(np.mean(agreed) - 0.85) < 0.01


def test_a_bucket_sends_no_more_than_a_forest_first():
    rng = np.random.default_rng(6)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.append(h, rng.integers(0, 1 << 63, 5, dtype=np.uint64))) for _ in range(200)]
    sig = M.signatures(sets)
    n = np.array([len(s) for s in sets])
    pairs = M._survivors(sig, n, np.arange(200), [], 85)
    assert len(pairs[0]) == 200 * 199 // 2
    assert len(M._forest(200, pairs)[0]) == 199


@pytest.mark.parametrize("bits", [64 << 20, 1000])
def test_pairs_of_a_bucket_are_confirmed_exactly(monkeypatch, bits):
    monkeypatch.setattr(M, "BITS", bits)
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 90)).astype(np.uint64)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    want = [100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert M._similar(sets, 60)(i, j).tolist() == want and 0 < sum(want) < len(want)


def test_rows_without_links_keep_their_columns(spark):
    df = M.near_duplicates(spark, frame(spark, [(1, "a b c d e f"), (2, "q r s t u v")]))
    assert df.where(F.col("kept")).count() == 2 and dict(df.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}


def test_no_join_of_documents_is_broadcast(spark, monkeypatch):
    """Tables that Spark takes for small pass through no driver: at the default threshold, no join of the plans that are written is a broadcast."""
    plans, write = [], M.materialise

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(M, "materialise", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        docs = spark.createDataFrame([(i, " ".join(f"w{i % 20}x{j}" for j in range(40)) + (" y" * (i // 20))) for i in range(60)], "doc_id long, text string")
        out = M.near_duplicates(spark, docs)
        plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
        assert out.count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {"buckets", "members", "sets", "judged", "open", "named", "result"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan] == []
