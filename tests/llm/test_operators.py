"""Each operator against brute force, an exact round trip, planted cases or held-out labels, and on awkward tables."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from lumenreel.llm import binary_output, components, langid, media, mixing, packing, queries, search, shared, simhash, substrings, tokens, toxicity, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long, sha string"
RNG = random.Random(5)
WORDS = [a + b for a in ("ba", "ko", "ti", "ru") for b in ("na", "le", "so", "mi", "du")]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


PASSAGE = prose(40)
TEXTS = [
    None, "", " \t\n", "one", "Two words", "a " * 3000, prose(200), prose(60) + "\n" + PASSAGE, PASSAGE + " " + prose(30), "x " + PASSAGE, PASSAGE, PASSAGE, PASSAGE.upper(), prose(13), "É" * 5000, "<|endoftext|> a<|startoftext|>b's it's. (c)'d ... 12,5",
    "\x1c\x85 odd space é ﬁ", "𝔘nicode 日本語 text", prose(2500), prose(500),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], ["s1", "s2", None][i % 3], None, "clash") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id " + PASSAGE, None, None, 1, ""), (3, "one", "en", "s1", 3, ""), (3, "another text of three", "en", "s1", 3, "")]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def split(text):
    return (text or "").encode().split()


# Tokens


def test_encoder_equals_plain_encoding():
    enc = tokens.encoder(tokens.default_tokenizer())
    texts = [t or "" for t in TEXTS] + ["don't'LL x.'s 'S.a,b;c-d_e(f)g", "A.B.C...D", "à.b́", "İstanbul ΣΑΣ straße", "<|x|> 5th 2nd,3"]
    ids, at = enc.encode([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_encode_plainly():
    import public_tokenizers

    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not enc.cuts and tokens.encoder(tokens.default_tokenizer()).cuts
    texts = ["Upper lower UPPER", "", "a  b\n c", "É x"]
    ids, at = enc.encode([t.encode() for t in texts])
    assert [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_forgets_safely(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    enc = tokens.Encoder(tokens.default_tokenizer())
    texts = [prose(30).encode() + str(i).encode() for i in range(20)] + [b"quite other words " + bytes([97 + i]) for i in range(20)]
    for part in (texts[:10], texts[10:30], texts[:10]):
        ids, at = enc.encode(part)
        assert [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)] == [enc.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in part]


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    out = binary_output.token_output(spark, docs).collect()
    enc = tokens.encoder(tokens.default_tokenizer()).tokenizer
    want = collections.Counter()
    for i, t in rows_of(docs):
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    by_start = sorted(out, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0] + [r.n_tokens for r in by_start[:-1]]).tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in by_start]
    assert order == sorted(order)
    assert binary_output.token_output(spark, empty).count() == 0


def test_shards_are_read_by_ranges(spark, docs, monkeypatch, tmp_path):
    import pyarrow.fs as pafs

    manifest = binary_output.write_token_files(docs, str(tmp_path / "t")).collect()
    read = lambda row, most, n: [(names[i], ids[int(at[i] - at[0]) : int(at[i + 1] - at[0])].tolist(), int(at[i])) for ids, at, names in binary_output.documents_of(row.path, row.width, most, n) for i in range(len(names))]
    for row in manifest:
        whole = read(row, binary_output.READ, 20_000)
        assert len(whole) == row.n_docs and sum(len(w[1]) for w in whole) == row.n_tokens
        assert read(row, 7, 20_000) == read(row, 500, 3) == whole
        with monkeypatch.context() as m:
            m.setattr(binary_output, "file_system", lambda uri: (pafs.SubTreeFileSystem("/", pafs.LocalFileSystem()), uri))
            assert read(row, 7, 2) == whole


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts beyond the size at which batches are cut."""
    one = prose(5000)
    return spark.createDataFrame([(1, (one + " ") * 360), (2, one), (3, (one + "\n") * 100), (None, one * 100)], "doc_id long, text string").coalesce(1)


def test_very_long_texts(spark, long_docs):
    rows = rows_of(long_docs)
    assert max(len(t) for _, t in rows) > 8 << 20
    enc = tokens.encoder(tokens.default_tokenizer()).tokenizer
    want = {i: np.array([*enc.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in binary_output.token_output(spark, long_docs).collect()} == {(i, len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}
    pieces = packing.pack(spark, long_docs).collect()
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in want} == {i: len(x) for i, x in want.items()}
    assert {(r.doc_id, r.n_bytes) for r in media.media_columns(spark, long_docs).select("doc_id", "n_bytes").collect()} == {(i, len(t)) for i, t in rows}
    import xxhash

    for r in simhash.near_duplicates(spark, long_docs).collect():
        words = dict(rows)[r.doc_id].encode().split()
        seen = collections.Counter(b" ".join(words[i : i + 3]) for i in range(len(words) - 2))
        bits = np.zeros(64, np.int64)
        for shingle, n in seen.items():
            bits += n * (np.uint64(xxhash.xxh64_intdigest(shingle, 42)) >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.int64)
        assert int(r.fingerprint, 16) == sum(1 << k for k in range(64) if bits[k] * 2 > len(words) - 2)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark, long_docs).collect()}
    assert got == {r[0]: r[2] for r in plain_repeats(rows)}
    assert {r.query_id for r in search.search(spark, long_docs, long_docs.withColumnRenamed("doc_id", "query_id"), 2).collect()} == {1, 2, 3}


# Packing


def test_packing(spark, docs, empty):
    out = packing.pack(spark, docs, with_ids=True).collect()
    enc = tokens.encoder(tokens.default_tokenizer()).tokenizer
    want = collections.Counter()
    for i, t in rows_of(docs):
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((i, s, np.array(ids[s : s + 2048], "<u4").tobytes(), len(ids)) for s in range(0, len(ids), 2048))
    assert collections.Counter((r.doc_id, r.start, bytes(r.ids), r.doc_tokens) for r in out) == want
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length == len(r.ids) // 4 for r in out)
    seqs = collections.defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for pieces in seqs.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces[:-1]]).tolist() and sum(n for _, n in pieces) <= 2048
    assert len(seqs) <= -(-sum(r.length for r in out) // 2048) + 2
    assert packing.pack(spark, empty).count() == 0


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(2)
    for n, most in ((40, 256), (20_000, 256), (5000, 100)):
        sizes = np.clip(rng.lognormal(3.5, 1, n).astype(int), 1, most)
        counts = dict(zip(*[x.tolist() for x in np.unique(sizes, return_counts=True)], strict=True))
        found = packing.patterns(counts, 256)
        held = collections.Counter()
        for p, times in found:
            assert sum(s * m for s, m in p.items()) <= 256
            for s, m in p.items():
                held[s] += m * times
        assert held == counts
        assert sum(t for _, t in found) <= math.ceil(sizes.sum() / 256 * 1.01) + 1
    assert packing.patterns({}, 256) == []


# Media


def test_g711_tables():
    assert media.ULAW_TABLE[[0xFF, 0x7F, 0x80, 0x00]].tolist() == [0, 0, 32124, -32124]
    assert media.ALAW_TABLE[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]


def plain_adpcm(block):
    at, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [at]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            d = step >> 3
            for bit, part in ((1, step >> 2), (2, step >> 1), (4, step)):
                d += part if code & bit else 0
            at = max(-32768, min(32767, at - d if code & 8 else at + d))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(at)
    return out


def test_adpcm_blocks_decode_as_one_by_one():
    data = bytes(RNG.randrange(256) for _ in range(3 * (media.FRAME + 4)))
    size = media.FRAME + 4
    assert media.decode_adpcm(data).tolist() == [x for k in range(3) for x in plain_adpcm(data[k * size : (k + 1) * size])]


@pytest.mark.parametrize("codec", [None, media.ULAW, media.ALAW, media.ADPCM])
def test_media_round_trip(spark, docs, codec, tmp_path):
    table = media.store(docs, str(tmp_path / "m"), codec)
    got = {(r.doc_id, r.payload_sha256): r for r in media.load(table, keep_pcm=True).collect()}
    for i, t in rows_of(docs):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[i, hashlib.sha256(payload).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        tag, rate, data = media.parse_wav(bytes(r.pcm))
        assert (tag, rate) == (1, 16000) and len(data) >= 2 * len(payload)


def test_resampling():
    assert media.resample(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]
    assert media.resample(np.array([0, 10, 20, 30], np.int16), 8000, 4000).tolist() == [0, 20]


# Mixing


def test_mixing_equals_plain_windows(spark, docs, duck):
    con = duck.cursor()
    own = docs.withColumns({c: F.lit("x") for c in ("copies", "wanted", "size", "boost", "u", "target")})
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    same(mixing.mix(own, boost=mixing.by_length).withColumn("wanted", F.round("wanted", 9)), con.sql(mixing.ORACLE_SQL))


@pytest.mark.parametrize("most", [mixing.MOST_ROWS, 0])
def test_mixing_large_sources_and_boost(most, spark, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BINS", 8)
    monkeypatch.setattr(mixing, "MOST_ROWS", most)
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int") + 1).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), (F.col("id") % 5 / 2.0).alias("quality"))
    for boost in (None, mixing.by_length, lambda size: F.col("quality") + 0.5):
        whole = mixing.mix(rows, boost=boost, extra=("quality",))
        out = whole.groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") / F.col("size")).alias("most"), F.sum(F.col("wanted") * F.col("size")).alias("wanted")).collect()
        assert sum(r.target for r in out) == pytest.approx(1.5 * sum(r.source_size for r in out))
        for r in out:
            assert r.most <= 2 and r.target <= 2 * r.source_size + 1e-6 and r.wanted == pytest.approx(r.target)
            assert abs(r.taken - r.target) <= 40
    odds = {r.quality: r.n for r in whole.where("wanted < 2 AND target < 2 * source_size").groupBy("quality").agg(F.avg("copies").alias("n")).collect()}
    assert odds[0.0] < odds[0.5] < odds[1.0]
    assert mixing.mix(rows, boost=lambda size: F.col("quality"), extra=("quality",)).where("quality = 0").agg(F.sum("copies")).first()[0] == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(rows.limit(5).withColumn("text", F.lit(" "))).agg(F.sum("taken"), F.sum("copies")).first() == (0, 0)


def test_null_ids_draw_by_text(spark):
    rows = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("x"), F.col("id"), F.repeat(F.lit(" w"), (F.col("id") % 40).cast("int"))).alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    out = mixing.mix(rows).where("copies > floor(wanted)").agg(F.min("size"), F.max("size"), F.count("*")).first()
    assert out[0] < 5 and out[1] > 35


# Urls


def test_rules_inline_and_joined(spark):
    rows = ["http://Example.com/en/1", "https://a.example.com/en/70?x#y", "http://example.net/de/81", "http://net/de/", "http://xorg/es/", "http://w.org/es/q", "nothing", None, "http://h", "://org/es/", "http://example.com"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(rows)], "page_id long, url string, html string")
    out = urls.filter_urls(spark, df).orderBy("page_id").collect()
    want = [("example.com", "/en/1", "com/en/", "block"), ("a.example.com", "/en/70", "example.com/en/7", "allow"), ("example.net", "/de/81", "example.net/de/8", "block"), ("net", "/de/", "net/de/", "allow"), ("xorg", "/es/", None, "allow"),
            ("w.org", "/es/q", "org/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"), ("org", "/es/", "org/es/", "block"), ("example.com", "", None, "allow")]
    assert [(r.host, r.path, r.rule, r.verdict) for r in out] == want
    table = spark.createDataFrame(urls.RULES, "action string, host string, path string")
    assert urls.filter_urls(spark, df, table).orderBy("page_id").select("host", "path", "rule", "verdict").collect() == [tuple(w) for w in want]
    assert urls.filter_urls(spark, df.limit(0)).count() == 0
    assert {r.verdict for r in urls.filter_urls(spark, df, []).collect()} == {"allow"}


def test_aliases(spark):
    page = lambda i, u, h=None: (i, u, h)
    link = lambda u: f"<head><LINK data-x rel='canonical' href=\"{u}\"></head>"
    rows = [
        page(1, "http://a.xx/1#f", link("http://b.com/en/9")), page(2, "http://c.xx/", "<meta http-equiv=refresh content='0; url=/next'>"), page(3, "http://c.xx/next", link("//a.xx/1")),
        page(4, "http://a.xx/1"), page(5, "http://d.xx/", link("http://example.com/en/7")), page(6, "http://e.org/es/", link("http://d.xx/")), page(7, "http://f.xx/"), page(8, None, link("http://a.xx/1")),
        page(9, "http://g.xx/p/q", link("r")), page(10, "http://g.xx/p/r"), page(10, "http://g.xx/p/r"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    extra = spark.createDataFrame([("http://g.xx/p/q", "http://w.org/es/")], "a string, b string")
    got = collections.defaultdict(set)
    for r in urls.filter_urls(spark, df, edges=extra).collect():
        got[r.page_id].add(r.verdict)
    # 5 and 6 share a class with an allow rule; 6 itself has a block rule, which stands.
    assert {k: v for k, v in got.items()} == {1: {"block"}, 2: {"block"}, 3: {"block"}, 4: {"block"}, 5: {"allow"}, 6: {"block"}, 7: {"allow"}, 8: {"allow"}, 9: {"block"}, 10: {"block"}}


def test_aliases_equal_sql(spark, duck):
    """Relative links, null ids and urls, chains, all kinds of statements, long html, clashing names, all on one table."""
    link = lambda u: f"<head><link rel=canonical href='{u}'></head>"
    rows = [
        (1, "http://a.com/x", link("/en/z")), (2, "https://a.com/x?utm_source=f&ref=q", "<meta content='http://a.com/x' property='og:url'>"), (3, "http://www.A.com/x#top", "<p>" + "long " * 400_000 + "</p>" + link("y")), (None, "http://m.b.net/q?id=3&ref=x", link("//a.com/x")),
        (None, None, link("/x")), (4, "no scheme", None), (4, "no scheme", None), (5, "https://b.net/q?id=3", "<META http-equiv='refresh' content='1; URL=../de/8'>"), (6, "http://c.example.net/p", link("http://c.example.net/de/7")),
        (7, "http://c.example.net/r", link("http://c.example.net/p")), (8, "http://w.org/es/", link("http://d.com/en/1")), (9, "ftp://f.org/?ref=1", link("http://example.com/en/7")), (10, "http://lone.org/", ""), (11, "http://s.xx/", "<script>top.location='http://w.org/es/'</script>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    clash = df.withColumns({c: F.lit("x") for c in ("host", "path", "node", "key", "rule", "verdict", "action", "root", "a", "b")})
    con = duck.cursor()
    con.register("pages", df.toArrow())
    out = urls.filter_urls(spark, clash)
    same(out, con.sql(urls.ORACLE_SQL))
    got = {r.page_id: r.verdict for r in out.collect()}
    assert (got[1], got[2], got[6], got[7], got[8], got[9], got[10]) == ("block", "block", "allow", "allow", "block", "allow", "allow")


def test_equally_long_rules_decide_alike(spark):
    rules = [("block", "com", "/abcdefghi"), ("block", "example.com", "/a"), ("allow", "le.org", "/ab"), ("block", "org", "/abcde")]
    df = spark.createDataFrame([(1, "http://example.com/abcdefghij"), (2, "http://le.org/abcdef")], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    inline = urls.filter_urls(spark, df, rules).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in inline] == [("example.com/a", "block"), ("le.org/ab", "allow")]
    assert urls.filter_urls(spark, df, spark.createDataFrame(rules, "action string, host string, path string")).orderBy("page_id").collect() == inline


def test_class_decides_in_the_registered_query(spark, tmp_path):
    """A page without a rule of its own is blocked, or allowed, by a rule of what it states as its alias."""
    rows = [
        (1, "http://shop.xx/a", "<link rel='canonical' href='http://shop.com/en/1'>"), (2, "http://shop.xx/b", '<meta property="og:url" content="http://w.org/es/x">'),
        (3, "http://shop.xx/c", "<script>window.location.href = 'http://shop.xx/a'</script>"), (4, "http://shop.xx/d", "<script>location.replace('//shop.xx/c')</script><link rel=canonical href=http://example.com/en/7>"),
        (5, "http://shop.xx/e", "<p>location = 'http://w.org/es/x'</p>"), (6, "http://shop.xx/f", "<meta http-equiv=refresh content='0; url=/b'>"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op1_url_filter(spark, str(tmp_path)).collect()}
    assert got == {1: (None, "allow"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "block")}
    spark.createDataFrame([r for r in rows if r[0] != 4], "page_id long, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in queries.op1_url_filter(spark, str(tmp_path)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 5: "allow", 6: "block"}


def test_many_pages_of_one_url(spark):
    """A third of all pages have one url, whose class decides for all of them."""
    rows = [(i, "http://hot.xx/" if i % 3 == 0 else f"http://h{i}.xx/", "<link rel=canonical href='http://w.org/es/'>" if i < 4 else None) for i in range(6000)]
    out = urls.filter_urls(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert out.where("verdict = 'block'").count() == 2000 + 2 and out.count() == 6000


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Near copies


def plain_fingerprint(text):
    import xxhash

    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def unite(values):
    """Smallest position reachable by links of at most three bits."""
    a = np.array(values, dtype=np.uint64)
    root = list(range(len(a)))
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= 3).tolist():
            x, y = i, j
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
    out = []
    for i in range(len(a)):
        while root[i] != i:
            i = root[i]
        out.append(i)
    return out


def test_simhash(spark, docs, empty):
    base = prose(120).split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 120, 4)]
    more = docs.unionByName(spark.createDataFrame([(100 + i, t, None, None, None, None) for i, t in enumerate(near + near[:5])], DOC))
    rows = sorted(rows_of(more), key=lambda r: (r[0] is None, r[0]))
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = unite(fps)
    want = collections.Counter((i, f"{f:016x}", rows[r][0]) for (i, _), f, r in zip(rows, fps, roots, strict=True))
    got = simhash.near_duplicates(spark, more).collect()
    assert collections.Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(spark, empty).count() == 0


def test_keep_first(spark, docs, empty):
    base = prose(120).split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 120, 9)]
    more = docs.unionByName(spark.createDataFrame([(100 + i, t, None, None, None, None) for i, t in enumerate(near)] + [(None, "lone text", "a", None, None, "")] * 30 + [(7, prose(70), "x", None, None, "")] * 3, DOC))
    more = more.withColumns({c: F.lit(1) for c in ("fp", "k1", "row", "thash", "root")})
    rows = rows_of(more)
    roots = unite([plain_fingerprint(t) for _, t in rows])
    hashes = [r.h for r in spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "i long, t string").select("i", F.xxhash64("t").alias("h")).orderBy("i").collect()]
    best = {}
    for i, root in enumerate(roots):
        rank = (rows[i][0] is None, rows[i][0] or 0, hashes[i])
        if root not in best or rank < best[root][0]:
            best[root] = (rank, rows[i])
    out = simhash.keep_first(spark, more)
    assert out.columns == more.columns
    assert collections.Counter(rows_of(out)) == collections.Counter(r for _, r in best.values())
    assert simhash.keep_first(spark, empty).count() == 0


def test_forest_in_tiles(monkeypatch):
    rng = np.random.default_rng(7)
    fps = np.unique(rng.integers(0, 1 << 11, 700, dtype=np.uint64)).astype(np.int64)
    whole = sorted((int(x), int(y)) for a, b in simhash.forest(fps) for x, y in zip(a, b, strict=True))
    monkeypatch.setattr(simhash, "TILE", 50)
    assert sorted((int(x), int(y)) for a, b in simhash.forest(fps) for x, y in zip(a, b, strict=True)) == whole


def test_links_connect_all_close_fingerprints():
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flips = [seeds] + [seeds ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 30), dtype=np.uint64), axis=0) for n in (1, 2, 3, 3, 4, 6) for _ in range(8)]
    dense = seeds[0] ^ rng.integers(0, 1 << 9, 400, dtype=np.uint64)
    fps = np.unique(np.concatenate([*flips, dense])).astype(np.int64)
    keys, own = simhash.bucket_keys(fps)
    order = np.argsort(keys, kind="stable")
    for large in (simhash.LARGE_RUN, 20):
        simhash.LARGE_RUN, keep = large, simhash.LARGE_RUN
        try:
            a, b = simhash.link(keys[order], own[order])
        finally:
            simhash.LARGE_RUN = keep
        assert (np.bitwise_count((a ^ b).view(np.uint64)) <= 3).all()
        place = {f: i for i, f in enumerate(fps.tolist())}
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(place[x]), find(place[y])
            root[max(p, q)] = min(p, q)
        assert [find(i) for i in range(len(fps))] == unite(fps.view(np.uint64))


# Substrings


def plain_repeats(rows, width=13):
    first = {}
    key = lambda i: math.inf if i is None else i
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, math.inf), key(i))
    out = collections.Counter()
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < key(i):
                gone[k : k + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("overflow", [substrings.OVERFLOW, 1])
def test_substrings(spark, docs, overflow):
    got = collections.Counter(map(tuple, substrings.remove_repeats(spark, docs, overflow=overflow).collect()))
    assert got == plain_repeats(rows_of(docs))


def test_substrings_many(spark, empty):
    parts = [prose(20) for _ in range(6)]
    rows = [(i, " ".join(RNG.choice(parts) if RNG.random() < 0.4 else prose(RNG.randrange(1, 30)) for _ in range(RNG.randrange(1, 8)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collections.Counter(map(tuple, substrings.remove_repeats(spark, df).collect())) == plain_repeats(rows)
    assert collections.Counter(map(tuple, substrings.remove_repeats(spark, df, 5).collect())) == plain_repeats(rows, 5)
    assert substrings.remove_repeats(spark, empty).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(spark, df, 3)


def test_substrings_of_shared_and_missing_ids(spark, monkeypatch):
    """Different texts of one doc_id or of none are kept apart, joined or sent; equal rows are alike."""
    rows = [(None, PASSAGE + f" tail {i}") for i in range(5)] + [(4, PASSAGE), (4, "head " + PASSAGE), (5, PASSAGE), (5, PASSAGE), (6, prose(20)), (None, prose(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (100_000, 0):
        monkeypatch.setattr(substrings, "MOST_SHARED", most)
        assert collections.Counter(map(tuple, substrings.remove_repeats(spark, df).collect())) == plain_repeats(rows)
    clash = df.withColumns({c: F.lit(9) for c in ("N_Removed", "ord", "variant", "pos", "n", "row")})
    out = substrings.remove_repeats(spark, clash, keep_text=True)
    assert sorted(out.columns) == sorted([*(c for c in clash.columns if c != "N_Removed"), "n_removed"]) and {r.ord for r in out.collect()} == {9}


def test_super_kmers_cover_every_window_once():
    texts = [t.encode() for t in (prose(50), prose(12), "", "a " * 100, prose(300))]
    packed, owner, pos, n, key = substrings.super_kmers(texts)
    seen = sorted((int(o), int(p) + k) for o, p, m in zip(owner, pos, n, strict=True) for k in range(m))
    assert seen == [(i, k) for i, t in enumerate(texts) for k in range(max(0, len(t.split()) - 12))]
    for p, o, s, m in zip(packed, owner, pos, n, strict=True):
        assert p.split() == texts[o].split()[s : s + m + 12]


# Search


def plain_terms(text):
    edge = bytes(b for b in range(33, 127) if not chr(b).isalnum())
    return [t for t in (w.strip(edge) for w in (text or "").encode().lower().split()) if t]


def test_terms_equal_plain_splitting():
    texts = [t or "" for t in TEXTS] + ["(a) a's, 'A' -- ... «é» x-y_z", "!", "a" * 300 + " b", "", " ."]
    h, n, at, words = search.terms_of([t.encode() for t in texts])
    bags = [collections.Counter(plain_terms(t)) for t in texts]
    assert words.tolist() == [sum(b.values()) for b in bags]
    names = {}
    for i, bag in enumerate(bags):
        assert sorted(n[at == i].tolist()) == sorted(bag.values())
        for term in bag:
            names.setdefault(term, search.terms_of([term])[0][0])
        assert sorted(h[at == i].tolist()) == sorted(int(names[t]) for t in bag)
    assert len(set(names.values())) == len(names)


def index_of(bags, mean=None):
    """An index of plain bags (name: count) with doc_ids 0, 1, ..., made of two chunks."""
    parts, cut = [], len(bags) // 2
    for first, some in ((0, bags[:cut]), (cut, bags[cut:])):
        names = sorted({t for b in some for t in b})
        at = {t: i for i, t in enumerate(names)}
        parts.append({
            "ids": np.arange(first, first + len(some)), "lengths": np.array([sum(b.values()) for b in some]), "sizes": np.array([len(b) for b in some], np.int32), "names": np.array(names, np.uint64),
            "code": np.array([at[t] for b in some for t in sorted(b)], np.int32), "counts": np.array([b[t] for b in some for t in sorted(b)], np.int32),
        })
    return search.Index(parts, mean or max(np.mean([sum(b.values()) for b in bags]), 1e-9))


def plain_best(bags, terms, idf, mean, k):
    scores = []
    for i, b in enumerate(bags):
        s = sum(w * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t, w in zip(terms, idf, strict=True) if t in b)
        if s > 0:
            scores.append((i, round(s, 9)))
    return sorted(scores, key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize(("window", "fine", "common", "dense"), [(6, 2, 4, 10**6), (16, 8, 50, 10**6), (512, 64, 4, 1500), (4, 4, 1, 0)])
def test_block_max_wand_is_exact(window, fine, common, dense, monkeypatch):
    """Against plain scoring, with and without rare terms, on documents of two vocabularies."""
    for name, value in zip(("WINDOW", "FINE", "COMMON", "DENSE"), (window, fine, common, dense), strict=True):
        monkeypatch.setattr(search, name, value)
    block = window
    rng = np.random.default_rng(block)
    for turn in range(12):
        bags = []
        for _ in range(300):
            base = 100 * int(rng.integers(2))
            words = [base + int(x) for x in rng.zipf(1.3, int(rng.integers(0, 40))) % 90] + ([1000 + int(rng.integers(30))] if rng.random() < 0.2 else [])
            bags.append(dict(collections.Counter(words)))
        bags += [dict(bags[0]) for _ in range(40)]
        mean = max(np.mean([sum(b.values()) for b in bags]), 1e-9)
        index = index_of(bags, mean)
        weight = {t: float(w) for t, w in zip(range(1100), rng.random(1100) * 6 + 0.01, strict=True)}
        for q in [*range(0, 300, 23), 300]:
            terms = np.array(sorted(bags[q]), np.uint64)
            idf = np.array([weight[int(t)] for t in terms])
            code, known = index.codes(terms, idf)
            assert known.all()
            ids, scores = index.search(code, 7)
            want = plain_best(bags, terms.tolist(), idf.tolist(), mean, 7)
            assert list(zip(ids.tolist(), scores.tolist(), strict=True)) == [(i, pytest.approx(s, abs=2e-9)) for i, s in want]
            for need in [s for _, s in want[::3]] + [1e9]:  # what is known to be reached elsewhere
                found = dict(zip(*(x.tolist() for x in index.search(code, 7, need - search.SLACK)), strict=True))
                assert {i for i, s in want if s >= need} <= set(found) <= {i for i, _ in want} and all(s >= need - 2e-9 for s in found.values())


@pytest.mark.parametrize(("window", "fine", "usual", "cells"), [(6, 2, 3, 10**6), (16, 8, 40, 1000), (512, 64, 5, 10**6), (4, 4, 1, 1)])
def test_queries_at_once_get_what_each_gets(window, fine, usual, cells, monkeypatch):
    """Queries with a need, empty ones among them, against plain scoring; blocks that miss the need are passed over."""
    for name, value in zip(("WINDOW", "FINE", "USUAL", "CELLS"), (window, fine, usual, cells), strict=True):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(window)
    bags = []
    for _ in range(400):
        base = 100 * int(rng.integers(3))
        words = [base + int(x) for x in rng.zipf(1.3, int(rng.integers(0, 40))) % 90] + ([1000 + int(rng.integers(30))] if rng.random() < 0.2 else [])
        bags.append(dict(collections.Counter(words)))
    bags += [dict(bags[0]) for _ in range(40)] + [dict(bags[1]) for _ in range(5)]
    mean = max(np.mean([sum(b.values()) for b in bags]), 1e-9)
    weight = rng.random(1100) * 6 + 0.01
    asked = [sorted(bags[q]) for q in range(0, 400, 7)] + [[], [1099]]
    want = [plain_best(bags, terms, weight[terms].tolist(), mean, 7) for terms in asked]
    for place, more in ((0, 1), (3, 1), (6, 1), (0, 1 + 1e-7), (0, 1.01), (0, 1.3), (0, 1e9)):  # what is met a little above all scores, too
        need = np.array([w[place][1] * more - search.SLACK if len(w) > place else 0.0 for w in want])
        index = index_of(bags, mean)
        flat, at = np.array([t for terms in asked for t in terms], np.uint64), np.append(0, np.cumsum([len(t) for t in asked]))
        got = index.answers(flat, weight[flat.astype(int)], at, 7, need)
        for (ids, scores), w, least in zip(got, want, need.tolist(), strict=True):
            assert list(zip(ids.tolist(), scores.tolist(), strict=True)) == [(i, pytest.approx(s, abs=2e-9)) for i, s in w if s >= least]
    assert index.read == 0  # no block reaches the last need


def test_a_task_answers_a_bounded_number_of_queries(spark, monkeypatch):
    """One shard, many queries: they are dealt to several tasks, each query to one of them."""
    monkeypatch.setattr(search, "SLICE", 40)
    monkeypatch.setattr(search, "LEAST_SLICE", 10)
    found, read = [], search._groups
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} all") for i in range(300)], "doc_id long, text string")
    asked = shared.materialise(search.ask(docs.withColumnRenamed("doc_id", "query_id")).groupBy("query_id").agg(F.collect_list("term").alias("terms")).select("query_id", "terms", F.transform("terms", lambda t: F.lit(1.0)).alias("idf"), F.lit(0.0).alias("need")).repartition(30), "asked")
    for part in range(8):
        ids = [int(q) for g in read(asked.stored_at.removeprefix("file://"), part, 8) for q in g[0]]
        assert 0 < len(ids) <= 100
        found += ids
    assert sorted(found) == list(range(300))
    rows = search.search(spark, docs, docs.withColumnRenamed("doc_id", "query_id"), 3).collect()
    monkeypatch.setattr(search, "SHARD", 90)
    monkeypatch.setattr(search, "CHUNK", 30)
    more = search.search(spark, docs, docs.withColumnRenamed("doc_id", "query_id"), 3).collect()
    assert len(rows) == 900 and sorted(map(tuple, rows)) == sorted(map(tuple, more))


def test_lists_behind_the_pivot_are_not_read():
    """A common term cannot bring a document among the best: its list is asked for few documents, at the registered constants."""
    bags = [{1: 5, 2: 1, 3: 1} if i < 40 else {1: 1, 4: 2, 5: 2} for i in range(4000)]
    index = index_of(bags)
    code, _ = index.codes(np.array([1, 2, 3], np.uint64), np.array([0.1, 4.0, 4.0]))
    ids, _ = index.search(code, 5)
    assert ids.tolist() == [0, 1, 2, 3, 4] and index.met == 4080 and index.read < 400


def test_less_than_half_of_the_postings_is_read(spark):
    """At the registered constants, over one shard of whole documents and the queries that search_documents() takes from them."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("doc_id IS NOT NULL").orderBy("doc_id").toPandas()
    texts = [(t or "").encode() for t in rows.text]
    found = [search.terms_of(texts[at : at + 500]) for at in range(0, len(texts), 500)]
    sizes = np.concatenate([np.bincount(at, minlength=len(words)) for _, _, at, words in found])
    names, code, df = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True, return_counts=True)
    lengths = np.concatenate([f[3] for f in found])
    chunk = {"ids": rows.doc_id.to_numpy(), "lengths": lengths, "sizes": sizes.astype(np.int32), "names": names, "code": code.astype(np.int32), "counts": np.concatenate([f[1] for f in found])}
    index = search.Index([chunk], lengths.mean())
    idf, ends = np.log(1 + (len(rows) - df + 0.5) / (df + 0.5)), np.append(0, np.cumsum(sizes))
    for i in np.flatnonzero(rows.doc_id.to_numpy() % 50 == 0):
        terms = code[ends[i] : ends[i + 1]]
        own, known = index.codes(names[terms], idf[terms])
        if known.any():
            index.search(own[known], 10)
    assert index.met > 10**7 and index.read < 0.5 * index.met


def test_search_is_exact(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(search, "CHUNK", 300)
    monkeypatch.setattr(search, "SHARD", 900)
    monkeypatch.setattr(search, "WAVE", 1)
    more = spark.createDataFrame([(200 + i, prose(RNG.randrange(1, 40))) for i in range(150)] + [(300, "rare twin words")], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    rows = [r for r in rows_of(more) if r[0] is not None]
    bags = [collections.Counter(plain_terms(t)) for _, t in rows]
    n, mean = len(rows), sum(sum(b.values()) for b in bags) / len(rows)
    df = collections.Counter(w for b in bags for w in b)
    clash = more.withColumns({c: F.lit("x") for c in ("score", "rank", "term", "path", "query_id")})
    got = collections.defaultdict(list)
    for r in search.search_documents(spark, clash, 25, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, round(r.score, 6)))
    asked = collections.defaultdict(set)
    for (i, _), b in zip(rows, bags, strict=True):
        if i % 25 == 0:
            asked[i] |= set(b)  # rows that share a doc_id ask together
    assert {300, 0} <= set(asked) and set(got) == {i for i, terms in asked.items() if terms}
    for q, found in got.items():
        terms = sorted(asked[q])
        idf = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in terms]
        assert found == [(rows[i][0], round(s, 6)) for i, s in sorted(plain_best(bags, terms, idf, mean, len(rows)), key=lambda x: (-x[1], rows[x[0]][0]))[:7]]
    assert search.search_documents(spark, empty).count() == 0
    assert search.search(spark, more, more.limit(0).withColumnRenamed("doc_id", "query_id")).count() == 0


def test_search_keeps_smaller_ids_among_many_short_copies(monkeypatch):
    """Blocks of higher bounds hold copies too and come first; the bound of the others equals the copies' score."""
    monkeypatch.setattr(search, "WINDOW", 8)
    monkeypatch.setattr(search, "FINE", 4)
    for seed in range(60):
        rng = np.random.default_rng(seed)
        bags = [{0: 2, 9: 6} if i >= 600 and i % 4 == 0 else {0: 1, 1: 1, 2: 1} for i in range(1200)]
        index = index_of(bags, float(np.mean([sum(b.values()) for b in bags])) * (1 + rng.random()))
        code, _ = index.codes(np.array([0, 1, 2], np.uint64), rng.random(3) * 5 + 1)
        assert index.search(code, 5)[0].tolist() == [0, 1, 2, 3, 4], seed


def test_scores_that_round_alike_go_to_the_smaller_id(monkeypatch):
    """Two documents whose scores agree to nine digits, the larger of which comes first in order and in bound."""
    monkeypatch.setattr(search, "WINDOW", 1)
    monkeypatch.setattr(search, "FINE", 1)
    index = index_of([{1: 1}, {2: 1}])
    code, _ = index.codes(np.array([1, 2], np.uint64), np.array([1.0 + 1e-11, 1.0 + 4e-11]))
    assert index.search(code, 1)[0].tolist() == [0]


def plain_media(text):
    """Payload, media file and PCM at 16 kHz of a text, sample by sample."""
    raw = (text or "").encode()
    payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
    kind = zlib.crc32(payload) % 3
    if kind == 2:
        data = b"".join(bytes(4) + payload[k : k + 192] for k in range(0, len(payload), 192))
        pcm = [x for k in range(0, len(data), 196) for x in plain_adpcm(data[k : k + 196])]
        head = struct.pack("<HHIIHH", 17, 1, 8000, 8000 * 196 // 385, 196, 4) + struct.pack("<HH", 2, 385)
    else:
        data, pcm = payload, []
        for byte in payload:
            if kind == 0:
                c = ~byte & 255
                size = ((((c & 15) << 3) + 132) << (c >> 4 & 7)) - 132
                pcm.append(-size if c & 128 else size)
            else:
                c = byte ^ 85
                size = ((c & 15) << 4) + 8 + (256 if c >> 4 & 7 else 0) << max((c >> 4 & 7) - 1, 0)
                pcm.append(size if c & 128 else -size)
        head = struct.pack("<HHIIHH", (7, 6)[kind], 1, 8000, 8000, 1, 8) + struct.pack("<H", 0)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    twice = [x for a, b in zip(pcm, pcm[1:] + pcm[-1:], strict=True) for x in (a, int(np.rint((a + b) / 2)))]
    return payload, b"RIFF" + struct.pack("<I", len(body)) + body, twice


def test_media_columns_equal_plain_decoding(spark, docs, empty):
    own = docs.unionByName(docs.where("doc_id = 6"))
    clash = own.withColumns({c: F.lit("x") for c in ("media", "feature", "n_bytes", "id")})
    got = collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, bytes(r.pcm)) for r in media.media_columns(spark, clash).collect())
    want = collections.Counter()
    for i, t in rows_of(own):
        payload, file, pcm = plain_media(t)
        wide = np.array(pcm, np.float64)
        raw = np.array(pcm, "<i2").tobytes()
        crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))
        rms = float(np.sqrt(np.square(wide.astype(np.float32), dtype=np.float32).mean(dtype=np.float64)))
        feature = f"{('ulaw', 'alaw', 'adpcm')[zlib.crc32(payload) % 3]} 16000 Hz samples={len(pcm)} rms={rms:.2f} peak={max(map(abs, pcm))} crossings={crossings} pcm={zlib.crc32(raw):08x}"
        want[i, len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature, media.wav(1, raw, 16000)] += 1
    assert got == want
    assert media.media_columns(spark, empty).count() == 0


# Models


def test_language_held_out(spark):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = langid.identify(spark, own).join(own, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert out > 0.97


def plain_language(model, text):
    """Scores of a text, n-gram by n-gram."""
    chars = [c if c.isalpha() else " " for c in text.lower()] + [" ", " "]
    total = np.zeros(len(model.langs))
    for i in range(len(chars) - 2):
        h = ord(chars[i]) * 0x9E3779B1 & 0xFFFFFFFF
        for n in (2, 3):
            h = ((h ^ h >> 15) * 0x85EBCA6B + ord(chars[i + n - 1]) * 0xC2B2AE35) & 0xFFFFFFFF
            total += model.table[((h ^ h >> 16) * 0x27D4EB2F & 0xFFFFFFFF) >> 16].astype(np.float64)
    logits = (total / (2 * (len(chars) - 2)) + model.bias) / model.temperature
    e = np.exp(logits - logits.max())
    return e / e.sum()


def test_language_scores_equal_plain_loops():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], rng.normal(0, 5, (langid.DIM, 3)).astype(np.float32), rng.normal(0, 1, 3), 1.7)
    texts = [t for t in TEXTS if t and any(c.isalpha() for c in t) and len(t) < 4000]
    best, p = model.scores([None, *texts, "12 !"])
    assert best[0] == best[-1] == -1 and p[0] == p[-1] == 0
    for k, s, t in zip(best[1:-1], p[1:-1], texts, strict=True):
        want = plain_language(model, t)
        assert k == want.argmax() and s == pytest.approx(want.max(), abs=1e-6)


def test_language_columns_and_labels(spark, docs, monkeypatch):
    clash = docs.withColumns({c: F.lit("x") for c in ("score", "Lang_Pred", "row", "use", "drawn", "u")})
    out = langid.predict(clash, langid.learn(clash))
    assert out.columns == [c for c in clash.columns if c not in ("score", "Lang_Pred")] + ["lang_pred", "score"]
    assert {r.lang_pred for r in out.collect()} <= {"und", "en", "fr"} and {r.row for r in out.collect()} == {"x"}


def test_many_labels_are_all_learned(spark, monkeypatch):
    """More labels than a full sample has room for: each is learned from fewer documents."""
    monkeypatch.setattr(langid, "MOST_ROWS", 700)
    letters = [a + b for a in "bcdfghjklm" for b in "aeiou"]
    rows = [(i, " ".join([letters[i % 35] * 3, letters[i % 35] + "x", letters[i % 35] * 2] * 4), f"l{i % 35:02d}") for i in range(1400)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 35
    own = spark.createDataFrame(rows[:350], "doc_id long, text string, lang string")
    assert langid.predict(own, model).where("lang = lang_pred").count() > 330


def test_language_edges(spark, docs, empty):
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(spark, docs).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= got and {p for _, p in got} <= {"und", "en", "fr"}
    assert all(0 <= r.score <= 1 for r in langid.identify(spark, docs).collect())
    assert langid.identify(spark, docs).count() == docs.count()
    assert langid.identify(spark, empty).count() == 0
    assert {r.lang_pred for r in langid.identify(spark, docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity_held_out(spark):
    own, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxic_documents(spark, own, labels).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    by = {r.toxic: r.p for r in out}
    assert by[1] > 0.8 and by[0] < 0.01


def test_pairs_count_beyond_their_terms():
    """Two terms that are harmless alone and toxic together: factors learn what weights cannot."""
    rng = np.random.default_rng(0)
    sets, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        sets.append(np.array([k for k, x in enumerate((a, b)) if x] + [2 + int(rng.integers(8))]))
        labels.append(float(a and b))
    m = toxicity.fit(sets, np.array(labels), 10)
    pair = lambda i, j: float(m.factor[i] @ m.factor[j])
    assert pair(0, 1) > 5 * abs(pair(0, 5))


def test_machine_is_trained_as_by_plain_loops(monkeypatch):
    """Every step by loops over documents, terms and pairs."""
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    monkeypatch.setattr(toxicity, "BATCH", 7)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 12, rng.integers(0, 8))) for _ in range(40)]
    labels = np.array([float(3 in s or rng.random() < 0.2) for s in sets])
    got = toxicity.fit(sets, labels, 12)
    rng = np.random.default_rng(0)
    v, w, wn, vn, bn = rng.normal(0, 0.01, (4, 12)), [0.5] * 12, [1.0] * 12, [[0.1] * 12 for _ in range(4)], 1.0
    b, f = sum(labels), sum(1 - labels)
    bias = math.log(b / f)

    def sign(bad, n, all_bad, all_fine):
        share = all_bad / (all_bad + all_fine)
        p, q = bad + 2 * share, n - bad + 2 * (1 - share)
        z = math.log((p / all_bad) / (q / all_fine)) / math.sqrt(1 / p + 1 / q)
        return math.copysign(max(abs(z) - 2, 0), z)

    n = [sum(t in s for s in sets) for t in range(12)]
    bad = [sum(y for s, y in zip(sets, labels, strict=True) if t in s) for t in range(12)]
    for _ in range(2):
        order = rng.permutation(40)
        for first in range(0, 40, 7):
            dw, dv, db = [1e-3 * (x - 0.5) for x in w], [[2.0 * x for x in row] for row in v], 0.0
            for i in order[first : first + 7]:
                own = sets[i].tolist()
                x = {t: sign(bad[t] - labels[i], n[t] - 1, max(b - labels[i], 1), max(f - (1 - labels[i]), 1)) for t in own}
                scale = 16 / max(len(own), 1)
                z = bias + sum(w[t] * x[t] for t in own) + scale * sum(v[k][s] * v[k][t] for k in range(4) for s in own for t in own if s < t)
                g = 1 / (1 + math.exp(-max(-30, min(30, z)))) - labels[i]
                db += g
                for t in own:
                    dw[t] += g * x[t]
                    for k in range(4):
                        dv[k][t] += g * scale * sum(v[k][s] for s in own if s != t)
            for t in range(12):
                wn[t] += dw[t] ** 2
                w[t] -= 0.1 * dw[t] / math.sqrt(wn[t])
                for k in range(4):
                    vn[k][t] += dv[k][t] ** 2
                    v[k][t] -= 0.1 * dv[k][t] / math.sqrt(vn[k][t])
            bn += db * db
            bias -= 0.1 * db / math.sqrt(bn)
    assert np.allclose(got.factor.T, v) and got.bias == pytest.approx(bias) and np.allclose(got.weight, [w[t] * sign(bad[t], n[t], b, f) for t in range(12)])


def test_pair_of_neutral_terms_is_learned_from_documents(spark):
    """Neither word is three times as frequent under label 1, so that only their factors can tell."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        a, b = rng.random() < 0.6, rng.random() < 0.6
        words = [f"w{k:03d}" for k in rng.integers(0, 300, 20)] + ["gizmo"] * a + ["folks"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a and b)))
    own = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.toxic_documents(spark, own.select("doc_id", "text"), own.select("doc_id", "toxic")).join(own, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    by = {r.toxic: r.p for r in out}
    assert by[1] > 0.95 and by[0] < 0.01


def test_machine_scores_equal_plain_loops():
    rng = np.random.default_rng(3)
    texts = [prose(30), "One one ONE two", "", "déjà-vu x1_y2", prose(5)]
    sets = []
    for t in texts:
        h, owner = toxicity.hashes([t.encode()])
        sets.append(set(toxicity.leveled(h, owner)[0].tolist()))
        words = re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower())
        pieces = collections.Counter(("w", w) for w in words) + collections.Counter(("p", w[:n]) for w in words for n in range(4, 10) if len(w) >= n)
        assert len(sets[-1]) == sum(min(n, 3) for n in pieces.values())  # a term for each level its count reaches
    m = toxicity.Machine(rng.normal(0, 1, toxicity.TABLE), rng.normal(0, 0.3, (toxicity.TABLE, 4)), 0.1)
    for p, own in zip(m.scores([t.encode() for t in texts]), sets, strict=True):
        rows = sorted({t % toxicity.TABLE for t in own})
        scale = 16 / max(len(rows), 1)
        total = 0.1 + sum(m.weight[i] for i in rows) + scale * sum(float(m.factor[i] @ m.factor[j]) for n, i in enumerate(rows) for j in rows[n + 1 :])
        assert p == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-9)


def test_factors_count_on_held_out_documents(spark):
    """Without its factors the machine finds fewer of the documents that only a pair of words marks."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(2400):
        a, b = rng.random() < 0.5, rng.random() < 0.7
        words = [f"w{k:03d}" for k in rng.integers(0, 200, 15)] + ["insultx"] * a + ["groupy"] * b
        rows.append((i, " ".join(words), int(a and b)))
    own = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.learn(own.select("doc_id", "text"), own.select("doc_id", "toxic"))
    pair, insult, group = m.scores([b"insultx groupy", b"insultx w001", b"groupy w001"])
    assert pair > max(insult, group)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    texts, gold = [r[1].encode() for r in held], np.array([r[2] for r in held])
    found = lambda machine: float(((machine.scores(texts) >= 0.7) == gold).mean())
    weights_alone = toxicity.Machine(m.weight, m.factor * 0, m.bias)
    assert found(m) > 0.97 and found(weights_alone) < found(m) - 0.1


def test_toxicity_at_the_small_scale(spark):
    own, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxic_documents(spark, own, labels).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.sum("predicted").alias("p")).collect()
    by = {r.toxic: r.p for r in out}
    assert by[1] >= 12 and by[0] <= 2


def test_toxicity_clashing_names_and_long_texts(spark):
    long = " ".join(f"w{i % 5000} insult" for i in range(120_000))
    rows = [(i, "insult you" if i % 4 == 0 else f"kind w{i}", int(i % 4 == 0)) for i in range(400)] + [(1000, long, 1), (1001, "kind " * 300_000, 0)]
    own = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs_ = own.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("terms", "toxic", "term", "score", "predicted", "held_out", "id_", "text_")])
    labels = own.select("doc_id", "toxic", *[F.lit("y").alias(c) for c in ("terms", "term", "text", "score", "id_")])
    out = toxicity.toxic_documents(spark, docs_, labels).join(own.select("doc_id", F.col("toxic").alias("gold")), "doc_id")
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "gold"] and out.where("predicted <> gold").count() == 0


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 0, 1), (6, 1, 0), (7, 1, None), (None, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxic_documents(spark, docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxic_documents(spark, empty, labels).count() == 0
    assert {r.predicted for r in toxicity.toxic_documents(spark, docs, labels.limit(0)).collect()} == {0}


# Queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.ORACLE_SQL:
        same(df, duck.sql(queries.ORACLE_SQL[name]))
    else:
        assert df.count() > 0


def stages(spark, current):
    """The rows after each stage of the pipeline, each held against its operator's own result."""
    import corpus_pipeline

    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, current, "")
        rows = df.collect()
        plain = current.select("doc_id", "text", "lang", "source")
        if name != "packing":
            assert df.columns == current.columns
        if name == "language_id":
            model = langid.learn(plain, where=langid.fold(F.col("doc_id"), 4) != 2)
            assert len(rows) == langid.predict(plain, model).where("lang_pred <> 'und' AND score >= 0.4").count()
        if name == "simhash_dedup":
            texts = [t for _, t in rows_of(plain)]
            assert len(rows) == len(set(unite([plain_fingerprint(t) for t in texts])))
        if name == "substring_dedup":
            words = collections.Counter()
            for (i, n, gone, _), times in plain_repeats(rows_of(plain)).items():
                words[i] += (n - gone) * times
            assert collections.Counter({i: n for i, n in words.items() if n}) == sum((collections.Counter({r.doc_id: len(split(r.text))}) for r in rows), collections.Counter())
        if name == "source_mixing":
            taken = mixing.mix(plain, boost=mixing.by_length, extra=("source",)).groupBy("source").agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken")).collect()
            assert collections.Counter(r.source for r in rows) == collections.Counter({r.source: r.copies for r in taken if r.copies})
            assert sum(len(split(r.text)) for r in rows) == sum(r.taken for r in taken)
        current = spark.createDataFrame(rows, df.schema)
        out[name] = rows
    return out


def test_tables_that_are_read_no_more_go(spark, docs, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "work_root", lambda spark: f"file://{tmp_path}")
    left = lambda: sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    toxicity.learn(read("documents"), read("labels"))
    toxicity.learn(read("documents"), read("labels").where("toxic = 2"))
    langid.learn(docs, where=F.lit(True))
    assert left() == []
    roots = components.components(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, None)], "a long, b long"))
    assert left() == ["roots"] and {(r.node, r.root) for r in roots.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    kept = shared.materialise(docs.withColumn("stored_at", F.lit("own")), "kept")
    shared.discard(docs.withColumn("stored_at", F.lit("own")))  # not a stored table, whatever its columns
    assert kept.count() == docs.count()
    shared.discard(kept)
    assert left() == ["roots", "roots"]


def test_pipeline_keeps_rows_and_columns(spark):
    """Rows without or with a shared doc_id, and columns named as the operators' own."""
    names = ("copy", "copies", "text_key", "k_id", "score", "lang_pred", "n_removed", "row", "ord", "u", "size", "part")
    rows = [(None, f"{prose(30)} end {i % 40}", "en", ["a", "b"][i // 40], 5) for i in range(80)]
    rows += [(9, prose(60), "en", "a", 5), (9, prose(61), "en", "b", 5)] + [(20 + i, prose(40 + i), "en", "b", 5) for i in range(25)] + [(None, "a copy " + PASSAGE, "en", "a", 5)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"own {c}") for c in names}).repartition(3)
    kept = stages(spark, df)
    assert len(kept["language_id"]) == len(rows) and len([r for r in kept["simhash_dedup"] if r.doc_id == 9]) == 2
    assert sum(r.text == "a copy " + PASSAGE for r in kept["simhash_dedup"]) == 1
    for name in ("language_id", "simhash_dedup", "substring_dedup", "source_mixing"):
        assert all(r[c] == f"own {c}" for r in kept[name] for c in names)


def test_pipeline(spark, docs, empty):
    import corpus_pipeline

    current = docs.unionByName(spark.createDataFrame([(50, prose(80), "en", "s1", 9, ""), (51, prose(90) + " " + PASSAGE, "en", "s1", 9, "")], DOC))
    first = sorted(rows_of(current), key=lambda r: (r[0] is None, r[0]))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, "")
        if name != "packing":
            assert out.columns == current.columns
        current = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = current.collect()
    assert {0, 1, 2}.isdisjoint({r.doc_id for r in kept["language_id"]}) and {50, 51} <= {r.doc_id for r in kept["language_id"]}
    ids = [r.doc_id for r in kept["simhash_dedup"]]
    assert {i for i, n in collections.Counter(ids).items() if n > 1} <= {3} and 11 not in ids  # 3 has two different texts
    cut = {r.doc_id: r.text for r in kept["substring_dedup"]}
    assert PASSAGE in " ".join(cut[7].split()) and PASSAGE not in cut[51] and len(first) > len(cut)
    assert {r.doc_id for r in kept["source_mixing"]} <= set(cut)
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["source_mixing"]}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_substrings_equal_sql(spark, docs, duck):
    con = duck.cursor()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    same(substrings.remove_repeats(spark, docs), con.sql(substrings.ORACLE_SQL))
