"""Conversation repair against a plain search over all edits, its SQL, and long conversations against whole ones."""

import hashlib
import heapq
import random
import zlib

import pytest
from conftest import same

from lumenreel.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, fault string, cost long"
WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(turns):
    """Cheapest edits by Dijkstra over (turns read, roles so far), then the smallest audit; no fold and no states of its own."""
    seen, flags = set(), []
    for role, text in turns:
        body = text.rstrip(WHITE)
        flags.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, made = heapq.heappop(heap)
        if at == len(turns) and state in ("", "a"):
            return flags, cost, audit, list(made)
        if (at, state) in done:
            continue
        done.add((at, state))
        for i, role in (("u", "user"), ("a", "assistant")):
            if (state, i) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", at, i, (*made, (role, ""))))
        if at < len(turns):
            role, text = turns[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, made))
            if flags[at] not in ("blank", "duplicate"):
                late = 3 if flags[at] else 0
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, step[state, role[:1]], (*made, (role, text))))
                for i, to in (("u", "user"), ("a", "assistant")):
                    if (state, i) in step:
                        heapq.heappush(heap, (cost + 3 + late, audit + "R", at + 1, i, (*made, (to, text))))


def plain(rows):
    out = {}
    damaged = plain_damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        flags, cost, audit, made = plain_repair([r[2:] for r in own])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *(flags.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def awkward_rows():
    rng, rows = random.Random(7), []
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "User", "", None, "ua", "śystem"]
    texts = ["Yes.", "No!", "Why? \n", "cut", "", " \t", None, "a.b", "…", "long " * 40 + ".", "\x85.", "é?\x0b"]
    for conv in range(160):
        n = rng.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])
        for turn in range(n):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None, 0]), rng.choice(roles[: rng.choice([2, 3, 11])]), rng.choice(texts[: rng.choice([3, 4, 12])]) if rng.random() < 0.7 else f"t{rng.random()}."))
    rows += [(None, 0, "user", "no id."), (None, 1, "assistant", "none."), (None, None, None, None), (999, None, "user", "Only."), (-5, -3, "system", "s."), (-5, -1, "user", "x" * 300_000)]
    rows += rows[:40]  # repeated rows
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in awkward_rows()], SCHEMA).repartition(3)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def held(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def test_equals_plain_search(spark, awkward):
    assert held(C.repaired_conversations(spark, awkward)) == plain(awkward_rows())


@pytest.mark.parametrize(("turns", "ranges"), [(2, 7), (5, 20), (1, 3)])
def test_long_conversations_equal_plain_search(spark, awkward, monkeypatch, turns, ranges):
    monkeypatch.setattr(C, "MOST_TURNS", turns)
    monkeypatch.setattr(C, "RANGE_ROWS", ranges)
    assert held(C.repaired_conversations(spark, awkward)) == plain(awkward_rows())


def test_conversations_of_much_text_are_cut(spark, awkward, monkeypatch):
    monkeypatch.setattr(C, "MOST_BYTES", 100)
    report, pieces = C.repair(spark, C.damage(awkward))
    assert report.where("chunk IS NULL").count() > 5
    assert held(C.repaired_conversations(spark, awkward)) == plain(awkward_rows())
    turns = pieces.selectExpr("conv_id", "chunk", "posexplode(turns) AS (at, t)").orderBy("conv_id", "chunk", "at").collect()
    roles = "".join(r.t.role[:1] for r in turns if r.conv_id == -5)
    assert roles in ("", "ua", "sua", "uaua")


def test_equals_sql(spark, awkward, duck):
    con = duck.cursor()
    table = awkward.select("conv_id", "turn", "role", "text").toArrow()
    con.register("rows_of_conversations", table)
    con.execute("CREATE TEMP VIEW conversations AS SELECT * FROM rows_of_conversations")
    same(C.repaired_conversations(spark, awkward), con.sql(C.ORACLE_SQL))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repaired_conversations(spark, empty).count() == 0
