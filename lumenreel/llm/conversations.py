"""Repair of conversation structure: faults by windows, cheapest edits by a higher-order fold.

A conversation's turns, in order, are to give roles that begin with ``s?(ua)+`` (system, then user and assistant in
turn) or nothing. Edits are Keep, Rerole, Delete and Insert, with a cost each; a blank or repeated turn must go. Four
states say what came last (nothing, system, user, assistant). Flags of faults come from windows; the turns of a
conversation are collected as sorted structs, and ``aggregate()`` carries for each state the cheapest edits so far as a
struct (cost, audit), of which ``least`` takes the smaller cost and, at equal costs, the smaller audit in ASCII. At
equal costs and after equal turns no audit is the beginning of another (each further Insert costs), so the smaller
beginning stays the smaller whole.

A conversation of more than ``MOST_TURNS`` turns or ``MOST_BYTES`` of text is never collected. Its rows are dealt by
ranges of their order, each range is cut into chunks, and a chunk is folded from each of the four states; what is
collected for a conversation is a few short strings for each chunk, from which the states at the chunks' borders follow.
The audit of a conversation is one value, and its digest one hash over texts in order, so these two are made for a
conversation in one task, the digest from a stream of chunks.

Null conv_ids are a conversation of their own; a null turn comes first; a null role or text is one space, so that the
turn is blank or its role fits nowhere. Rows of one turn are ordered by role and text, equal rows repeat. Conversations
all of whose rows are dropped have zeros and an empty audit; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, materialise, ship

MOST_TURNS = 2000
MOST_BYTES = 8 << 20
RANGE_ROWS = 50_000  # rows of long conversations in a range, about

RENAME, DROP, INSERT, LATE = 3, 4, 3, 3  # costs; LATE is that of leaving a truncated turn
UNREACHED = 1 << 40
_STATES = (0, 1, 2, 3)
_BEFORE_USER = {0: 0, 1: 0, 2: 1, 3: 0}  # inserts before a turn that becomes the user's, by the state they start in
_BEFORE_ASSISTANT = {0: 1, 1: 1, 2: 0, 3: 1}

_WHITE = "\\x20\\x09-\\x0D"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped: the damaged rows by crc32 of ``conv_id:turn`` modulo 20. Dropped rows are marked, not gone."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(name("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")


def _flagged(rows: DataFrame, within: list[str], repeated: Column | None = None) -> DataFrame:
    """Adds fault (blank, duplicate, truncated or null), initial and illegal (it may not follow the turn before in its part)."""
    part = [*within, "dropped"]
    blank = ~F.col("text").rlike(f"[^{_WHITE}]")
    cut = ~F.col("text").rlike(f"[.!?][{_WHITE}]*\\z")
    if repeated is None:
        repeated = F.row_number().over(Window.partitionBy(*part, "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(blank, "blank").when(repeated, "duplicate").when(cut, "truncated")
    rows = rows.withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))
    before = F.lag("initial").over(Window.partitionBy(*part).orderBy(F.asc_nulls_first("turn"), "role", "text"))
    return rows.withColumn("illegal", ~F.concat(before, F.col("initial")).isin("su", "ua", "au"))


def _collected(flagged: DataFrame, within: list[str]) -> DataFrame:
    """A row for each part, with its turns in order and counts of its faults."""
    later = (F.coalesce("fault", F.lit("")) == "duplicate").alias("later")  # of equal rows, those that repeat come last
    turn = F.struct("turn", "role", "text", later, "fault", "initial")
    stays = ~F.col("dropped")
    count = lambda c: F.count(F.when(stays & c, F.lit(1)))
    counts = [count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    return flagged.groupBy(*within).agg(F.sort_array(F.collect_list(F.when(stays, turn))).alias("turns"), *counts, count(F.col("illegal")).alias("illegal"))


def _candidate(state: Column, cost: Column, letters: str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letters)).alias("audit"))


def _step(acc: Column, turn: Column) -> Column:
    """The cheapest edits up to this turn for each state after it."""
    goes = F.coalesce(turn["fault"].isin("blank", "duplicate"), F.lit(False))
    late = F.when(F.coalesce(turn["fault"] == "truncated", F.lit(False)), F.lit(LATE)).otherwise(F.lit(0)).cast("long")
    deleted = lambda s: _candidate(acc[f"s{s}"], F.lit(DROP).cast("long"), "D")

    def becomes(initial: str, before: dict[int, int]) -> list[Column]:
        out = []
        for s, n in before.items():
            paid = late + F.lit(n * INSERT).cast("long")
            out.append(F.when(~goes & (turn["initial"] == initial), _candidate(acc[f"s{s}"], paid, "I" * n + "K")))
            out.append(F.when(~goes, _candidate(acc[f"s{s}"], paid + F.lit(RENAME).cast("long"), "I" * n + "R")))
        return out

    system = F.when(~goes & (turn["initial"] == "s"), _candidate(acc["s0"], late, "K"))
    return F.struct(
        deleted(0).alias("s0"), F.least(deleted(1), system).alias("s1"), F.least(deleted(2), *becomes("u", _BEFORE_USER)).alias("s2"), F.least(deleted(3), *becomes("a", _BEFORE_ASSISTANT)).alias("s3"),
    )


def _start(state: int) -> Column:
    cell = lambda s: F.struct(F.lit(0 if s == state else UNREACHED).cast("long").alias("cost"), F.lit("").alias("audit"))
    return F.struct(*[cell(s).alias(f"s{s}") for s in _STATES])


def _fold(turns: Column, state: int) -> Column:
    return F.aggregate(turns, _start(state), _step)


def _ended(states: Column) -> Column:
    """The cheapest way to an end: nothing, after an assistant, or with the inserts that lead there."""
    insert = lambda n: F.lit(n * INSERT).cast("long")
    return F.least(states["s0"], states["s3"], _candidate(states["s2"], insert(1), "I"), _candidate(states["s1"], insert(2), "II"))


def _edited(turns: Column, audit: Column, first: Column) -> Column:
    """The repaired turns (role, text) of a part; first: the initial, u or a, that an inserted turn would have at its start."""
    role = lambda i: F.when(i == "u", "user").otherwise("assistant")
    other = lambda i: F.when(i == "u", "a").otherwise("u")
    made = lambda i, text: F.array(F.struct(role(i).alias("role"), text.alias("text")))
    none = F.array().cast("array<struct<role:string,text:string>>")

    def inserted(i: Column, n: Column) -> Column:
        return F.when(n == 0, none).when(n == 1, made(i, F.lit(""))).otherwise(F.concat(made(i, F.lit("")), made(other(i), F.lit(""))))

    def apply(acc: Column, pair: Column) -> Column:
        n = F.length(pair["edits"]) - 1
        edit = F.substring(pair["edits"], -1, 1)
        at = F.when(n % 2 == 1, other(acc["next"])).otherwise(acc["next"])
        turn = pair["turns"]
        kept = F.array(F.struct(turn["role"].alias("role"), turn["text"].alias("text")))
        following = F.when(edit == "K", F.when(turn["initial"] == "u", "a").otherwise("u")).when(edit == "R", other(at)).otherwise(at)
        out = F.concat(acc["out"], inserted(acc["next"], n), F.when(edit == "K", kept).when(edit == "R", made(at, turn["text"])).otherwise(none))
        return F.struct(following.alias("next"), out.alias("out"))

    edits = F.regexp_extract_all(audit, F.lit("I*[KRD]"), F.lit(0))
    at_end = F.length(F.regexp_extract(audit, "I*$", 0))
    pairs = F.arrays_zip(turns.alias("turns"), edits.alias("edits"))
    return F.aggregate(pairs, F.struct(first.alias("next"), none.alias("out")), apply, lambda acc: F.concat(acc["out"], inserted(acc["next"], at_end)))


def _gaps() -> Column:
    return F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0)).cast("long").alias("gaps")


_REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _short(rows: DataFrame) -> DataFrame:
    """_REPORT, chunk, and turns (role, text) of conversations that are collected whole, each in one row."""
    got = _collected(_flagged(rows, ["conv_id"]), ["conv_id"])
    numbers = F.filter(F.col("turns.turn"), lambda t: t.isNotNull())
    ends = got.withColumn("low", F.array_min(numbers)).withColumn("high", F.array_max(numbers)).withColumn("n_turns", F.size(F.array_distinct(numbers)))
    best = ends.withColumn("best", _ended(_fold(F.col("turns"), 0)))
    return best.select("conv_id", _gaps(), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", F.lit(0).cast("long").alias("chunk"), _edited(F.col("turns"), F.col("best.audit"), F.lit("u")).alias("turns"))


def _long(rows: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """_REPORT of long conversations, their turns by chunk (conv_id, chunk, turns), and the tables to delete after use."""
    spread = ["conv_id", "turn", "role", "text"]
    numbered = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    ranges = materialise(numbered.repartitionByRange(-(-n_rows // RANGE_ROWS), *spread, "row").withColumn("range", F.spark_partition_id().cast("long")).drop("row"), "ranges")
    own = ["conv_id", "range"]
    order = [F.asc_nulls_first("turn"), "role", "text"]
    before = Window.partitionBy(*own, "dropped").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.floor(F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)) / MOST_BYTES) + F.floor(F.count(F.lit(1)).over(before) / MOST_TURNS)
    placed = ranges.withColumn("chunk", F.col("range") * (1 << 31) + size).withColumn("again", F.row_number().over(Window.partitionBy(*own, "dropped", "role", "text").orderBy(*order)) > 1)
    # The first of equal turns in each range, at most one for each range, is held against those of other ranges.
    firsts = placed.where("NOT again").withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("range")) > 1)
    marked = materialise(firsts.unionByName(placed.where("again")), "marked")
    parts = _collected(_flagged(marked.where("NOT dropped"), ["conv_id", "chunk"], F.col("again")), ["conv_id", "chunk"])
    last = F.element_at("turns", -1)["initial"]
    folded = parts.withColumn("first", F.col("turns")[0]["initial"]).withColumn("last", last).withColumns({f"f{s}": _fold(F.col("turns"), s) for s in _STATES})
    chunks = materialise(folded, "chunks")
    joint = F.lag("last").over(Window.partitionBy("conv_id").orderBy("chunk"))
    met = chunks.drop("turns").withColumn("illegal", F.col("illegal") + F.coalesce((~F.concat(joint, F.col("first")).isin("su", "ua", "au")).cast("long"), F.lit(0)))
    summed = met.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.sort_array(F.collect_list(F.struct("chunk", *[f"f{s}" for s in _STATES]))).alias("parts"))

    def join(acc: Column, part: Column) -> Column:
        def to(t: int) -> Column:
            ways = []
            for s in _STATES:
                via = part[f"f{s}"][f"s{t}"]
                ways.append(F.struct((acc[f"s{s}"]["cost"] + via["cost"]).alias("cost"), F.concat(acc[f"s{s}"]["audit"], via["audit"]).alias("audit"), F.concat(acc[f"s{s}"]["path"], F.array(F.lit(s))).alias("path")))
            return F.least(*ways)

        return F.struct(*[to(t).alias(f"s{t}") for t in _STATES])

    cell = lambda s: F.struct(F.lit(UNREACHED if s else 0).cast("long").alias("cost"), F.lit("").alias("audit"), F.array().cast("array<int>").alias("path")).alias(f"s{s}")
    states = F.aggregate("parts", F.struct(*[cell(s) for s in _STATES]), join)
    closing = {0: "", 3: "", 2: "I", 1: "II"}
    ends = F.least(*[F.struct((F.col("states")[f"s{s}"]["cost"] + INSERT * len(x)).alias("cost"), F.concat(F.col("states")[f"s{s}"]["audit"], F.lit(x)).alias("audit"), F.concat(F.col("states")[f"s{s}"]["path"], F.array(F.lit(s))).alias("path"), F.lit(x).alias("closing")) for s, x in closing.items()])
    best = materialise(summed.withColumn("states", states).withColumn("best", ends).drop("states"), "best")
    turns = ranges.where("NOT dropped").groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("n_turns"))
    every = ranges.select(F.col("conv_id").alias("id")).distinct()
    one = every.join(best, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    one = one.join(turns, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("id", "conv_id")
    zero = lambda c, of=None: F.coalesce(F.col(of or c), F.lit(0)).cast("long").alias(c)
    report = one.select("conv_id", _gaps(), *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal")], zero("cost", "best.cost"), F.coalesce("best.audit", F.lit("")).alias("audit"))
    # The state at the start of each chunk says which of its four folds was taken.
    chosen = best.select(F.col("conv_id").alias("id"), F.posexplode("parts").alias("at", "part"), "best.path", "best.closing")
    from_, to_ = F.col("path")[F.col("at")], F.col("path")[F.col("at") + 1]
    edits = F.lit("")
    for s in _STATES:
        for t in _STATES:
            edits = F.when((from_ == s) & (to_ == t), F.col("part")[f"f{s}"][f"s{t}"]["audit"]).otherwise(edits)
    chosen = chosen.select("id", F.col("part.chunk").alias("of"), F.concat(edits, F.when(F.col("at") + 2 == F.size("path"), F.col("closing")).otherwise("")).alias("edits"), F.when(from_ == 2, "a").otherwise("u").alias("next"))
    pieces = chunks.join(chosen, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("chunk") == F.col("of"))).select("conv_id", "chunk", _edited(F.col("turns"), F.col("edits"), F.col("next")).alias("turns"))
    discard(numbered)
    return report, pieces, [ranges, marked, chunks, best]


def repair(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report and the repaired turns of conversations (conv_id, turn, role, text, dropped).

    The report has a row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost and audit, with chunk 0 and
    its repaired turns (role, text) where the conversation is not long, else with nulls there. The second table has the
    repaired turns of long ones by chunk (conv_id, chunk, turns), in the order of chunks.
    """
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = materialise(sizes.where((F.col("n") > MOST_TURNS) | (F.col("bytes") > MOST_BYTES)).select(F.col("conv_id").alias("long_id"), "n"), "long")
    total = long.agg(F.sum("n")).first()[0]
    if not total:
        discard(long)
        whole = _short(rows)
        return whole, whole.where("false").select("conv_id", "chunk", "turns")
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    whole = _short(rows.join(long, same, "left_anti"))
    report, pieces, _ = _long(rows.join(long.select("long_id"), same, "left_semi"), total)
    lacking = report.select(*_REPORT, F.lit(None).cast("long").alias("chunk"), F.lit(None).cast(whole.schema["turns"].dataType).alias("turns"))
    return whole.unionByName(lacking), pieces


def _lines(turns: str = "turns") -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id and sha256 of the ``role:text`` lines of its chunks in order, from a stream: no conversation is held whole."""
    ship(pieces.sparkSession)

    def run(batches):
        none, now, digest, begun = object(), None, None, False
        now = none
        for b in batches:
            for conv, text, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if now is none or conv != now:
                    if now is not none:
                        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([now], pa.int64()), "sha256": [digest.hexdigest()]})
                    now, digest, begun = conv, hashlib.sha256(), False
                if n:
                    digest.update(b"\n" * begun + text.encode())
                    begun = True
        if now is not none:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([now], pa.int64()), "sha256": [digest.hexdigest()]})

    lines = pieces.select("conv_id", "chunk", _lines().alias("lines"), F.size("turns").alias("n")).repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return lines.select("conv_id", "lines", "n").mapInArrow(run, "conv_id long, sha256 string")


def repaired_conversations(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """_REPORT and repaired_sha256 of each conv_id of rows (conv_id, turn, role, text), after damage()."""
    report, pieces = repair(spark, damage(rows))
    own = report.select(*_REPORT, F.when(F.col("chunk").isNotNull(), F.sha2(_lines().cast("binary"), 256)).alias("own"))
    if pieces.isEmpty():
        return own.withColumn("repaired_sha256", F.coalesce("own", F.sha2(F.lit("").cast("binary"), 256))).drop("own")
    hashed = digests(pieces).withColumnRenamed("conv_id", "id")
    joined = own.join(hashed, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return joined.select(*_REPORT, F.coalesce("own", "sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _sql() -> str:
    ways = {0: [("c0", DROP, "D", "true")], 1: [("c1", DROP, "D", "true"), ("c0", 0, "K", "i = 's'")], 2: [("c2", DROP, "D", "true")], 3: [("c3", DROP, "D", "true")]}
    for t, initial, before in ((2, "u", _BEFORE_USER), (3, "a", _BEFORE_ASSISTANT)):
        for s, n in before.items():
            ways[t] += [(f"c{s}", n * INSERT, "I" * n + "K", f"i = '{initial}'"), (f"c{s}", n * INSERT + RENAME, "I" * n + "R", "true")]

    def best(t: int) -> str:
        cells = [f"CASE WHEN {'true' if e == 'D' else f'NOT goes AND {when}'} THEN {{'cost': {c}.cost + {paid} + {'0' if e == 'D' else 'late'}, 'audit': {c}.audit || '{e}'}} END" for c, paid, e, when in ways[t]]
        return f"least({', '.join(cells)}) AS c{t}" if len(cells) > 1 else f"{cells[0]} AS c{t}"

    bits = "list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    name = "(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({name}) + 1), lambda p: ascii({name}[p])::BIGINT)), lambda a, x: {bits}), 4294967295)"
    start = ", ".join(f"{{'cost': {0 if s == 0 else UNREACHED}::BIGINT, 'audit': ''}} AS c{s}" for s in _STATES)
    return f"""
WITH RECURSIVE k AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
f AS (SELECT *, role[1] AS i, row_number() OVER o AS pos, lag(role[1]) OVER o AS before, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
  NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut FROM d
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
h AS (SELECT *, pos > min(pos) OVER (PARTITION BY conv_id, role, text) AS again FROM f),
g AS (SELECT *, blank OR again AS goes, CASE WHEN cut AND NOT blank AND NOT again THEN {LATE} ELSE 0 END AS late FROM h),
w AS (SELECT conv_id, 0::BIGINT AS pos, {start} FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL SELECT g.conv_id, g.pos, {', '.join(best(t) for t in _STATES)} FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.pos = w.pos + 1),
e AS (SELECT conv_id, least(c0, c3, {{'cost': c2.cost + {INSERT}, 'audit': c2.audit || 'I'}}, {{'cost': c1.cost + {2 * INSERT}, 'audit': c1.audit || 'II'}}) AS best FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
l AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS letter, generate_subscripts(string_split(best.audit, ''), 1) AS nr FROM e WHERE best.audit <> ''),
m AS (SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY nr) AS pos FROM l),
t AS (SELECT m.*, g.role, g.text, g.i, sum(CASE WHEN letter = 'K' AND g.i = 's' THEN 0 ELSE 1 END) OVER (PARTITION BY m.conv_id ORDER BY nr) AS place
  FROM m LEFT JOIN g ON letter <> 'I' AND g.conv_id IS NOT DISTINCT FROM m.conv_id AND g.pos = m.pos WHERE letter <> 'D'),
r AS (SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, ''), chr(10) ORDER BY nr) AS lines FROM t GROUP BY 1),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
  count(*) FILTER (late > 0) AS truncated, count(*) FILTER ((before || i) NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id::BIGINT AS conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE_SQL = _sql()
