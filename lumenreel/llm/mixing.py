"""Mixing sources to target weights by Pareto order sampling. Native: DataFrame functions only.

A source's target is its share of the words to take, by weight, at most ``cap`` times its own words; what a cap frees
goes to the other sources by weight (solved exactly: capped sources are a prefix of the order by cap / weight).
Within a source a document's expectation, how often it is taken on average, is in proportion to its ``boost`` and
``cap`` at most; the factor is solved exactly, so that expectations times sizes add up to the target (boosts are taken
in ``STEPS``-ths up to ``HIGHEST``, so a source has a bounded number of classes, and the capped ones are those of the
largest boosts). The whole part of an expectation is certain: so many copies. The rest is the inclusion chance p of one
more copy; documents are ranked by random odds over inclusion odds, q = (u / (1 - u)) / (p / (1 - p)), and the first are
taken until the source's words are used up (the document at the border if that comes nearer). So a sum over the corpus is
estimated by adding up value times copies over expectation, column ``wanted``, of the documents taken. The registered
query boosts by length: a document of n words counts as many times as n has binary digits.

u comes from md5 of the document id (of the text, where the id is null) and a seed, so reruns agree. The border is found
from histograms of q, twice, and only the documents of one fine bin are ordered in a window: a source with a third of
all rows is dealt by bin. Tables of a row for each source, or for each class of a source, are counted and sent to every
task up to ``MOST_ROWS``; larger ones are joined with salt, so documents of one source never meet in one task.

Null texts and texts without words have size 0 and are never taken. A null source is a source, last in order. A null
boost is 1, and a document of boost 0 is never taken. Rows that repeat a doc_id each count, tie in q and are ordered by
size; of rows equal in all of these any may be the one at the border. Very long texts are sized whole. Extra columns are
ignored, or kept as they are where ``extra`` names them; a name that the result has too is refused. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, discard, materialise

BINS = 1024
WEIGHTS = (5.0, 2.0, 1.0)
STEPS, HIGHEST = 16, 64
MOST_ROWS = 100_000  # of a table by source that is sent to every task
SALT = 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_length(size: Column) -> Column:
    """The binary digits of a size."""
    return F.length(F.bin(size))


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size and target of each source; a row for each source passes through one window task."""
    whole = Window.partitionBy(F.lit(0))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("goal") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    fits = F.col("level") * F.col("weight") <= F.col("most")
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("goal", F.sum("source_size").over(whole) * F.lit(min(share, cap)))
        .withColumn("level", level).withColumn("place", F.row_number().over(by_cap))
        # The first source in this order that its share does not fill sets the level of all from it on.
        .withColumn("level", F.min(F.when(fits, F.struct("place", "level"))).over(whole)["level"])
        .withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
        .select("source", "source_size", "target")
    )


def expectations(classes: DataFrame, cap: float) -> DataFrame:
    """Adds wanted to classes (source, boost, class_size, target): in proportion to boost, cap at most, adding up to the target."""
    high = Window.partitionBy("source").orderBy(F.desc("boost"))  # HIGHEST x STEPS rows a source at most
    before, after = high.rowsBetween(Window.unboundedPreceding, -1), high.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - F.lit(cap) * F.coalesce(F.sum("class_size").over(before), F.lit(0))
    factor = F.try_divide(left, F.sum(F.col("boost") * F.col("class_size")).over(after).cast("double"))
    fits = F.col("factor") * F.col("boost") <= F.lit(cap)
    # The largest boost that need not be capped sets the factor of all from it on.
    found = F.max(F.when(fits, F.struct("boost", "factor"))).over(Window.partitionBy("source"))["factor"]
    wanted = F.when(F.col("boost") == 0, F.lit(0.0)).otherwise(F.least(F.lit(cap), F.coalesce(F.col("found") * F.col("boost"), F.lit(cap))))
    return classes.withColumn("factor", factor).withColumn("found", found).withColumn("wanted", wanted).drop("factor", "found")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of md5."""
    digits = F.substring(F.md5(F.concat(key, F.lit(seed)).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on keys, where null meets null. right: a stored table of a row for each key, small or not."""
    renamed = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    if right.limit(MOST_ROWS + 1).count() <= MOST_ROWS:
        renamed, on = F.broadcast(renamed), F.lit(True)  # the count bounds it
    else:
        left = left.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALT)))
        renamed = renamed.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        on = F.col("salt") == F.col("r_salt")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return left.join(renamed, on, how).drop(*[f"r_{k}" for k in keys], "salt", "r_salt")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: str = ":mix", boost: Callable[[Column], Column] | None = None, extra: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, wanted, copies and taken of every document, and the columns extra as they are.

    boost makes a column (of docs, or of the size it is given) by which expectations within a source are unequal.
    """
    if clash := {c.lower() for c in extra} & {"doc_id", "size", "source_size", "target", "wanted", "copies", "taken"}:
        raise ValueError(f"the result has columns of these names: {sorted(clash)}")
    text = F.col(text_col).cast("string")
    size = words(text)
    step = F.lit(STEPS) if boost is None else F.least(F.greatest(F.round(F.coalesce(boost(size).cast("double"), F.lit(1.0)) * STEPS), F.lit(0)), F.lit(STEPS * HIGHEST))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    sizes = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), step.cast("int").alias("boost"), uniform(key, seed).alias("u"), *([F.struct(*extra).alias("own")] if extra else [])), "sizes")
    goals = targets(sizes, share, cap, weights)
    classes = materialise(sizes.groupBy("source", "boost").agg(F.sum("size").alias("class_size")), "classes")
    of_source = goals.select(F.col("source").alias("g_source"), "source_size", "target")
    plan = materialise(expectations(classes.join(of_source, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source"), cap), "plan")
    ranked = meet(sizes, plan.drop("class_size"), ["source", "boost"])
    p = F.col("wanted") - F.col("certain")
    ranked = (
        ranked.withColumn("certain", F.when(F.col("size") > 0, F.floor("wanted")).otherwise(F.lit(0)))
        .withColumn("drawn", (p > 0) & (F.col("size") > 0))
        # Without p the odds would be infinite; these rows are not drawn.
        .withColumn("q", F.when(F.col("drawn"), (F.col("u") / (F.lit(1.0) - F.col("u"))) / (p / (F.lit(1.0) - p))))
        # A rank in [0, 1) that keeps the order of q and spreads it about evenly over the bins.
        .withColumn("at", F.col("q") / (F.lit(1.0) + F.col("q")))
        .withColumn("bin", F.floor(F.col("at") * BINS).cast("int"))
        .withColumn("fine", F.floor((F.col("at") * BINS - F.col("bin")) * BINS).cast("int"))
    )
    drawn = ranked.where("drawn")

    def border(rows: DataFrame, level: str, room: DataFrame) -> DataFrame:
        """By source: the first bin in which the words pass the room, and the words before it."""
        add = Window.partitionBy("source").orderBy(level)
        # Written, so that bins are added up by source and bin: else all that tasks have of a source would meet first.
        sums = materialise(rows.groupBy("source", level).agg(F.sum("size").alias("words")), "bins")  # BINS rows a source at most
        r = room.withColumnRenamed("source", "r_source")
        sums = sums.withColumn("through", F.sum("words").over(add)).join(r, F.col("source").eqNullSafe(F.col("r_source"))).drop("r_source")
        passed = sums.where(F.col("through") > F.col("room")).groupBy("source").agg(F.min(F.struct(F.col(level), (F.col("room") - F.col("through") + F.col("words")).alias("left"))).alias("b"))
        return passed.select("source", F.col(f"b.{level}").alias(f"b_{level}"), F.col("b.left").alias("room"))

    sure = F.sum(F.floor("wanted") * F.col("class_size"))
    room = materialise(plan.groupBy("source").agg((F.first("target") - sure).alias("room")), "room")
    first = materialise(border(drawn, "bin", room), "border")
    inside = meet(drawn, first.drop("room"), ["source"]).where(F.col("bin") == F.col("b_bin"))
    fine = border(inside, "fine", first.drop("b_bin"))
    bins = first.select(F.col("source").alias("f_source"), "b_bin")
    second = materialise(fine.join(bins, F.col("source").eqNullSafe(F.col("f_source"))).drop("f_source"), "border")
    joined = meet(ranked, second, ["source"], "left")
    place = F.when(F.col("b_bin").isNull() | (F.col("bin") < F.col("b_bin")) | ((F.col("bin") == F.col("b_bin")) & (F.col("fine") < F.col("b_fine"))), F.lit(1)).when((F.col("bin") == F.col("b_bin")) & (F.col("fine") == F.col("b_fine")), F.lit(0)).otherwise(F.lit(-1))
    placed = joined.withColumn("place", F.when(F.col("drawn"), place).otherwise(F.lit(-1)))
    result = ["doc_id", "size", "source_size", "target", "wanted", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).alias("taken"), *[F.col("own")[c].alias(c) for c in extra]]
    clear = placed.where("place <> 0").withColumn("copies", F.col("certain") + F.greatest("place", F.lit(0))).select(*result)
    # Of each source, the documents of one fine bin, about one in a million, meet in a task.
    order = Window.partitionBy("source").orderBy("q", "doc_id", "size")
    through = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    close = placed.where("place = 0").withColumn("more", (through - F.col("size") / 2 <= F.col("room")).cast("long"))
    discard(classes)
    return clear.unionByName(close.withColumn("copies", F.col("certain") + F.col("more")).select(*result))


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs, boost=by_length)


#: The same result as plain windows.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, coalesce(doc_id::VARCHAR, '#' || md5(coalesce(text, ''))) AS key FROM documents),
e AS (SELECT *, 16 * length(bin(size)) AS boost, (('0x' || substr(md5(key || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM e GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, source_size * 2.0::DOUBLE AS most,
  (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS goal FROM s),
l AS (SELECT *, (goal - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place FROM w),
g AS (SELECT arg_min(lev, place) AS lev FROM l WHERE lev * weight <= most),
t AS (SELECT source, source_size, least(most, coalesce((SELECT lev FROM g) * weight, most)) AS target FROM w),
k AS (SELECT e.source, boost, any_value(source_size) AS source_size, any_value(target) AS target, sum(size)::BIGINT AS n FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
m AS (SELECT *, (target - 2.0::DOUBLE * coalesce(sum(n) OVER (PARTITION BY source ORDER BY boost DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
  / nullif(sum(boost * n) OVER (PARTITION BY source ORDER BY boost DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS factor FROM k),
f AS (SELECT source, boost, source_size, target, least(2.0::DOUBLE, coalesce((arg_max(factor, boost) FILTER (factor * boost <= 2.0) OVER (PARTITION BY source)) * boost, 2.0::DOUBLE)) AS wanted, n FROM m),
r AS (SELECT source, any_value(target) - sum(floor(wanted)::BIGINT * n)::BIGINT AS room FROM f GROUP BY source),
c AS (SELECT e.doc_id, e.source, e.size, e.u, f.source_size, f.target, f.wanted, CASE WHEN size > 0 THEN floor(wanted)::BIGINT ELSE 0 END AS certain FROM e JOIN f ON e.source IS NOT DISTINCT FROM f.source AND e.boost = f.boost),
o AS (SELECT *, wanted - certain > 0 AND size > 0 AS drawn, (u / (1 - u)) / ((wanted - certain) / (1 - (wanted - certain))) AS q FROM c),
x AS (SELECT *, sum(CASE WHEN drawn THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY drawn DESC, q, doc_id, size ROWS UNBOUNDED PRECEDING) AS through FROM o),
y AS (SELECT x.*, certain + CASE WHEN drawn AND through - size / 2.0::DOUBLE <= room THEN 1 ELSE 0 END AS n FROM x JOIN r ON x.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, round(wanted, 9) AS wanted, n::INTEGER AS copies, (n * size)::BIGINT AS taken FROM y
"""
