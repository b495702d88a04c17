"""URL filters with redirect equivalence. Native: DataFrame functions only.

Rules name a host and the start of a path and allow or block; a rule fits its host and all subdomains, and the longest
rule that fits decides (of equally long ones an allowing one, then the one whose text is largest). A url without a rule
follows its aliases: what pages state (canonical links, ``og:url``, meta refresh, redirects by script) and edges that the
caller has, as from a crawler's log of redirects, connect urls; connected components are found in the cluster. An alias
class is allowed if any of its urls has an allow rule, else blocked if any has a block rule, else it is allowed. A url's
own rule always stands. Where no page states an alias and no edges are given, rules alone decide.

Urls are the same node if they agree up to their fragment, with scheme and host in lower case. Null urls and urls
without ``://`` have an empty host and path, fit no rule, are linked to nothing and are allowed. Null html has no
edges; very long html is searched whole, for the first statement of each kind. Repeated rows repeat in the
result; page_id may be null. An empty table gives no rows; extra columns stay out, whatever their names.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import discard, materialise

#: action, host, start of the path
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
INLINE_RULES = 200
#: Where html states an alias: a pattern of the tag (or none) and one whose first group is the url. At least one of MARKS is in such html.
STATEMENTS = [
    (r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"),
    (r"(?is)<meta\b[^>]*\bproperty\s*=\s*[\"']?og:url\b[^>]*>", r"(?i)\bcontent\s*=\s*[\"']?([^\"'\s>]+)"),
    (r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"),
    (None, r"(?i)\b(?:(?:window|document|self|top)\.location(?:\.href)?\s*=\s*|location\.(?:replace|assign)\(\s*)[\"']([^\"'\s]+)"),
]
MARKS = ("canonical", "og:url", "refresh", "location")


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and where no ``://`` is."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), "^[^?#]*", 0)
    return _lower(host), path


def node(url: Column) -> Column:
    """The alias key of a url; null if it has no ``://``."""
    at = F.instr(url, "://")
    after = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    rest = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), "^[^#]*", 0)
    return F.when(at > 0, F.concat(_lower(F.substring(url, F.lit(1), at + 2)), _lower(host), rest))


def judge(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES) -> DataFrame:
    """Adds rule and action to a table with host and path. Rules: a list, or a table of action, host, path of any size."""
    if isinstance(rules, DataFrame):
        return _judge_by_join(urls, rules)
    if len(rules) > INLINE_RULES:
        return _judge_by_join(urls, urls.sparkSession.createDataFrame(rules, "action string, host string, path string"))
    chain = action = None
    last_first = sorted(rules, key=lambda r: r[1] + r[2], reverse=True)
    for verdict, host, path in sorted(last_first, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        chain = F.when(fits, host + path) if chain is None else chain.when(fits, host + path)
        action = F.when(fits, verdict) if action is None else action.when(fits, verdict)
    none = F.lit(None).cast("string")
    return urls.withColumns({"rule": none if chain is None else chain, "action": none if action is None else action})


def _judge_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each different host and path looks up its host's suffixes with the starts of its path, by equality."""
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # as many as path lengths, not rules
    table = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.when(F.col("action") == "allow", 1).otherwise(0).alias("allow")).groupBy("r_host", "r_path").agg(F.max("allow").alias("allow"))
    own = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_distinct(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])) if lengths else F.array(F.lit(None).cast("string"))
    keyed = own.withColumn("r_host", F.explode(suffixes)).withColumn("r_path", F.explode(starts)).where("r_path IS NOT NULL")
    best = keyed.join(table, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), "allow", F.concat("r_host", "r_path").alias("rule"))).alias("best"))
    named = best.select("host", "path", "best.rule", F.when(F.col("best.allow") == 1, "allow").otherwise("block").alias("action"))
    return urls.join(named, ["host", "path"], "left")


def page_edges(pages: DataFrame) -> DataFrame:
    """Edges a, b between alias keys: from a page to the urls that its html states as its own or leads to."""
    html = F.col("html")
    stated = [F.regexp_extract(html if tag is None else F.regexp_extract(html, tag, 0), link, 1) for tag, link in STATEMENTS]
    lower = F.lower(html)
    marked = functools.reduce(lambda x, y: x | y, [lower.contains(m) for m in MARKS])
    some = pages.where(marked).select("url", F.explode(F.array(*stated)).alias("to")).where("`to` <> ''")
    to, url = F.col("to"), F.col("url")
    scheme = F.regexp_extract(url, "^[^:/?#]*:", 0)
    origin = F.regexp_extract(url, "^[^/?#]*//[^/?#]*", 0)
    folder = F.regexp_extract(F.regexp_extract(url, "^[^?#]*", 0), "^[^/?#]*//[^/?#]*(.*/)?", 1)
    full = (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(scheme, to))
        .when(to.startswith("/"), F.concat(origin, to)).otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), to))
    )
    return some.select(node(url).alias("a"), node(full).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def filter_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. edges: more redirects, as urls a, b."""
    linked = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    links = page_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")).where(linked))
    links = materialise(links, "links")
    host, path = parts(F.col("url"))
    judged = judge(pages.select("page_id", node(F.col("url")).alias("node"), host.alias("host"), path.alias("path")), rules)
    if links.isEmpty():
        discard(links)
        whole = judged.withColumn("inherited", F.lit(None).cast("string"))
    else:
        members = components(links)
        discard(links)
        host, path = parts(F.col("node"))
        ruled = judge(members.withColumns({"host": host, "path": path}), rules).where("action IS NOT NULL")
        decided = ruled.groupBy("root").agg(F.min("action").alias("inherited"))  # allow comes before block
        known = members.join(decided, "root").select(F.col("node").alias("key"), "inherited")
        # Rows without a node meet nothing; a key of their own keeps them from meeting in one task.
        key = F.coalesce("node", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
        whole = judged.withColumn("key", key).join(known, "key", "left")
    return whole.select("page_id", "host", "path", "rule", F.coalesce("action", "inherited", F.lit("allow")).alias("verdict"))


def _sql_lower(x: str) -> str:
    return f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _sql_after(u: str) -> str:
    return f"CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"


def _sql_node(u: str) -> str:
    head = f"regexp_extract({u}, '^(?s:.*?)://[^/?#]*')"
    return f"CASE WHEN instr({u}, '://') > 0 THEN {_sql_lower(head)} || regexp_extract(substr({u}, length({head}) + 1), '^[^#]*') END"


def _sql_parts(u: str) -> str:
    host = f"regexp_extract({_sql_after(u)}, '^[^/?#]*')"
    return f"{_sql_lower(host)} AS host, regexp_extract(substr({_sql_after(u)}, length({host}) + 1), '^[^?#]*') AS path"


_SQL_RULES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
_SQL_HTML = [("html" if tag is None else "regexp_extract(html, '{}')".format(tag.replace("'", "''")), link.replace("'", "''")) for tag, link in STATEMENTS]
_SQL_STATED = ", ".join(f"regexp_extract({html}, '{link}', 1)" for html, link in _SQL_HTML)
#: The same result, with components as a closure.
ORACLE_SQL = f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {_sql_node("url")} AS node, {_sql_parts("url")} FROM pages),
t AS (SELECT url, node, unnest([{_SQL_STATED}]) AS u FROM p),
o AS (SELECT node, u, regexp_extract(url, '^[^:/?#]*:') AS scheme, regexp_extract(url, '^[^/?#]*//[^/?#]*') AS origin, regexp_extract(regexp_extract(url, '^[^?#]*'), '^[^/?#]*//[^/?#]*(.*/)?', 1) AS folder FROM t WHERE u <> ''),
f AS (SELECT node, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN u WHEN starts_with(u, '//') THEN scheme || u WHEN starts_with(u, '/') THEN origin || u
  ELSE origin || CASE WHEN folder = '' THEN '/' ELSE folder END || u END AS url FROM o),
e AS (SELECT node AS a, {_sql_node("url")} AS b FROM f),
g AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT a AS x, a AS y FROM g UNION SELECT r.x, g.b FROM r JOIN g ON r.y = g.a),
n AS (SELECT y AS node, {_sql_parts("y")} FROM (SELECT DISTINCT y FROM r)),
u AS (SELECT * FROM (VALUES {_SQL_RULES}) v(action, r_host, r_path)),
h AS (SELECT host, path FROM p UNION SELECT host, path FROM n),
b AS (SELECT DISTINCT ON (host, path) host, path, action, r_host || r_path AS rule FROM h JOIN u ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  ORDER BY host, path, length(r_host || r_path) DESC, action, r_host || r_path DESC),
d AS (SELECT r.x AS node, min(b.action) AS inherited FROM r JOIN n ON n.node = r.y JOIN b ON b.host = n.host AND b.path = n.path GROUP BY 1)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.action, d.inherited, 'allow') AS verdict
FROM p LEFT JOIN b ON b.host = p.host AND b.path = p.path LEFT JOIN d ON d.node = p.node
"""
