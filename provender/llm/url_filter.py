"""URL filter: host rules first, then trust and distrust propagated over links between hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.llm.shared import settle

#: (verdict, host, path). A rule fits its host and all subdomains, if the url's path starts with the rule's; the longest wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The mass that all seeds of a kind share. Masses are whole numbers, so that sums don't depend on the order of rows; as
#: decimals of 38 digits they can't overflow, for a round never makes more mass than there was.
UNIT = 10**30
#: What a mass is reported in: parts of 10**15.
SHOWN = 10**15
LINK = r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'<>\s]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)


def first_rule(host: Column, path: Column, rules=None) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; one chain of conditions in generated code."""
    out = F.lit(None)
    for verdict, h, p in sorted(RULES if rules is None else rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): each link between two hosts once. Links within a host say nothing about others and are left out."""
    src, _ = host_and_path(F.col(url_col))
    found = pages.select(src.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))).alias("to"))
    return found.select("src", F.translate("to", _UPPER, _LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def _div(a: Column, b: Column) -> Column:
    """a div b of whole decimals: without the remainder the division leaves no fraction to round."""
    return ((a - a % b) / b).cast("decimal(38,0)")


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: int = 85, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) of personalised PageRank along the links, where a step passes ``damping`` percent of a host's mass on to
    the hosts that it links to, in equal parts.

    seeds: (host, kind 't' or 'd'). Trust starts at the trusted seeds, which share one unit, and follows the links; it is the
    rank that they give a host. Distrust is told the other way round: how much of a walk from the host itself ends at
    blocked seeds, a step counting ``damping`` percent of the one before. It is gathered against the links, from each host
    to those that link to it, by the share of their links: of 200 links one to a blocked seed makes 0.85 / 200, and a
    blocked seed has 1 or more. Rounds go on until at most ``tolerance`` of the trust is moving and no host would get
    ``tolerance`` of distrust in one (86 rounds at most with 85 %). Both kinds go in one graph; a round is one join on (kind,
    host) and one sum, written down in the shared folder. Figures are whole parts of 10**15.
    """
    whole = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    degree = edges.groupBy("src").agg(F.count("*").cast("decimal(20,0)").alias("degree"))
    linked = edges.join(degree, "src")
    graph = settle(linked.select(F.lit("t").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "degree").unionByName(linked.select(F.lit("d").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "degree")))
    many = {r["kind"]: r["n"] for r in seeds.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    now = settle(seeds.select("kind", "host", F.when(F.col("kind") == "t", whole(UNIT // many.get("t", 1))).otherwise(whole(UNIT)).alias("mass")))
    total, live = now, [] if graph.isEmpty() else sorted(many)
    while live:
        sent = _div(F.col("mass") * whole(damping), F.col("degree") * whole(100)).alias("mass")
        moved = graph.join(now.where(F.col("kind").isin(live)), ["kind", "host"]).select("kind", F.col("to").alias("host"), sent)
        now = settle(moved.where("mass > 0").groupBy("kind", "host").agg(F.sum("mass").cast("decimal(38,0)").alias("mass")))
        total = total.unionByName(now)
        sums = F.sum(F.when(F.col("kind") == "t", F.col("mass"))).cast("decimal(38,0)")
        moving = {r["kind"]: r["s"] if r["kind"] == "t" else r["m"] for r in now.groupBy("kind").agg(sums.alias("s"), F.max("mass").alias("m")).collect()}
        live = [k for k in live if moving.get(k, 0) > int(tolerance * SHOWN) * (UNIT // SHOWN)]
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(whole(0))).cast("decimal(38,0)")
    trust = _div(of("t") * whole(100 - damping), whole(100 * (UNIT // SHOWN))).cast("long")
    return total.groupBy("host").agg(trust.alias("trust"), _div(of("d"), whole(UNIT // SHOWN)).cast("long").alias("distrust"))


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=None, damping: int = 85, tolerance: float = 1e-6, threshold: float = 0.1) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), a row for each row of pages.

    A rule's verdict stands. Other pages go by their host: it is blocked if its distrust is ``threshold`` or more, about one of
    its links in ten, unless its trust is at least the mean of the hosts that have any. Both figures are the host's own shares
    with fixed bounds, so neither a far seed nor where the rounds end decides. A host is a trusted
    (blocked) seed if more of its pages meet an allowing (blocking) rule than the other kind. Null urls, and those without
    ://, have the empty host, which takes no part and is allowed; null html has no links. Repeated rows stay. An empty
    table gives no rows. Pages of any length are read for links in one pass, whatever many there are; columns of pages beside the
    three aren't looked at, whatever their names. The pages are joined with one row a host; a host with a third of all pages
    is a skewed join, which Spark splits.
    """
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    base = base.withColumn("hit", first_rule(F.col("host"), F.col("path"), rules))
    count = lambda v: F.sum(F.when(F.col("hit.verdict") == v, 1).otherwise(0))
    hosts = base.where("host <> ''").groupBy("host").agg(count("allow").alias("a"), count("block").alias("b"))
    seeds = hosts.where("a <> b").select("host", F.when(F.col("a") > F.col("b"), "t").otherwise("d").alias("kind"))
    mass = settle(propagate(host_edges(pages, url_col=url_col, html_col=html_col), seeds, damping=damping, tolerance=tolerance))
    mean = mass.where("trust > 0").agg(F.expr("sum(trust) div count(*)")).first()[0]
    out = base.join(mass, "host", "left").na.fill(0, ["trust", "distrust"])
    trusted = F.lit(False) if mean is None else F.col("trust") >= F.lit(mean)
    method = F.when((F.col("distrust") >= F.lit(int(threshold * SHOWN))) & ~trusted, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "trust", "distrust")


#: The same in DuckDB's SQL, for the rules and parameters above.
SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, html, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), b AS (
  SELECT page_id, html, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM b
), v AS (
  SELECT *, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' END AS said FROM j
), seeds AS (
  SELECT host, CASE WHEN count(*) FILTER (said = 'allow') > count(*) FILTER (said = 'block') THEN 't' ELSE 'd' END AS kind
  FROM v WHERE host <> '' GROUP BY host HAVING count(*) FILTER (said = 'allow') <> count(*) FILTER (said = 'block')
), l AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?(?:https?:)?//([^/?#"''<>\s]+)', 1)) AS dst FROM v
), e AS (
  SELECT DISTINCT src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM l
), k AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM e WHERE src <> '' AND dst <> '' AND src <> dst
), w AS (SELECT 't' AS kind, src AS host, dst AS "to", degree FROM k UNION ALL SELECT 'd', dst, src, degree FROM k
), m AS (
  SELECT kind, host, CASE kind WHEN 't' THEN CAST(1000000000000000000000000000000 AS HUGEINT) // count(*) OVER (PARTITION BY kind) ELSE CAST(1000000000000000000000000000000 AS HUGEINT) END AS mass, CAST(1000000000000000000000000000000 AS HUGEINT) AS moving FROM seeds
  UNION ALL
  SELECT kind, host, mass, CASE kind WHEN 't' THEN CAST(sum(mass) OVER (PARTITION BY kind) AS HUGEINT) ELSE max(mass) OVER (PARTITION BY kind) END FROM (
    SELECT w.kind, w."to" AS host, CAST(sum(m.mass * 85 // (100 * w.degree)) AS HUGEINT) AS mass
    FROM m JOIN w ON m.kind = w.kind AND m.host = w.host WHERE m.moving > 1000000000000000000000000 AND m.mass * 85 // (100 * w.degree) > 0 GROUP BY w.kind, w."to")
), t AS (
  SELECT host, CAST(sum(CASE WHEN kind = 't' THEN mass ELSE 0 END) * 15 // 100000000000000000 AS BIGINT) AS trust, CAST(sum(CASE WHEN kind = 'd' THEN mass ELSE 0 END) // 1000000000000000 AS BIGINT) AS distrust FROM m GROUP BY host
), n AS (SELECT sum(trust) // count(*) AS mean FROM t WHERE trust > 0)
SELECT page_id, v.host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) >= 100000000000000 AND NOT coalesce(coalesce(trust, 0) >= (SELECT mean FROM n), false) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM v LEFT JOIN t ON v.host = t.host
"""
