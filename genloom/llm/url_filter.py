"""URL verdicts by rules, and by link-graph propagation where no rule fits.

Hosts are nodes, and links in pages are edges between hosts. Trust is a personalised PageRank from trusted hosts, and distrust
is the same on reversed edges from blocked hosts: who links to a blocked host is distrusted. Seeds are hosts with pages that
the rules decide, weighed by the share of such pages; a seed keeps the part of its score that PageRank's jumps return to it.
Each host has its own threshold, its trust: it is blocked if its distrust is larger. Scores aren't divided by totals and only the
two are compared, so hosts without a path to or from a host don't change its verdict. Rounds go on, however long a chain of links
is, until no host's score still changes by more than a millionth of itself. Links may leave out the scheme (`//host/...`). Everything is DataFrame
operations; one row per pair of hosts is shuffled, whatever the number of links.

Defined results: a null url, or one without `://`, has an empty host and path, no rule fits, and it is allowed; pages that
repeat are judged one by one, and count as often; a host without distrust is allowed, one with equal trust and distrust too;
a seed without links is judged by its own pages' rules: one with blocked pages and no allowed ones is blocked as a whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, materialize

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Links with or without a scheme, and their host.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""
LINK_HOST = r"^[^/]*//([^/?#]*)"
HOST = r"://([^/?#]*)"
EVEN = 1 + 1e-9  # sums that are equal but for the order of adding
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_BROADCAST_HOSTS = 100_000
CUT = 5  # rounds between stored scores
SETTLED = 1e-6


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), UPPER, LOWER)


def linked_host(link: Column) -> Column:
    return F.translate(F.regexp_extract(link, LINK_HOST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    found = F.when(F.lit(False), None)
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        top, _, rest = rule.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + rest)
        found = found.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links between different hosts, counted once for each page and target host."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), linked_host))
    pairs = pages.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst"))
    return pairs.where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, settled: float = SETTLED) -> DataFrame:
    """(host, trust, distrust). edges: src, dst, links; seeds: host, good, bad. What a host gets in a round is what it passes on
    in the next; a score is the sum of all that has come, and rounds end when that is less than `settled` of each sum."""
    out = edges.groupBy("src").agg(F.sum("links").alias("out_links"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("in_links"))
    weighed = materialize(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("links") / F.col("out_links") * damping).alias("forth"), (F.col("links") / F.col("in_links") * damping).alias("back")), "url-edges")
    # a round is one join of what has come with both directions
    sent = weighed.select(F.col("src").alias("sender"), F.col("dst").alias("to"), "forth", F.lit(0.0).alias("back"))
    ways = sent.unionByName(weighed.select(F.col("dst").alias("sender"), F.col("src").alias("to"), F.lit(0.0).alias("forth"), "back"))
    jumps = seeds.where("good > 0 or bad > 0").select("host", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust"))
    score = materialize(jumps, "url-seeds")
    come, moving = score, not weighed.isEmpty()
    summed = lambda df: df.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    while moving:
        held = [score]
        for _ in range(CUT):
            come = summed(come.join(ways, F.col("host") == F.col("sender")).select(F.col("to").alias("host"), (F.col("trust") * F.col("forth")).alias("trust"), (F.col("distrust") * F.col("back")).alias("distrust"))).where("trust > 0 or distrust > 0")
            held.append(come)
        last = F.struct(*(F.coalesce(F.sum(F.when(F.col("round") == CUT, F.col(c))), F.lit(0.0)).alias(c) for c in ("trust", "distrust")))
        rounds = held[0].withColumn("round", F.lit(0))
        for i, part in enumerate(held[1:], 1):
            rounds = rounds.unionByName(part.withColumn("round", F.lit(i)))
        both = materialize(rounds.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"), last.alias("last")), "url-score")
        score, come = both.select("host", "trust", "distrust"), both.select("host", "last.trust", "last.distrust").where("trust > 0 or distrust > 0")
        moving = not both.where((F.col("last.trust") > settled * F.col("trust")) | (F.col("last.distrust") > settled * F.col("distrust"))).isEmpty()
    return score


def judge(pages: DataFrame, rules=RULES, threshold: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict. A host is blocked if distrust > threshold x trust."""
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("by_rule"))
    edges = materialize(host_edges(pages), "url-links")
    share = lambda v: F.avg(F.coalesce((F.col("by_rule") == v).cast("double"), F.lit(0.0)))
    hosts = materialize(judged.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")), "url-hosts")
    scores = propagate(edges, hosts)
    blocked = materialize(scores.where(F.col("distrust") > F.col("trust") * (threshold * EVEN)).select(F.col("host").alias("bad_host")), "url-blocked")
    joined = judged.join(broadcast_if(blocked, blocked.count(), MOST_BROADCAST_HOSTS), F.col("host") == F.col("bad_host"), "left")
    by_method = F.when(F.col("bad_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"))


def _judged_sql(rules) -> str:
    host = f"translate(COALESCE(regexp_extract(url, '{HOST}', 1), ''), '{UPPER}', '{LOWER}')"
    cases = {"rule": "", "by_rule": ""}
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        top, _, rest = rule.partition("/")
        fits = f"(host = '{top}' OR ends_with(host, '.{top}')) AND starts_with(path, '/{rest}')"
        cases["rule"] += f" WHEN {fits} THEN '{rule}'"
        cases["by_rule"] += f" WHEN {fits} THEN '{verdict}'"
    return f"""h AS (SELECT page_id, html, {host} AS host, COALESCE(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
u AS (SELECT *, CASE{cases["rule"]} END AS rule, CASE{cases["by_rule"]} END AS by_rule FROM h)"""


def sql(rules=RULES, damping: float = 0.85, rounds: int = 100, threshold: float = 1.0) -> str:
    """judge() in DuckDB: each round of propagation is a table of its own. `rounds` are as many as the table's longest chains need,
    and enough for the rest to be under a millionth (0.85 ** 85)."""
    link = LINK.replace("'", "''")
    parts = [
        _judged_sql(rules),
        f"l AS (SELECT DISTINCT r, host AS src, translate(regexp_extract(x, '{LINK_HOST}', 1), '{UPPER}', '{LOWER}') AS dst FROM (SELECT row_number() OVER () AS r, host, regexp_extract_all(COALESCE(html, ''), '{link}', 1) AS found FROM u), unnest(found) AS t(x))",
        "e AS (SELECT src, dst, count(*) AS links FROM l WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL)",
        "w AS (SELECT src, dst, links / sum(links) OVER (PARTITION BY src) AS forth, links / sum(links) OVER (PARTITION BY dst) AS back FROM e)",
        "s AS (SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS good, avg(CASE WHEN by_rule = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS bad FROM u WHERE host <> '' GROUP BY 1)",
        f"p0 AS MATERIALIZED (SELECT host, good * {1 - damping} AS t, bad * {1 - damping} AS d FROM s)",
    ]
    for i in range(1, rounds + 1):
        parts.append(
            f"p{i} AS MATERIALIZED (SELECT host, sum(t) AS t, sum(d) AS d FROM (SELECT dst AS host, t * forth * {damping} AS t, 0 AS d FROM w JOIN p{i - 1} ON src = host UNION ALL SELECT src, 0, d * back * {damping} FROM w JOIN p{i - 1} ON dst = host "
            "UNION ALL SELECT host, t, d FROM p0) GROUP BY 1)"
        )
    parts.append(f"b AS (SELECT host AS bad_host FROM p{rounds} WHERE d > {threshold * EVEN!r}::DOUBLE * t)")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, COALESCE(by_rule, CASE WHEN bad_host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN b ON host = bad_host"
