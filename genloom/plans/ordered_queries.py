"""Queries of ordered operators: events of a user are intervals of no length, ship ranges of orders are intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, ordered, sequential, summary

HOUR = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column):
    """Whole seconds of a timestamp without zone."""
    return F.unix_timestamp(column.cast("timestamp")).cast("long")


def days(column):
    return F.datediff(column.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds(F.col("ts")).alias("sec"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship ranges: o_custkey, o_orderkey, start, end (days)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(days(F.min("l_shipdate")).alias("start"), days(F.max("l_shipdate")).alias("end"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", days(F.col("o_orderdate")).alias("ordered"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("o_custkey", "o_orderkey", "ordered", "start", "end")


EVENTS = "e AS (SELECT event_id, user_id, event_type, value, floor(epoch(ts))::BIGINT AS sec FROM events)"
RANGES = """r AS (SELECT o_custkey, o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS ordered, s AS "start", e AS "end" FROM orders JOIN
  (SELECT l_orderkey, (min(l_shipdate)::DATE - DATE '1970-01-01')::BIGINT AS s, (max(l_shipdate)::DATE - DATE '1970-01-01')::BIGINT AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def flank_neighbors(spark, sf_dir):
    out = ordered.flanks(events(spark, sf_dir), ["user_id"], "sec", "sec", "event_id", F.col("event_type") == "error")
    return out.select("event_id", "user_id", "left_id", "left_dist", "right_id", "right_dist")


FLANK_NEIGHBORS = f"""WITH {EVENTS}, w AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_id END AS id, CASE WHEN event_type <> 'error' THEN sec END AS t FROM e)
SELECT event_id, user_id, last_value(id IGNORE NULLS) OVER l AS left_id, sec - last_value(t IGNORE NULLS) OVER l AS left_dist,
  first_value(id IGNORE NULLS) OVER r AS right_id, first_value(t IGNORE NULLS) OVER r - sec AS right_dist FROM w
WINDOW l AS (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  r AS (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""

RUNS = """{name} AS (SELECT *, sum(b) OVER (PARTITION BY {keys} ORDER BY {at}, {id} ROWS UNBOUNDED PRECEDING)::BIGINT AS {run} FROM
  (SELECT *, CASE WHEN {end_} IS NULL OR {at} - {end_} > {gap}{same} THEN 1 ELSE 0 END AS b FROM
    (SELECT *, lag(sec) OVER (PARTITION BY {keys} ORDER BY {at}, {id}) AS p, lag(event_type) OVER (PARTITION BY {keys} ORDER BY {at}, {id}) AS pt FROM {source})))"""


def event_runs(name: str, source: str, run: str, gap: int, typed: bool) -> str:
    return RUNS.format(name=name, source=source, run=run, gap=gap, keys="user_id", at="sec", id="event_id", end_="p", same=" OR pt IS DISTINCT FROM event_type" if typed else "")


def run_growth(spark, sf_dir):
    """Runs of events (gap up to six hours, one type) that hold a seed: an event worth 90 or more."""
    placed = ordered.runs(events(spark, sf_dir), ["user_id"], "sec", "sec", "event_id", 6 * HOUR, ["event_type"])
    grown = ordered.seeded(placed, ["user_id", "run"], F.col("value") >= 90)
    return grown.groupBy("user_id", "run").agg(F.min("event_id").alias("first_event"), F.min("sec").alias("run_start"), F.max("sec").alias("run_end"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 90).alias("n_seeds"))


RUN_GROWTH = f"""WITH {EVENTS}, {event_runs("x", "e", "run", 6 * HOUR, True)}
SELECT user_id, run, min(event_id) AS first_event, min(sec) AS run_start, max(sec) AS run_end, count(*) AS n, count(*) FILTER (value >= 90) AS n_seeds
FROM x GROUP BY user_id, run HAVING count(*) FILTER (value >= 90) > 0"""


def two_level_islands(spark, sf_dir):
    """Islands of events (gap up to an hour) in regions (up to twelve); lone ones join the nearer neighbour."""
    placed = ordered.two_level_islands(events(spark, sf_dir), ["user_id"], "sec", "sec", "event_id", HOUR, 12 * HOUR)
    islands = ordered.islands_of(placed, ["user_id"], "sec", "sec", ["region", "island"])
    return ordered.merge_lone(islands, ["user_id"]).select("user_id", "region", "island", "i_start", "i_end", "n", "merged")


TWO_LEVEL_ISLANDS = f"""WITH {EVENTS}, {event_runs("x", "e", "island", HOUR, False)},
y AS (SELECT * EXCLUDE (b, p, pt) FROM x), {event_runs("z", "y", "region", 12 * HOUR, False)},
i AS (SELECT user_id, region, island, min(sec) AS i_start, max(sec) AS i_end, count(*) AS n FROM z GROUP BY ALL),
n AS (SELECT *, i_start - lag(i_end) OVER w AS l, lead(i_start) OVER w - i_end AS r, lag(island) OVER w AS pi, lead(island) OVER w AS ni FROM i WINDOW w AS (PARTITION BY user_id, region ORDER BY i_start, island))
SELECT user_id, region, island, i_start, i_end, n, CASE WHEN n > 1 OR (l IS NULL AND r IS NULL) THEN island WHEN r IS NULL OR l <= r THEN pi ELSE ni END AS merged FROM n"""


def interval_coalesce(spark, sf_dir):
    """A customer's ship ranges, merged over gaps up to 50 days."""
    merged = ordered.coalesce_intervals(ranges(spark, sf_dir), ["o_custkey"], "start", "end", "o_orderkey", 50)
    last = F.max(F.struct("start", "o_orderkey", "end"))["end"]
    return merged.groupBy("o_custkey", "merged").agg(F.min("start").alias("first_day"), last.alias("last_day"), F.count(F.lit(1)).alias("n"))


INTERVAL_COALESCE = f"""WITH {RANGES}, b AS (SELECT *, CASE WHEN pe IS NULL OR "start" - pe > 50 THEN 1 ELSE 0 END AS brk FROM
  (SELECT *, lag("end") OVER (PARTITION BY o_custkey ORDER BY "start", o_orderkey) AS pe FROM r)),
m AS (SELECT *, sum(brk) OVER (PARTITION BY o_custkey ORDER BY "start", o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS merged FROM b)
SELECT o_custkey, merged, min("start") AS first_day, arg_max("end", ("start", o_orderkey)) AS last_day, count(*) AS n FROM m GROUP BY ALL"""


def flank_extend(spark, sf_dir):
    """Runs of purchases within two hours, with up to five events on either side."""
    placed = ordered.runs(events(spark, sf_dir), ["user_id"], "sec", "sec", "event_id", 2 * HOUR, ["event_type"])
    grouped = placed.withColumn("grp", F.when(F.col("event_type") == "purchase", F.col("run")))
    return ordered.extend(grouped.select("user_id", "sec", "event_id", "grp"), ["user_id"], "sec", "event_id", "grp", 5).select("user_id", "grp", "event_id", F.col("ord").cast("long").alias("ord"), "is_core")


FLANK_EXTEND = f"""WITH {EVENTS}, {event_runs("x", "e", "run", 2 * HOUR, True)},
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS place FROM x),
g AS (SELECT user_id, run AS grp, min(place) AS lo, max(place) AS hi FROM p WHERE event_type = 'purchase' GROUP BY ALL)
SELECT g.user_id, grp, event_id, place - lo AS ord, place BETWEEN lo AND hi AS is_core FROM g JOIN p ON p.user_id = g.user_id AND place BETWEEN lo - 5 AND hi + 5"""


def interval_overlap(spark, sf_dir):
    """Ship ranges against the 60 days after each of the customer's orders."""
    rows = ranges(spark, sf_dir)
    inner = rows.select("o_custkey", F.col("o_orderkey").alias("cluster_id"), "start", "end")
    outer = rows.select("o_custkey", F.col("o_orderkey").alias("ext_id"), F.col("ordered").alias("ext_start"), (F.col("ordered") + 60).alias("ext_end"))
    out = intervals.overlaps(inner, outer, ["o_custkey"])
    return out.select("o_custkey", "cluster_id", "ext_id", "kind", F.round("fraction", 6).alias("fraction"))


INTERVAL_OVERLAP = f"""WITH {RANGES}, p AS (SELECT i.o_custkey, i.o_orderkey AS cluster_id, o.o_orderkey AS ext_id, i."start" AS s, i."end" AS e, o.ordered AS xs, o.ordered + 60 AS xe FROM r i JOIN r o ON i.o_custkey = o.o_custkey AND o.ordered < i."end" AND o.ordered + 60 > i."start")
SELECT o_custkey, cluster_id, ext_id, CASE WHEN xs <= s AND xe >= e THEN 'total' ELSE 'partial' END AS kind,
  CASE WHEN xs <= s AND xe >= e THEN NULL WHEN xs < s THEN round((xe - s) / (e - s), 6) ELSE round((e - xs) / (e - s), 6) END AS fraction
FROM p WHERE (xs <= s AND xe >= e) OR (xs < s AND xe < e) OR (xs > s AND xe > e)"""


def containment_filter(spark, sf_dir):
    """Ship ranges without a longer one of the customer that shares an end."""
    return intervals.drop_contained(ranges(spark, sf_dir), ["o_custkey"], "start", "end").select("o_custkey", "o_orderkey", F.col("start").alias("first_day"), F.col("end").alias("last_day"))


CONTAINMENT_FILTER = f"""WITH {RANGES} SELECT o_custkey, o_orderkey, "start" AS first_day, "end" AS last_day FROM r WHERE NOT EXISTS
  (SELECT 1 FROM r x WHERE x.o_custkey = r.o_custkey AND ((x."start" = r."start" AND x."end" > r."end") OR (x."end" = r."end" AND x."start" < r."start")))"""


def even_partition(spark, sf_dir):
    """Orders dealt in turn to seven parts."""
    return ordered.even_parts(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 7).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.round(F.sum("o_totalprice"), 2).alias("total"))


EVEN_PARTITION = "SELECT ((n - 1) % 7)::INT AS part, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS total FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1"


def top_hits(spark, sf_dir):
    """The five dearest lines of each supplier, by price, order, part and line."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return summary.top_k(lines, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")], 5)


TOP_HITS = "SELECT * FROM (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 5"


def greedy_intervals(spark, sf_dir):
    """Of each customer's ship ranges, those taken largest first that don't clash with one before."""
    rows = ranges(spark, sf_dir).withColumn("size", F.col("start") - F.col("end"))
    return sequential.greedy_intervals(rows, ["o_custkey"], "start", "end", ["size", "start", "o_orderkey"]).select("o_custkey", "o_orderkey", "start", "end")


GREEDY_INTERVALS = f"""WITH RECURSIVE {RANGES},
o AS (SELECT o_custkey, o_orderkey, "start" AS s, "end" AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY "start" - "end", "start", o_orderkey) AS i FROM r),
g AS (SELECT o_custkey, 0::BIGINT AS i, []::STRUCT(s BIGINT, e BIGINT)[] AS taken, NULL::BIGINT AS kept FROM (SELECT DISTINCT o_custkey FROM o)
  UNION ALL SELECT o_custkey, i, CASE WHEN fits THEN list_append(taken, {{'s': s, 'e': e}}) ELSE taken END, CASE WHEN fits THEN o_orderkey END FROM (
    SELECT o.*, g.taken, len(list_filter(g.taken, lambda t: o.s < t.e AND t.s < o.e AND
      (3 * (CASE WHEN o.s >= t.s THEN t.e - o.s + 1 ELSE o.e - t.s + 1 END) > o.e - o.s + 1 OR 3 * (CASE WHEN o.s >= t.s THEN t.e - o.s + 1 ELSE o.e - t.s + 1 END) > t.e - t.s + 1))) = 0 AS fits
    FROM g JOIN o ON o.o_custkey = g.o_custkey AND o.i = g.i + 1))
SELECT o_custkey, o_orderkey, s AS "start", e AS "end" FROM g JOIN o USING (o_custkey) WHERE kept = o_orderkey"""


def island_fusion(spark, sf_dir):
    """Islands of a user's events (gap up to two hours) fused around those that hold a value of 95 or more, by mean value;
    an event with a value under 10 has no score."""
    placed = ordered.runs(events(spark, sf_dir), ["user_id"], "sec", "sec", "event_id", 2 * HOUR, name="island")
    rows = placed.select("user_id", "island", "sec", "event_id", F.when(F.col("value") >= 10, F.col("value") / 100).alias("score"), (F.col("value") >= 95).alias("seed"))
    return sequential.island_fusion(rows, ["user_id"], "island", "score", "seed", order=["sec", "event_id"])


#: One step of the walk at a time; a side is -1 or 1, `el` and `er` are the sides' edges, `pl` and `pr` their islands that wait.
ISLAND_FUSION = f"""WITH RECURSIVE {EVENTS}, {event_runs("x", "e", "island", 2 * HOUR, False)},
i AS (SELECT user_id, island, count(*) AS n_rows, count(v) AS n, COALESCE(avg(v), 0) AS mean, COALESCE(var_pop(v) * count(v), 0) AS sq, max((value >= 95)::INT) AS seed FROM (SELECT *, CASE WHEN value >= 10 THEN value / 100 END AS v FROM x) GROUP BY ALL),
b AS (SELECT user_id, max(island) AS most FROM i GROUP BY 1),
w AS (SELECT user_id, island AS seed_island, most, island AS el, island AS er, NULL::BIGINT AS pl, NULL::BIGINT AS pr, n, mean, sq, 0::BIGINT AS absorbed, 0 AS failures, -1 AS side, [island] AS got FROM i JOIN b USING (user_id) WHERE seed = 1
  UNION ALL SELECT user_id, seed_island, most,
    CASE WHEN side < 0 AND step IN ('near', 'wait', 'empty') THEN pos ELSE el END, CASE WHEN side > 0 AND step IN ('near', 'wait', 'empty') THEN pos ELSE er END,
    CASE WHEN side < 0 AND step = 'near' THEN NULL WHEN side < 0 AND step = 'wait' THEN pos ELSE pl END, CASE WHEN side > 0 AND step = 'near' THEN NULL WHEN side > 0 AND step = 'wait' THEN pos ELSE pr END,
    CASE WHEN step = 'near' THEN n + m ELSE n END, CASE WHEN step = 'near' THEN mean + (mean2 - mean) * m / (n + m) ELSE mean END, CASE WHEN step = 'near' THEN sq + sq2 + (mean2 - mean) * (mean2 - mean) * n * m / (n + m) ELSE sq END,
    CASE WHEN step = 'near' THEN absorbed + COALESCE(waiting, 0) ELSE absorbed END,
    CASE WHEN step = 'near' THEN 0 WHEN step = 'fail' THEN failures + 1 ELSE failures END, CASE WHEN step = 'fail' THEN -side ELSE side END,
    CASE WHEN step = 'near' AND pending IS NOT NULL THEN list_append(list_append(got, pending), pos) WHEN step IN ('near', 'empty') THEN list_append(got, pos) ELSE got END
  FROM (SELECT w.*, CASE WHEN w.side < 0 THEN w.el ELSE w.er END + w.side AS pos, CASE WHEN w.side < 0 THEN w.pl ELSE w.pr END AS pending, j.n AS m, j.mean AS mean2, j.sq AS sq2, k.n_rows AS waiting,
      CASE WHEN j.island IS NULL THEN 'fail' WHEN j.n = 0 THEN 'empty'
        WHEN w.n = 0 OR abs(w.mean - j.mean) - (CASE WHEN w.n > 1 THEN sqrt(w.sq / w.n) ELSE 0.05 END) - (CASE WHEN j.n > 1 THEN sqrt(j.sq / j.n) ELSE 0.05 END) < 0.1 THEN 'near'
        WHEN w.absorbed < 2 THEN 'wait' ELSE 'fail' END AS step
    FROM w LEFT JOIN i j ON j.user_id = w.user_id AND j.island = CASE WHEN w.side < 0 THEN w.el ELSE w.er END + w.side
      LEFT JOIN i k ON k.user_id = w.user_id AND k.island = CASE WHEN w.side < 0 THEN w.pl ELSE w.pr END
    WHERE w.failures < 2))
SELECT user_id, seed_island, unnest(list_distinct(got)) AS island FROM w WHERE failures = 2"""


def seeded_walks(spark, sf_dir):
    """Runs grown from error events, which are nobody's neighbours, over gaps up to three hours."""
    rows = events(spark, sf_dir).withColumn("strand", F.when(F.col("value") < 70, "+").otherwise("-")).withColumn("seed", F.col("event_type") == "error")
    return sequential.legacy_walk(rows, ["user_id"], "sec", "sec", "event_id", "strand", "seed", "seed", 3 * HOUR)


#: Steps from row to row, as a walk takes them: left from the seed, then right from the leftmost row.
SEEDED_WALKS = f"""WITH RECURSIVE {EVENTS},
o AS (SELECT *, value < 70 AS plus, event_type = 'error' AS seed, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS i FROM e),
p AS (SELECT *, max(CASE WHEN NOT seed THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, min(CASE WHEN NOT seed THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM o),
n AS (SELECT p.user_id, p.i, CASE WHEN p.sec - a.sec <= {3 * HOUR} AND p.plus = a.plus THEN p.l END AS l, CASE WHEN b.sec - p.sec <= {3 * HOUR} AND p.plus = b.plus THEN p.r END AS r
  FROM p LEFT JOIN o a ON a.user_id = p.user_id AND a.i = p.l LEFT JOIN o b ON b.user_id = p.user_id AND b.i = p.r),
wl AS (SELECT user_id, i AS s, i AS pos FROM o WHERE seed UNION ALL SELECT wl.user_id, s, n.l FROM wl JOIN n ON n.user_id = wl.user_id AND n.i = wl.pos WHERE n.l IS NOT NULL),
wr AS (SELECT user_id, s, min(pos) AS pos FROM wl GROUP BY ALL UNION ALL SELECT wr.user_id, s, n.r FROM wr JOIN n ON n.user_id = wr.user_id AND n.i = wr.pos WHERE n.r IS NOT NULL)
SELECT DISTINCT g.user_id, q.event_id AS seed_id, t.event_id FROM (SELECT * FROM wl UNION ALL SELECT * FROM wr) g JOIN o q ON q.user_id = g.user_id AND q.i = g.s JOIN o t ON t.user_id = g.user_id AND t.i = g.pos"""


QUERIES = {
    "flank_neighbors": (flank_neighbors, FLANK_NEIGHBORS), "run_growth": (run_growth, RUN_GROWTH), "two_level_islands": (two_level_islands, TWO_LEVEL_ISLANDS),
    "interval_coalesce": (interval_coalesce, INTERVAL_COALESCE), "flank_extend": (flank_extend, FLANK_EXTEND), "interval_overlap": (interval_overlap, INTERVAL_OVERLAP),
    "containment_filter": (containment_filter, CONTAINMENT_FILTER), "even_partition": (even_partition, EVEN_PARTITION), "top_hits": (top_hits, TOP_HITS),
    "greedy_intervals": (greedy_intervals, GREEDY_INTERVALS), "island_fusion": (island_fusion, ISLAND_FUSION), "seeded_walks": (seeded_walks, SEEDED_WALKS),
}
