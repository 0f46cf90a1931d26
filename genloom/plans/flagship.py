"""The genome flow in small, on events: neighbours, islands, merging, statistics, filter, score, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import ordered, summary, tags
from .ordered_queries import EVENTS, HOUR, event_runs, events

CLASS = {"purchase": "kripp", "signup": "transporter", "click": "regulator", "view": "peptidase"}


def seed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' clusters of events (gap up to eight hours) around errors, with at least three events and a mean value up to
    60, scored by their classes; the three best of each user."""
    placed = ordered.runs(events(spark, sf_dir), ["user_id"], "sec", "sec", "event_id", 8 * HOUR)
    seed = F.col("event_type") == "error"
    rows = placed.groupBy("user_id", "run").agg(
        F.count(F.lit(1)).alias("n_core"), F.count_if(seed).alias("n_seeds"), F.min("sec").alias("first_at"), F.max("sec").alias("last_at"), F.round(F.avg(F.col("value") / 100), 6).alias("cog_avg"),
        *[F.count_if(F.col("event_type") == t).alias(c) for t, c in CLASS.items()],
    )
    kept = rows.where(P.where(n_core=P.Min(3), n_seeds=P.Min(1), cog_avg=P.Max(0.6)))
    base = tags.base_score({c: F.col(c) for c in tags.CLASS_ORDER if c in CLASS.values()})
    scored = kept.withColumn("score", F.round(tags.cluster_score(base, F.col("n_seeds"), F.col("cog_avg")), 4))
    best = summary.top_k(scored, ["user_id"], [F.col("score").desc(), F.col("run")], 3)
    return best.select("user_id", "rank", "run", "n_core", "n_seeds", "first_at", "last_at", "cog_avg", "score")


SEED_CLUSTERS = f"""WITH {EVENTS}, {event_runs("x", "e", "run", 8 * HOUR, False)},
g AS (SELECT user_id, run, count(*) AS n_core, count(*) FILTER (event_type = 'error') AS n_seeds, min(sec) AS first_at, max(sec) AS last_at, round(avg(value / 100), 6) AS cog_avg,
  count(*) FILTER (event_type = 'purchase') AS k, count(*) FILTER (event_type = 'signup') AS t, count(*) FILTER (event_type = 'click') AS r, count(*) FILTER (event_type = 'view') AS p FROM x GROUP BY ALL),
s AS (SELECT *, round((k + t + r + p + CASE WHEN t > 1 THEN 5 ELSE 0 END + CASE WHEN r > 1 THEN 3 ELSE 0 END + CASE WHEN p > 1 THEN 3 ELSE 0 END) * n_seeds / CASE WHEN cog_avg = 0 THEN 1 ELSE cog_avg END, 4) AS score
  FROM g WHERE n_core >= 3 AND n_seeds >= 1 AND cog_avg <= 0.6),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, run)::INT AS rank FROM s)
SELECT user_id, rank, run, n_core, n_seeds, first_at, last_at, cog_avg, score FROM o WHERE rank <= 3"""

QUERIES = {"seed_clusters": (seed_clusters, SEED_CLUSTERS)}
