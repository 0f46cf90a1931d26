"""Connected components by alternating large-star and small-star rounds, each half written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node of each node's component; edges: a, b. Nodes without edges don't appear."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    mark = None
    for _ in range(most_rounds):
        # large star: neighbours above a node are tied to the smallest node around it
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        e = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "cc-edges")
        # small star: a node and its neighbours below are tied to the smallest of them
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        down = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(down.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "cc-edges")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
