"""Overlap, containment and strand-wise neighbours of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def meeting(left: DataFrame, right: DataFrame, keys: list[str], of_left: tuple[str, str], of_right: tuple[str, str]) -> DataFrame:
    """Rows of both sides with equal keys whose intervals (closed) share a place, each pair once. Their columns must differ but for
    the keys.

    An interval's level is the power of two above its length, so at its own level and above it lies in two cells at most. Each
    pair meets at the level of its longer interval: the longer ones take their own cells, the others one or two cells at every
    level that occurs above them. A long interval is two rows, whatever it covers; a short one two for each level."""
    lo = lambda c: F.col(c[0]).cast("long")
    hi = lambda c: F.greatest(F.col(c[0]), F.col(c[1])).cast("long")
    level = lambda c: F.when(hi(c) > lo(c), F.length(F.bin(hi(c) - lo(c)))).otherwise(0)
    cell = lambda x, at: F.call_function("shiftright", x, at)
    levels = lambda df, c: sorted(r[0] for r in df.select(level(c)).distinct().collect() if r[0] is not None)  # noqa: E731  64 at most

    def own(df: DataFrame, c: tuple[str, str]) -> DataFrame:
        return df.withColumn("_level", level(c)).withColumn("_cell", F.explode(F.sequence(cell(lo(c), F.col("_level")), cell(hi(c), F.col("_level")))))

    def above(df: DataFrame, c: tuple[str, str], others: list[int], strictly: bool) -> DataFrame:
        higher = F.filter(F.array(*[F.lit(x) for x in others]) if others else F.array().cast("array<int>"), lambda x: x > level(c) if strictly else x >= level(c))
        return df.withColumn("_level", F.explode(higher)).withColumn("_cell", F.explode(F.sequence(cell(lo(c), F.col("_level")), cell(hi(c), F.col("_level")))))

    on = [*keys, "_level", "_cell"]
    pairs = own(left, of_left).join(above(right, of_right, levels(left, of_left), False), on).unionByName(above(left, of_left, levels(right, of_right), True).join(own(right, of_right), on))
    first = F.greatest(cell(lo(of_left), F.col("_level")), cell(lo(of_right), F.col("_level")))
    return pairs.where((F.col("_cell") == first) & (lo(of_left) <= hi(of_right)) & (lo(of_right) <= hi(of_left))).drop("_level", "_cell")


def overlaps(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster_id, ext_id, kind, fraction). inner: keys, cluster_id, start, end; outer: keys, ext_id, ext_start,
    ext_end. `total` where the outer interval covers the inner one, else `partial` where it crosses exactly one of its
    boundaries strictly; one strictly inside gives no row."""
    inner, outer = inner.select(*keys, "cluster_id", "start", "end"), outer.select(*keys, "ext_id", "ext_start", "ext_end")
    pairs = meeting(inner, outer, keys, ("start", "end"), ("ext_start", "ext_end")).where((F.col("ext_start") < F.col("end")) & (F.col("ext_end") > F.col("start")))
    covers = (F.col("ext_start") <= F.col("start")) & (F.col("ext_end") >= F.col("end"))
    left = (F.col("ext_start") < F.col("start")) & (F.col("ext_end") < F.col("end"))
    right = (F.col("ext_start") > F.col("start")) & (F.col("ext_end") > F.col("end"))
    length = F.col("end") - F.col("start")
    kind = F.when(covers, "total").when(left | right, "partial")
    share = F.when(~covers & left, (F.col("ext_end") - F.col("start")) / length).when(~covers & right, (F.col("end") - F.col("ext_start")) / length)
    return pairs.withColumn("kind", kind).where("kind is not null").select(*keys, "cluster_id", "ext_id", "kind", share.cast("double").alias("fraction"))


def with_contig_fallback(external: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """External rows with their scaffold: contig = scaffold, or the scaffold's name without its version."""
    exact = external.join(scaffolds.select("genome_id", "scaffold_id"), (external.contig == scaffolds.scaffold_id) & (external.genome_id == scaffolds.genome_id), "left").select(external["*"], "scaffold_id")
    short = scaffolds.select(F.col("genome_id").alias("_g"), F.col("scaffold_id").alias("_s"), F.regexp_replace("scaffold_id", r"\.[^.]*$", "").alias("_short")).dropDuplicates(["_g", "_short"])
    found = exact.join(short, (F.col("contig") == F.col("_short")) & (F.col("genome_id") == F.col("_g")), "left")
    return found.withColumn("scaffold_id", F.coalesce("scaffold_id", "_s")).drop("_g", "_s", "_short").where("scaffold_id is not null")


def drop_contained(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows without a longer row that shares their start or their end within the keys."""
    ends, starts = W.partitionBy(*keys, start), W.partitionBy(*keys, end)
    out = df.withColumn("_longest", F.max(end).over(ends)).withColumn("_first", F.min(start).over(starts))
    return out.where((F.col(end) >= F.col("_longest")) & (F.col(start) <= F.col("_first"))).drop("_longest", "_first")
