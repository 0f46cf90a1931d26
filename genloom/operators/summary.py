"""Aggregates and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tags import first_class


def cog_stats(members: DataFrame, keys: list[str], score: str, lone_std: float | None = 0.05) -> DataFrame:
    """(keys, cog_avg, cog_std) over rows that have a score: none gives nulls; one gives lone_std; else population std."""
    n = F.count(score)
    return members.groupBy(*keys).agg(F.avg(score).alias("cog_avg"), F.when(n > 1, F.stddev_pop(score)).when(n == 1, F.lit(lone_std).cast("double")).alias("cog_std"))


def cluster_rows(members: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each cluster from its members (cluster_id, strand, start, end, is_core, svm_hit, cog): core and outer spans,
    counts and score statistics. The end is that of the last member by start."""
    core = F.col("is_core")
    last = lambda w: F.max(F.when(w, F.struct("start", "end")))["end"]
    n = F.count(F.when(core, F.col("cog")))
    return members.groupBy(*keys).agg(
        F.min(F.when(core, F.col("strand"))).alias("strand"), F.min(F.when(core, F.col("start"))).alias("start"), last(core).alias("end"), F.min("start").alias("extra_start"), last(F.lit(True)).alias("extra_end"), F.count_if(core).alias("n_core"),
        F.count_if(core & F.col("svm_hit")).alias("n_precursors"), F.avg(F.when(core, F.col("cog"))).alias("cog_avg"), F.when(n > 1, F.stddev_pop(F.when(core, F.col("cog")))).when(n == 1, F.lit(0.05)).alias("cog_std"),
    )


def group_index(clusters: DataFrame, group: str) -> DataFrame:
    """A report row for each group: sizes, score and cog as mean and population deviation, counts of flags."""
    flag = lambda c: F.count_if(F.col(c)) if c in clusters.columns else F.lit(0)
    return clusters.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 2).alias("score_avg"), F.round(F.stddev_pop("score"), 2).alias("score_std"),
        F.round(F.avg("cog_avg"), 3).alias("cog_avg"), F.round(F.stddev_pop("cog_avg"), 3).alias("cog_std"), flag("is_reference").alias("n_reference"), flag("has_overlap").alias("n_overlap"), flag("has_kripp").alias("n_kripp"),
    )


def or_na(column: Column, places: int = 3) -> Column:
    """A rounded number as text; N/A where it is missing."""
    return F.when(column.isNull(), "N/A").otherwise(F.format_string(f"%.{places}f", F.round(column, places)))


def largest_group(groups: DataFrame, member: str) -> DataFrame:
    """(member, largest, smallest): sizes of the groups that a member is in. groups: group_id, member."""
    sizes = groups.groupBy("group_id").agg(F.countDistinct(member).alias("size"))
    return groups.join(sizes, "group_id").groupBy(member).agg(F.max("size").alias("largest"), F.min("size").alias("smallest"))


def groups_per_member(groups: DataFrame, member: str) -> DataFrame:
    return groups.groupBy(member).agg(F.array_sort(F.collect_set("group_id")).alias("groups"))


def longest_partition(groups: DataFrame) -> DataFrame:
    """The rows of the largest group (the first by name on a tie)."""
    top = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "group_id").limit(1)
    return groups.join(F.broadcast(top.select("group_id")), "group_id", "left_semi")


def histogram(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(keys, bin, n)."""
    at = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(lo, hi)).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def drawing_class(categories: Column, svm_hit: Column) -> Column:
    """The class that a gene is drawn in: seeds first, then its first class."""
    return F.when(svm_hit, "seed").otherwise(F.coalesce(first_class(categories), F.lit("other")))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with `rank`; orders must be total for equal results."""
    from pyspark.sql import Window as W

    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
