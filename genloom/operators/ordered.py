"""Operators on rows that are ordered intervals within a partition: neighbours, runs, islands, merging, extension.

Each is one sort within its keys, as a window or, for keys of very many rows, over ordered pieces of them (`scan`).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import scan


def flanks(df: DataFrame, keys: list[str], start: str, end: str, row_id: str, skip: Column | None = None) -> DataFrame:
    """Adds left_id, left_dist, right_id, right_dist: the nearest rows on either side that `skip` doesn't flag.

    Flagged rows get neighbours too, but never are one."""
    counts = F.lit(True) if skip is None else ~F.coalesce(skip, F.lit(False))
    here = F.when(counts, F.struct(F.col(row_id).alias("id"), F.col(start).alias("s"), F.col(end).alias("e")))
    out = scan(df, keys, [start, row_id], before={"_left": here}, after={"_right": here})
    return out.select(
        *df.columns, F.col("_left.id").alias("left_id"), (F.col(start) - F.col("_left.e")).alias("left_dist"), F.col("_right.id").alias("right_id"), (F.col("_right.s") - F.col(end)).alias("right_dist")
    )


def runs(df: DataFrame, keys: list[str], start: str, end: str, row_id: str, gap, same: Iterable[str] = (), name: str = "run") -> DataFrame:
    """Adds `name`: the number, within the keys, of the row's run. A run breaks where the gap to the previous row's end
    exceeds `gap`, or a column of `same` changes."""
    same = list(same)
    marked = scan(df, keys, [start, row_id], before={"_last": F.struct(F.col(end).alias("e"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(same)])})
    broken = F.col("_last.e").isNull() | (F.col(start) - F.col("_last.e") > gap)
    for i, c in enumerate(same):
        broken = broken | ~F.col(f"_last.c{i}").eqNullSafe(F.col(c))
    return scan(marked.withColumn("_break", broken.cast("int")).drop("_last"), keys, [start, row_id], sums={name: F.col("_break")}).drop("_break")


def seeded(df: DataFrame, keys: list[str], seed: Column) -> DataFrame:
    """The rows of groups (by `keys`) that hold a seed."""
    return df.withColumn("_seeds", F.max(F.coalesce(seed, F.lit(False)).cast("int")).over(W.partitionBy(*keys))).where("_seeds = 1").drop("_seeds")


def two_level_islands(df: DataFrame, keys: list[str], start: str, end: str, row_id: str, inner_gap, outer_gap, same: Iterable[str] = ()) -> DataFrame:
    """Adds `island` (gaps up to inner_gap) and `region` (islands with gaps up to outer_gap)."""
    same = list(same)
    return runs(runs(df, keys, start, end, row_id, inner_gap, same, "island"), keys, start, end, row_id, outer_gap, same, "region")


def islands_of(df: DataFrame, keys: list[str], start: str, end: str, group: list[str]) -> DataFrame:
    """One row for each island: its group columns, i_start, i_end and n."""
    return df.groupBy(*keys, *group).agg(F.min(start).alias("i_start"), F.max(end).alias("i_end"), F.count(F.lit(1)).alias("n"))


def merge_lone(islands: DataFrame, keys: list[str], region: str = "region", island: str = "island") -> DataFrame:
    """Adds `merged`: the island that an island of one row joins (the nearer neighbour in its region; a tie goes left),
    or its own."""
    out = scan(islands, [*keys, region], ["i_start", island], before={"_b": F.struct("i_end", island)}, after={"_a": F.struct("i_start", island)})
    out = out.withColumn("_left", F.col("i_start") - F.col("_b.i_end")).withColumn("_right", F.col("_a.i_start") - F.col("i_end")).withColumn("_prev", F.col("_b")[island]).withColumn("_next", F.col("_a")[island])
    joins = F.when((F.col("n") > 1) | (F.col("_left").isNull() & F.col("_right").isNull()), F.col(island))
    joins = joins.when(F.col("_right").isNull() | (F.col("_left") <= F.col("_right")), F.col("_prev")).otherwise(F.col("_next"))
    return out.withColumn("merged", joins).drop("_left", "_right", "_prev", "_next", "_a", "_b")


def coalesce_intervals(df: DataFrame, keys: list[str], start: str, end: str, row_id: str, gap) -> DataFrame:
    """Adds `merged`: the number of the row's merged interval. A row starts a new one if it begins more than `gap` after
    the end of the row before it by start (not the largest end so far)."""
    out = scan(df, keys, [start, row_id], before={"_before": F.struct(F.col(end).alias("e"))})
    out = out.withColumn("_new", (F.col("_before").isNull() | (F.col(start) - F.col("_before.e") > gap)).cast("int")).drop("_before")
    return scan(out, keys, [start, row_id], sums={"merged": F.col("_new")}).drop("_new")


def extend(df: DataFrame, keys: list[str], start: str, row_id: str, group: str, by: int = 5) -> DataFrame:
    """(keys, group, row_id, ord, is_core): each group's rows and up to `by` rows before its first and after its last, by
    place within the keys. df: all rows; `group` is null for rows in none. The places wanted are listed, so the join is
    by equality."""
    placed = scan(df, keys, [start, row_id], sums={"_place": F.lit(1).cast("long")})
    spans = placed.where(F.col(group).isNotNull()).groupBy(*keys, group).agg(F.min("_place").alias("lo"), F.max("_place").alias("hi"))
    wanted = spans.select(*keys, group, "lo", "hi", F.explode(F.sequence(F.greatest(F.col("lo") - by, F.lit(1)), F.col("hi") + by)).alias("_place"))
    found = wanted.join(placed.drop(group), [*keys, "_place"])
    return found.select(*keys, group, row_id, (F.col("_place") - F.col("lo")).alias("ord"), F.col("_place").between(F.col("lo"), F.col("hi")).alias("is_core"))


def numbered(df: DataFrame, key: str, name: str = "place", cells: int = 1024) -> DataFrame:
    """Adds 1, 2, 3, ... by a numeric key without one task sorting all rows: cells of equal width are counted, and each
    cell's rows are numbered after those of the cells before it."""
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if ends["lo"] is None:
        return df.withColumn(name, F.lit(None).cast("long"))
    width = max(1, -(-(int(ends["hi"]) - int(ends["lo"]) + 1) // cells))
    rows = df.withColumn("_cell", F.floor((F.col(key) - F.lit(ends["lo"])) / width).cast("int"))
    counts = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))  # at most `cells` rows
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    at = F.row_number().over(W.partitionBy("_cell").orderBy(key))
    return rows.withColumn("_at", at).join(F.broadcast(starts), "_cell").withColumn(name, F.col("_start") + F.col("_at")).drop("_cell", "_at", "_start")


def even_parts(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Adds `part`: rows dealt in turn by the order of a numeric key."""
    return numbered(df, key, "_turn").withColumn("part", ((F.col("_turn") - 1) % parts).cast("int")).drop("_turn")


def chunks(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Adds `part`: contiguous stretches by the order of a numeric key, sizes at most one apart."""
    n = df.count()
    return numbered(df, key, "_turn").withColumn("part", F.floor((F.col("_turn") - 1) * parts / F.lit(max(n, 1))).cast("int")).drop("_turn")


def seeded_part(seed: int, key: str) -> Column:
    """An order that a seed gives: for random even partitions."""
    return F.xxhash64(F.lit(seed), F.col(key))
