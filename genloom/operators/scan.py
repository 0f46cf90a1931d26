"""Running values along ordered rows of a key, whatever the size of a key.

A window has one task a key. Here, keys of more than `PIECE_ROWS` rows are cut into ordered pieces by ranges of (key, order), so
ties in a place are cut, too. Each piece runs as a window of its own and leaves one row of carry: its last and first values,
sums and maxima. The carries of a key compose (a window over one row for each piece), and what comes from the pieces before or
after a piece is joined to its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import store

PIECE_ROWS = 1_000_000
MOST_BROADCAST = 1_000_000


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(Column.__and__, [a[c].eqNullSafe(b[f"_{c}"]) for c in columns])


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    tops: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds, for the rows of each key in the order of `order` (which has no ties): `before`, the last value that isn't null in the
    rows before a row; `after`, the first in the rows after it; `sums`, the sum up to and with the row; `tops`, the largest in the
    rows before it."""
    kinds = {"before": before or {}, "after": after or {}, "sums": sums or {}, "tops": tops or {}}
    values = {name: c for group in kinds.values() for name, c in group.items()}
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PIECE_ROWS)
    large = store(large.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n"))
    n = large.agg(F.sum("_n")).first()[0]
    if n is None:
        return _windows(df, keys, order, kinds)
    large = F.broadcast(large.drop("_n"))  # one row for PIECE_ROWS rows at most
    cut = df.join(large, _same(df, large, keys), "left_semi").repartitionByRange(-(-2 * n // PIECE_ROWS), *keys, *order)
    cut = store(cut.withColumn("_scan_piece", F.spark_partition_id()))
    rest = df.join(large, _same(df, large, keys), "left_anti").withColumn("_scan_piece", F.lit(-1))
    local = _windows(cut.unionByName(rest), [*keys, "_scan_piece"], order, kinds)
    place = F.struct(*order)
    told = lambda c, f: f(F.when(c.isNotNull(), c), F.when(c.isNotNull(), place))
    carry = cut.groupBy(*keys, "_scan_piece").agg(
        *[told(c, F.max_by).alias(name) for name, c in kinds["before"].items()], *[told(c, F.min_by).alias(name) for name, c in kinds["after"].items()],
        *[F.sum(c).alias(name) for name, c in kinds["sums"].items()], *[F.max(c).alias(name) for name, c in kinds["tops"].items()], F.count(F.lit(1)).alias("_rows"),
    )
    line = W.partitionBy(*keys).orderBy("_scan_piece")
    past, coming = line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(1, W.unboundedFollowing)
    moved = {name: F.last(name, ignorenulls=True).over(past) for name in kinds["before"]} | {name: F.first(name, ignorenulls=True).over(coming) for name in kinds["after"]}
    moved |= {name: F.sum(name).over(past) for name in kinds["sums"]} | {name: F.max(name).over(past) for name in kinds["tops"]}
    carry = store(carry.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_scan_piece").alias("__scan_piece"), *[c.alias(f"_carry_{name}") for name, c in moved.items()]))
    carry = F.broadcast(carry) if carry.count() <= MOST_BROADCAST else carry
    joined = local.join(carry, _same(local, carry, [*keys, "_scan_piece"]), "left")
    merged = {}
    for name in values:
        here, come = F.col(name), F.col(f"_carry_{name}")
        if name in kinds["sums"]:
            merged[name] = F.when(here.isNull(), come).otherwise(here + F.coalesce(come, F.lit(0)))
        elif name in kinds["tops"]:
            merged[name] = F.greatest(here, come) if not _is_struct(local, name) else F.when(here.isNull() | (come > here), come).otherwise(here)
        else:
            merged[name] = F.coalesce(here, come)
    return joined.select(*df.columns, *[c.alias(name) for name, c in merged.items()])


def _is_struct(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "struct"


def _windows(df: DataFrame, keys: list[str], order: list[str], kinds: dict[str, dict[str, Column]]) -> DataFrame:
    line = W.partitionBy(*keys).orderBy(*order)
    past, coming, upto = line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(1, W.unboundedFollowing), line.rowsBetween(W.unboundedPreceding, 0)
    added = {name: F.last(c, ignorenulls=True).over(past) for name, c in kinds["before"].items()} | {name: F.first(c, ignorenulls=True).over(coming) for name, c in kinds["after"].items()}
    added |= {name: F.sum(c).over(upto) for name, c in kinds["sums"].items()} | {name: F.max(c).over(past) for name, c in kinds["tops"].items()}
    return df.select(*df.columns, *[c.alias(name) for name, c in added.items()])
