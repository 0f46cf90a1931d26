"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

Each row is a point (one coordinate per metadata column) with a weight (its bytes). A node of the tree that owes k leaves is
split at the weighted quantile floor(k/2)/k of its widest dimension, until every node owes one leaf, whose bytes are then the
target. Named values (language, source) are coordinates by their rank among the distinct ones, which are counted first; lengths
by their logarithm. A node's dimension is the one over which its rows span the largest share of the table's range.

Quantiles are found by histograms over packed keys (coordinate, then a hash), refined around the boundary cell. The nodes of a
level are a small table that is joined to the rows, so they share each pass, no pass moves rows, and the driver sees one row
for each node. Rows with equal coordinates are told apart by the hash, and rows that are equal throughout by their number
(which follows the layout of the files), so a value or a group of copies of any size can be cut anywhere: a group of equal
texts may be spread over shards, as shards of equal size can't hold a group that is larger than they are.

Defined results: a null text has 0 bytes and CRC 0; null metadata sort first; rows that repeat are placed one by one; an empty
table gives an empty result; other columns are ignored. A shard's size differs from the target by about one row or
`tolerance`, whichever is more, for each split above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, materialize, shuffle_partitions

COORD_BITS, HASH_BITS, CELLS = 20, 42, 1024
TIE_BITS = 62
SLOT_ROWS = 20_000
#: Rows of a table of distinct values, or of a level's nodes, that is sent to all tasks; a larger one is joined by a shuffle.
MOST_VALUES = 200_000


def _log_length(col: Column) -> Column:
    return F.coalesce(F.log1p(F.greatest(col.cast("double"), F.lit(0.0))), F.lit(-1.0))


def document_dimensions(docs: DataFrame) -> dict[str, Column]:
    """Metadata of documents: language and source (strings, ranked by kd_assign) and length."""
    named = {"lang": F.col("lang"), "source": F.col("source"), "n_chars": _log_length(F.col("n_chars"))}
    return {c: x for c, x in named.items() if c in docs.columns}


def _ranks(values: DataFrame) -> DataFrame:
    """value, rank of distinct values, null first: sorted in ranges, each numbered after those before it."""
    order = F.col("value").asc_nulls_first()
    ranges = values.repartitionByRange(shuffle_partitions(values.sparkSession), order).sortWithinPartitions(order)
    placed = materialize(ranges.select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "kd-ranges")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    starts = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select("value", (F.col("start") + F.col("at") + 1).cast("double").alias("rank"))


def _ranked(raw: DataFrame, column: str) -> DataFrame:
    """`raw` with a string column replaced by its value's rank, null first."""
    values = materialize(raw.select(F.col(column).alias("value")).distinct(), "kd-values")
    ranks = broadcast_if(_ranks(values), values.count(), MOST_VALUES)
    return raw.join(ranks, F.col(column).eqNullSafe(F.col("value"))).drop(column, "value").withColumnRenamed("rank", column)


def _points(docs: DataFrame, dims: dict[str, Column], weight: Column) -> tuple[DataFrame, list[str]]:
    """One slim row for each row: doc_id, size, text_crc32, tie, and a packed key for each dimension."""
    crc = F.coalesce(F.crc32("text"), F.lit(0)).cast("long")
    raw = docs.select("doc_id", weight.cast("long").alias("size"), crc.alias("text_crc32"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"), *[c.alias(f"x{i}") for i, c in enumerate(dims.values())])
    raw = materialize(raw, "kd-points")
    for name, kind in raw.dtypes:
        raw = _ranked(raw, name) if kind == "string" and name.startswith("x") else raw
    ends = raw.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    keys = []
    for i in range(len(dims)):
        lo, hi = (ends[f"{n}{i}"] or 0.0 for n in ("lo", "hi"))
        at = F.floor((F.col(f"x{i}") - lo) / ((hi - lo) or 1.0) * ((1 << COORD_BITS) - 1)).cast("long")
        noise = F.xxhash64(F.lit(i), F.col("doc_id"), F.col("text_crc32"), F.col("size")).bitwiseAND((1 << HASH_BITS) - 1)
        keys.append((F.shiftleft(at, HASH_BITS) + noise).alias(f"k{i}"))
    return raw.select("doc_id", "size", "text_crc32", F.col("tie").bitwiseAND((1 << TIE_BITS) - 1).alias("tie"), *keys), [f"k{i}" for i in range(len(dims))]


def _nodes(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a level's nodes, at most as many as shards; sent to all tasks if it is small."""
    return broadcast_if(spark.createDataFrame(rows, schema), len(rows), MOST_VALUES)


def _boundaries(rows: DataFrame, goals: dict[int, float], span: dict[int, tuple[int, int]], slack: float) -> dict[int, tuple[int, float, bool]]:
    """For each node (cut, weight below it, whether one key value holds the goal): refine the cell that holds it.

    rows: node, key, size."""
    spark, out = rows.sparkSession, {}
    under, span = dict.fromkeys(goals, 0.0), dict(span)
    while span:
        width = {n: max(1, -(-(hi - lo + 1) // CELLS)) for n, (lo, hi) in span.items()}
        table = _nodes(spark, [(n, lo, hi, width[n], float(under[n]), float(goals[n])) for n, (lo, hi) in span.items()], "n long, lo long, hi long, width long, under double, goal double")
        inside = rows.join(table, F.col("node") == F.col("n")).where(F.col("key").between(F.col("lo"), F.col("hi")))
        cell = F.expr("(key - lo) div width").alias("cell")
        cells = inside.groupBy("node", "under", "goal", cell).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("c"))
        upto = F.col("under") + F.sum("w").over(W.partitionBy("node").orderBy("cell").rowsBetween(W.unboundedPreceding, 0))  # at most CELLS rows
        met = cells.withColumn("upto", upto).groupBy("node").agg(
            F.min_by(F.struct("cell", "w", "c", (F.col("upto") - F.col("w")).alias("below")), F.when(F.col("upto") >= F.col("goal"), F.col("cell"))).alias("at"), F.max("upto").alias("all")
        )
        found = {r["node"]: r for r in met.collect()}  # a row for each node
        for n, (lo, hi) in list(span.items()):
            at = found[n]["at"] if n in found else None
            if at is None or n not in found:
                out[n] = (hi + 1, float(found[n]["all"]) if n in found else under[n], False)
                del span[n]
                continue
            total, weight = float(at["below"]), float(at["w"])
            start, end = lo + at["cell"] * width[n], lo + (at["cell"] + 1) * width[n]
            under[n] = total
            if weight <= slack or at["c"] == 1:
                nearer = goals[n] - total < total + weight - goals[n]
                out[n] = (start, total, False) if nearer else (end, total + weight, False)
                del span[n]
            elif width[n] == 1:
                out[n] = (start, total, True)
                del span[n]
            else:
                span[n] = (start, min(hi, end - 1))
    return out


def _in_order(values: list[Column], at: Column) -> Column:
    return F.element_at(F.array(*values), at + 1)


def kd_assign(docs: DataFrame, shards: int, dims: dict[str, Column] | None = None, weight: Column | None = None, tolerance: float = 0.0005) -> DataFrame:
    """doc_id, size, text_crc32, tie, shard: `shards` leaves of near equal total weight.

    weight: by default UTF-8 bytes of `text` (null: none) plus 8. tolerance: of a leaf's target, for each split."""
    spark = docs.sparkSession
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + 8 if weight is None else weight
    rows, keys = _points(docs, (document_dimensions(docs) if dims is None else dims) or {"all": F.lit(0.0)}, weight)
    rows = materialize(rows.withColumn("node", F.lit(1).cast("long")), "kd-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    owed, first = {1: shards}, {1: 0}
    slack = max(tolerance * total / shards, 1)
    coordinate = lambda key: key >> HASH_BITS
    while any(k > 1 for k in owed.values()):
        split = [n for n, k in owed.items() if k > 1]
        stats = rows.groupBy("node").agg(F.sum("size").alias("w"), *[f(k).alias(f"{n}_{k}") for k in keys for n, f in (("lo", F.min), ("hi", F.max))]).collect()  # a row for each node
        stat = {r["node"]: r for r in stats if owed[r["node"]] > 1}
        widest = {n: max(range(len(keys)), key=lambda i: (coordinate(r[f"hi_{keys[i]}"]) - coordinate(r[f"lo_{keys[i]}"]), -i)) for n, r in stat.items()}
        goal = {n: float(r["w"]) * (owed[n] // 2) / owed[n] for n, r in stat.items()}
        cuts = {n: (-1, 0, 0) for n in split}  # dimension (-1: no rows), key, tie
        if stat:
            chosen = rows.join(_nodes(spark, list(widest.items()), "n long, dim int"), F.col("node") == F.col("n"))
            chosen = chosen.select("node", _in_order([F.col(k) for k in keys], F.col("dim")).alias("key"), "size", "tie")
            found = _boundaries(chosen, goal, {n: (r[f"lo_{keys[widest[n]]}"], r[f"hi_{keys[widest[n]]}"]) for n, r in stat.items()}, slack)
            same = {n: f for n, f in found.items() if f[2]}  # one key holds the boundary: cut its rows by their numbers
            ties = {}
            if same:
                held = chosen.join(_nodes(spark, [(n, f[0]) for n, f in same.items()], "n long, held long"), (F.col("node") == F.col("n")) & (F.col("key") == F.col("held")))
                ties = _boundaries(held.select("node", F.col("tie").alias("key"), "size"), {n: goal[n] - f[1] for n, f in same.items()}, dict.fromkeys(same, (0, (1 << TIE_BITS) - 1)), slack)
            cuts |= {n: (widest[n], f[0], ties[n][0] if n in ties else 0) for n, f in found.items()}
        # slim rows are written with their node, so that conditions don't nest from level to level
        table = _nodes(spark, [(n, *c) for n, c in cuts.items()], "n long, dim int, cut long, tie_cut long")
        key = _in_order([F.col(k) for k in keys], F.greatest(F.col("dim"), F.lit(0)))
        lower = (key < F.col("cut")) | ((key == F.col("cut")) & (F.col("tie") < F.col("tie_cut")))
        node = F.when(F.col("n").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(lower, 0).otherwise(1))
        rows = materialize(rows.join(table, F.col("node") == F.col("n"), "left").select(*[c for c in rows.columns if c != "node"], node.cast("long").alias("node")), "kd-level")
        for n in split:
            owes = owed.pop(n)
            owed |= {2 * n: owes // 2, 2 * n + 1: owes - owes // 2}
            first |= {2 * n: first[n], 2 * n + 1: first[n] + owes // 2}
    leaves = _nodes(spark, [(n, first[n]) for n in owed], "n long, shard int")
    return rows.join(leaves, F.col("node") == F.col("n")).select("doc_id", "size", "text_crc32", "tie", "shard")


def with_slots(rows: DataFrame, shard: str = "shard", order: str = "tie") -> DataFrame:
    """`slot`: 0, 1, 2, ... within each shard, in the order of a hash. Rows are numbered within hash ranges of about
    SLOT_ROWS rows, and each range starts after the counts of those before it, so no shard is sorted in one task."""
    n = rows.groupBy(shard).count().agg(F.max("count")).first()[0] or 0
    pieces = max(1, -(-n // SLOT_ROWS))
    rows = rows.withColumn("_piece", F.floor(F.col(order) / ((1 << TIE_BITS) / pieces)).cast("int"))
    starts = rows.groupBy(shard, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(shard).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = W.partitionBy(shard, "_piece").orderBy(order, "doc_id")
    return rows.withColumn("_at", F.row_number().over(within) - 1).join(starts, [shard, "_piece"]).withColumn("slot", (F.col("_start") + F.col("_at")).cast("long")).drop("_piece", "_at", "_start")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null: this law doesn't grow by one shard)."""
    placed = with_slots(materialize(kd_assign(docs, shards), "kd-shards"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shards_for(docs: DataFrame, target_bytes: int) -> int:
    """The number of shards at which leaves reach `target_bytes`."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    return max(1, round(total / target_bytes))
