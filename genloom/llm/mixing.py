"""Mixing sources to target weights with hash-threshold histograms.

Tokens are summed by source and hash bucket; a source's remaining budget falls into one bucket, and only that bucket is summed
again by finer hash buckets, until it holds one row. That row is taken if the sum comes nearer to the budget so. A row is then
taken by comparing its hash with its source's threshold: nothing is sorted and no row is moved. Rows are told apart by the hash
of their doc_id; where the boundary falls on several rows with one doc_id, by the hash of their text; and where those are equal
too, by their number, so any part of a group of copies, or of rows without a doc_id, can be taken.

The tables of sources have one row for each source and are ordered in one task (some ten million sources at most).

Defined results: a null text has size 0; a null source is a source of its own, last in the order; a null doc_id is an id like
any; rows that are alike in doc_id, source and text are taken as often in all as they would be if told apart; rows without
words go with the others of their hash; an empty table gives an empty result; columns beside those named are carried along by
mix_documents and ignored by mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, materialize

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 12
MOST_BROADCAST_SOURCES = 200_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key's text: the same in every engine, and on every run."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Column, cap: int, share: float = 1.0) -> DataFrame:
    """(source, source_size) with `target`: the budget by weight, stopped at `cap` x size, the excess reshared.

    Resharing until none is above its cap ends where target = min(cap x size, level x weight); the level is
    found by one ordered pass over the sources (not the rows)."""
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_source)).withColumn("weight", weights).withColumn("capped", F.col("source_size") * cap)
    order = W.orderBy((F.col("capped") / F.col("weight")).asc(), F.col("rank").asc())
    before, all_rows = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    levels = (
        ranked.withColumn("full", F.coalesce(F.sum("capped").over(before), F.lit(0)))
        .withColumn("full_weight", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("place", F.row_number().over(order))
        .withColumn("total", F.sum("source_size").over(all_rows) * F.lit(share))
        .withColumn("all_weight", F.sum("weight").over(all_rows))
        .withColumn("level", (F.col("total") - F.col("full")).cast("double") / (F.col("all_weight") - F.col("full_weight")).cast("double"))
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("capped"), F.col("place"))
    level = F.coalesce(F.min_by("level", fits).over(all_rows), F.lit(float("inf")))
    at = F.when(level * F.col("weight") <= F.col("capped"), level * F.col("weight")).otherwise(F.col("capped").cast("double"))
    return levels.select("source", "source_size", at.alias("target"))


KEYS = ("k0", "k1", "k2")  # hashes of a row's doc_id, of its text, and of its number


def hash_thresholds(rows: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """For each source `copies` (whole passes) and thresholds c0, c1, c2: rows with keys below them are taken once more.

    rows: source, size, k0, k1, k2."""
    state = materialize(
        targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("under", F.lit(0).cast("long"))
        .withColumn("open", F.col("rest") < F.col("source_size"))
        # a source whose rest is its whole size takes all rows
        .select("*", F.when(F.col("open"), F.lit(0)).otherwise(F.lit((1 << HASH_BITS) - 1) + 1).cast("long").alias("c0"), *[F.lit(0).cast("long").alias(c) for c in ("c1", "c2")]),
        "mix-state",
    )
    for level, key in enumerate(KEYS):
        for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
            if state.where("open").isEmpty():
                return state
            now = state.where("open").select(F.col("source").alias("s"), "rest", "prefix", "under", *[F.col(f"c{i}").alias(f"at{i}") for i in range(level)])
            cell = F.shiftright(key, shift)
            inside = (F.shiftright(cell, LEVEL_BITS) == F.col("prefix")) & F.col("source").eqNullSafe(F.col("s"))
            for i in range(level):
                inside &= F.col(KEYS[i]) == F.col(f"at{i}")
            sums = rows.join(broadcast_if(now, n_sources, MOST_BROADCAST_SOURCES), inside).groupBy("s", "rest", "under", cell.alias("cell"))
            sums = sums.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), F.min(key).alias("lo"), F.max(key).alias("hi"))
            run = W.partitionBy("s").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
            sums = sums.withColumn("upto", F.sum("n").over(run) + F.col("under"))
            # the bucket with the first row that exceeds the budget
            first = F.struct("cell", (F.col("upto") - F.col("n")).alias("before"), "n", "rows", "lo", (F.col("lo") < F.col("hi")).alias("many"))
            over = sums.where(F.col("upto") > F.col("rest")).groupBy("s").agg(F.min_by(first, "cell").alias("at"))
            several = F.col("at.rows") > 1
            deeper = F.lit(level < len(KEYS) - 1) & several & ~F.col("at.many")
            nearer = (2 * F.col("at.before") + F.col("at.n") <= 2 * F.col("rest")).cast("long")
            cut = F.when(F.col("at.many"), F.lit(0)).when(deeper, F.col("at.lo")).otherwise(F.col("at.lo") + nearer)
            columns = {
                "prefix": F.when(F.col("at.many"), F.col("at.cell")).otherwise(0),
                "under": F.col("at.before"),
                f"c{level}": cut,
                "open": F.col("at.many") & F.lit(shift > 0) | deeper,
                "level": F.when(deeper, level + 1).otherwise(level),
            }
            state = state if "level" in state.columns else state.withColumn("level", F.lit(0))
            mine = F.col("open") & (F.col("level") == level) & F.col("at").isNotNull()
            joined = state.join(broadcast_if(over, n_sources, MOST_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")), "left")
            state = materialize(joined.select([F.when(mine, columns[c]).otherwise(F.col(c)).cast(dict(state.dtypes)[c]).alias(c) if c in columns else F.col(c) for c in state.columns]), "mix-state")
            if state.where(F.col("open") & (F.col("level") == level)).isEmpty():
                break
    return state


def _keyed(docs: DataFrame, number: Column) -> list[Column]:
    return [mix_hash(F.col("doc_id")).alias("k0"), mix_hash(F.col("text")).alias("k1"), mix_hash(number).alias("k2")]


def mix(docs: DataFrame, cap: int = 3, cycle: tuple[int, ...] = (1, 2, 3), number: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, thresholds). rows: doc_id, source, size, k0, k1, k2; thresholds: see hash_thresholds."""
    keys = _keyed(docs, F.monotonically_increasing_id() if number is None else number)
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keys), "mix-rows")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") - 1) % len(cycle) + 1).cast("long")
    targets = source_targets(sizes, weight, cap)
    n = sizes.count()
    return rows, hash_thresholds(rows, targets, n).withColumn("n_sources", F.lit(n))


def copies_taken() -> Column:
    """How many times the mix takes a row, by its keys and its source's thresholds."""
    k, c = [F.col(x) for x in KEYS], [F.col(f"c{i}") for i in range(3)]
    below = (k[0] < c[0]) | ((k[0] == c[0]) & ((k[1] < c[1]) | ((k[1] == c[1]) & (k[2] < c[2]))))
    return F.col("copies") + below.cast("long")


def mixture(docs: DataFrame, cap: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the row, repeats counted)."""
    rows, cuts = mix(docs, cap, cycle)
    n = cuts.count()
    cuts = cuts.select(F.col("source").alias("s"), "source_size", "target", "copies", "c0", "c1", "c2")
    joined = rows.join(broadcast_if(cuts, n, MOST_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies_taken()).alias("taken"))


def mix_documents(docs: DataFrame, cap: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it (rows without words keep one copy if `cap` allows a whole pass)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    named = docs.select(whole, "doc_id", "source", "text")
    number = F.monotonically_increasing_id()
    _, cuts = mix(named, cap, cycle, number)
    if not cuts.where("c2 > 0").isEmpty():  # copies are told apart by their numbers, which must stay then
        named = materialize(named.withColumn("number", number), "mix-numbered")
        number = F.col("number")
        _, cuts = mix(named, cap, cycle, number)
    n = cuts.count()
    cuts = cuts.select(F.col("source").alias("s"), "copies", "c0", "c1", "c2")
    joined = named.select("doc", "source", *_keyed(named, number)).join(broadcast_if(cuts, n, MOST_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")))
    taken = joined.select("doc", copies_taken().cast("int").alias("times")).where("times > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select([F.col("doc").getField(c).alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
         ('0x' || substr(md5(COALESCE(text, '')), 1, 15))::BIGINT AS x, row_number() OVER () AS row
  FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, ((rank - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS capped FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY capped::DOUBLE / weight, rank) AS place,
        COALESCE(SUM(capped) OVER (ORDER BY capped::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
        COALESCE(SUM(weight) OVER (ORDER BY capped::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_weight,
        SUM(source_size) OVER () AS total, SUM(weight) OVER () AS all_weight FROM w),
l AS (SELECT *, (total - full_)::DOUBLE / (all_weight - full_weight)::DOUBLE AS level FROM o),
f AS (SELECT level FROM l WHERE level * weight <= capped ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN f.level * weight <= capped THEN f.level * weight ELSE capped::DOUBLE END AS target FROM l, f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
c AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS rest,
        SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.x, d.row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
