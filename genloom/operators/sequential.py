"""Operators whose steps depend on those before.

Spark cuts each key into pieces that no step can cross (walks over runs, hits that overlap, one row for each island), so a task
gets a piece, not a key; only pieces in which an order matters are walked in Python. Seeded walks and set covers are joins.
"""

from __future__ import annotations

import math
import sys
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import meeting
from .scan import scan
from .scratch import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONE_STD, SCORE_GAP, MOST_OUTLIERS = 0.05, 0.1, 2


class _Scores:
    """Count, mean and squared deviations of scores, and how many rows there are with those that have none; two are joined
    without their rows."""

    __slots__ = ("n", "mean", "squares", "rows")

    def __init__(self, scores) -> None:
        self.rows = len(scores)
        scores = [x for x in scores if x is not None and x == x]
        self.n = len(scores)
        self.mean = float(np.mean(scores)) if self.n else 0.0
        self.squares = float(((np.asarray(scores, float) - self.mean) ** 2).sum()) if self.n else 0.0

    def spread(self, lone: float) -> float:
        return math.sqrt(self.squares / self.n) if self.n > 1 else lone

    def joined(self, other: _Scores) -> _Scores:
        out = _Scores(())
        out.n, out.rows = self.n + other.n, self.rows + other.rows
        apart = other.mean - self.mean
        out.mean = self.mean + apart * other.n / max(out.n, 1)
        out.squares = self.squares + other.squares + apart * apart * self.n * other.n / max(out.n, 1)
        return out


def fuse(islands: list, seed: int, gap: float = SCORE_GAP, lone: float = LONE_STD, most_outliers: int = MOST_OUTLIERS) -> list[int]:
    """Islands accepted around island `seed`; each island is the list of its rows' scores, None for a row without one (or
    their _Scores), in order of place.

    Sides take turns. The island next to a side's edge is accepted if its mean is within the gap of the accepted mean, less
    both spreads. One that isn't becomes the side's edge while few outlier rows, scored or not, have been absorbed; it is taken in (its
    scores are not) once an island beyond it is accepted. Two failures in a row end the walk."""
    stats = lambda i: islands[i] if isinstance(islands[i], _Scores) else _Scores(islands[i])
    accepted, scores = {seed}, stats(seed)
    edge, pending = {-1: seed, 1: seed}, {-1: None, 1: None}
    absorbed, failures, side = 0, 0, -1
    while failures < 2:
        at = edge[side] + side
        if not 0 <= at < len(islands):
            failures, side = failures + 1, -side
            continue
        own = stats(at)
        if own.n:
            near = not scores.n or abs(scores.mean - own.mean) - scores.spread(lone) - own.spread(lone) < gap
            if near:
                if pending[side] is not None:
                    accepted.add(pending[side])
                    absorbed += stats(pending[side]).rows
                    pending[side] = None
                accepted.add(at)
                scores = scores.joined(own)
                edge[side], failures = at, 0
            elif absorbed < most_outliers:
                pending[side] = edge[side] = at
            else:
                failures, side = failures + 1, -side
        else:
            accepted.add(at)
            edge[side] = at
    return sorted(accepted)


def _sums_in_order(rows: DataFrame, keys: list[str], island: str, order: list[str]) -> DataFrame:
    """(keys, island, _n, _rows, _mean, _squares, _seed) of rows with `_x` and `_seed`: sums over an island's rows one after the
    other (Welford 1962), so that not even their last digits depend on partitions. Rows are dealt by island and pass by sorted."""
    names, kinds = [*keys, island], {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, members, total, mean, squares, seeded = None, 0, 0, 0.0, 0.0, 0.0, False
        types = None
        for batch in batches:
            types = [batch.schema.field(k).type for k in names]
            found = []
            for at, x, one in zip(zip(*(batch[k].to_pylist() for k in names), strict=True), batch["_x"].to_pylist(), batch["_seed"].to_pylist(), strict=True):
                if at != now:
                    if members:
                        found.append((*now, n, members, total / n if n else 0.0, squares / n * n if n else 0.0, seeded))
                    now, n, members, total, mean, squares, seeded = at, 0, 0, 0.0, 0.0, 0.0, False
                members += 1
                seeded = seeded or bool(one)
                if x is not None:
                    n += 1
                    total += x
                    before, mean = mean, mean + (x - mean) / n
                    squares += (x - mean) * (x - before)
            if found:
                yield summed(found, types)
        if members:
            yield summed([(*now, n, members, total / n if n else 0.0, squares / n * n if n else 0.0, seeded)], types)

    def summed(found: list[tuple], types: list) -> pa.RecordBatch:
        types = [*types, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], [*names, "_n", "_rows", "_mean", "_squares", "_seed"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in names), "_n long, _rows long, _mean double, _squares double, _seed boolean"])
    placed = rows.repartition(*names).sortWithinPartitions(*names, *order)
    return placed.select(*names, "_x", "_seed").mapInArrow(run, schema)


def island_fusion(df: DataFrame, keys: list[str], island: str, score: str, seed: str, gap: float = SCORE_GAP, order: list[str] | None = None) -> DataFrame:
    """(keys, seed_island, island): for each seeded island the islands fused with it. df: one row for each member, with its
    island (a number in order of place), its score (null or NaN: none) and whether it is a seed.

    Spark sums each island up first, so a key is one short row for each of its islands. Means that lie a gap apart may be told by
    the last digit of a sum: with `order` (which has no ties), an island's rows are summed one after the other in that order."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    x = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    if order is None:
        sums = df.groupBy(*keys, island).agg(F.count(x).alias("_n"), F.count(F.lit(1)).alias("_rows"), F.coalesce(F.avg(x), F.lit(0.0)).alias("_mean"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("_squares"), F.max(F.col(seed)).alias("_seed"))
    else:
        sums = _sums_in_order(df.select(*keys, island, x.alias("_x"), F.col(seed).alias("_seed"), *[c for c in order if c not in (*keys, island)]), keys, island, order)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(island, kind="stable")
        names = pdf[island].to_numpy()
        members = []
        for n, rows, mean, squares in zip(pdf["_n"], pdf["_rows"], pdf["_mean"], pdf["_squares"], strict=True):
            one = _Scores(())
            one.n, one.rows, one.mean, one.squares = int(n), int(rows), float(mean), float(squares)
            members.append(one)
        found = [(s, np.array(fuse(members, int(s), gap))) for s in np.flatnonzero(pdf["_seed"].fillna(False).to_numpy(bool))]
        n = sum(len(f) for _, f in found)
        out = {k: [pdf[k].iloc[0]] * n for k in keys}
        out["seed_island"] = np.concatenate([np.repeat(names[s], len(f)) for s, f in found]) if found else []
        out[island] = np.concatenate([names[f] for _, f in found]) if found else []
        return pd.DataFrame(out)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"seed_island {kinds[island]}", f"`{island}` {kinds[island]}"])
    return sums.groupBy(*keys).applyInPandas(walk, schema)


def _clashes(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether the overlap of two hits exceeds half of what either keeps outside of it; touching hits don't clash."""
    (s, e), (s2, e2) = a, b
    if s >= e2 or s2 >= e:
        return False
    overlap = e2 - s + 1 if s >= s2 else e - s2 + 1
    return 2 * overlap > (e - s + 1) - overlap or 2 * overlap > (e2 - s2 + 1) - overlap


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by `key` as tables of whole groups; only a group that a batch may have cut waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch[key].to_numpy()
        other = np.flatnonzero(ids != ids[-1])
        if len(other):
            cut = int(other[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = [batch.slice(cut)]
        elif held and held[-1][key][0].as_py() != ids[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: Rows of an overlapping piece up to which it is picked from in one task.
MOST_PIECE = 100_000


def greedy_intervals(df: DataFrame, keys: list[str], start: str, end: str, rank: list[str]) -> DataFrame:
    """The rows that stay when each key's rows are taken by `rank` (which has no ties), best first, unless they clash with one
    taken before.

    Rows clash only where they overlap, so each overlapping piece of a key is picked from on its own, many pieces in a pass over
    sorted rows. A piece of more than MOST_PIECE rows is picked from in rounds: rows that rank best among all undecided rows they
    clash with are taken, and those they clash with go."""
    order = [start, end, *[c for c in rank if c not in (start, end)]]
    placed = scan(df, keys, order, tops={"_upto": F.col(end)})
    placed = placed.withColumn("_new", F.when(F.col(start) < F.col("_upto"), 0).otherwise(1)).drop("_upto")
    pieces = store(scan(placed, keys, order, sums={"_piece": F.col("_new")}).drop("_new").withColumn("_id", F.xxhash64(*keys, "_piece")))
    large = store(pieces.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MOST_PIECE).select("_id"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "_id"):
            yield from _picked(table, start, end)

    small = pieces.join(F.broadcast(large), "_id", "left_anti").select(*pieces.columns)  # one id for MOST_PIECE rows at most
    kept = small.repartition("_id").sortWithinPartitions("_id", *keys, "_piece", *rank).mapInArrow(pick, pieces.schema)
    if not large.isEmpty():
        kept = kept.unionByName(_picked_in_rounds(pieces.join(F.broadcast(large), "_id", "left_semi").select(*pieces.columns), [*keys, "_piece", "_id"], start, end, rank))
    return kept.select(*df.columns)


def _picked(rows: pa.Table, start: str, end: str) -> Iterator[pa.RecordBatch]:
    """Of whole pieces, each in the order of its rows' rank, the rows that stay."""
    ids, low, high = rows["_id"].to_numpy(), rows[start].to_pylist(), rows[end].to_pylist()
    cuts = [*np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])).tolist(), len(ids)]
    keep: list[int] = []
    for first, last in pairwise(cuts):
        taken: list[tuple[int, int]] = []  # by start; taken rows overlap by little
        reach = 0  # the longest one taken
        for i in range(first, last):
            span = low[i], high[i]
            a, b = bisect_left(taken, (span[0] - reach,)), bisect_left(taken, (span[1],))
            if not any(_clashes(span, t) for t in taken[a:b]):
                insort(taken, span)
                reach = max(reach, span[1] - span[0])
                keep.append(i)
    yield from rows.take(pa.array(keep, pa.int64())).to_batches()


def _clash(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """_clashes as a column."""
    (s, e), (s2, e2) = a, b
    overlap = F.when(s >= s2, e2 - s + 1).otherwise(e - s2 + 1)
    return (s < e2) & (s2 < e) & ((2 * overlap > (e - s + 1) - overlap) | (2 * overlap > (e2 - s2 + 1) - overlap))


def _picked_in_rounds(rows: DataFrame, keys: list[str], start: str, end: str, rank: list[str]) -> DataFrame:
    rows = store(rows.withColumn("_row", F.monotonically_increasing_id()))
    side = lambda n: rows.select(*keys, F.col(start).alias(f"_s{n}"), F.col(end).alias(f"_e{n}"), F.struct(*rank, "_row").alias(f"_r{n}"))
    met = meeting(side(1), side(2), keys, ("_s1", "_e1"), ("_s2", "_e2")).where((F.col("_r1") < F.col("_r2")) & _clash((F.col("_s1"), F.col("_e1")), (F.col("_s2"), F.col("_e2"))))
    edges = store(met.select(F.col("_r1._row").alias("better"), F.col("_r2._row").alias("worse")))
    gone = []
    while not edges.isEmpty():
        best = store(edges.select(F.col("better").alias("row")).distinct().join(edges.select(F.col("worse").alias("row")), "row", "left_anti"))
        gone.append(store(edges.join(best, edges.better == best.row, "left_semi").select(F.col("worse").alias("_row")).distinct()))
        left = edges.join(gone[-1], edges.better == gone[-1]._row, "left_anti").join(gone[-1], F.col("worse") == gone[-1]._row, "left_anti")
        edges = store(left.join(best, left.better == best.row, "left_anti"))
    for part in gone:
        rows = rows.join(part, "_row", "left_anti")
    return rows.drop("_row")


def legacy_walk(df: DataFrame, keys: list[str], start: str, end: str, row_id: str, strand: str, seed: str, skip: str, gap: int) -> DataFrame:
    """(keys, seed_id, row_id): runs grown from seeds by walking left, then right from the leftmost row reached. Flagged
    (`skip`) rows are nobody's neighbour, so a flagged seed bridges what its neighbours can't.

    Plain rows form runs whatever the seed. A plain seed has its own run; a flagged one has the whole run on its left, if it
    is near enough, or else the run on its right from the next row on. So walks are windows and one join."""
    rows = df.select(*keys, F.col(row_id).alias("_id"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(strand).alias("_st"), F.col(seed).cast("boolean").alias("_seed"), (~F.col(skip).cast("boolean")).alias("_plain"))
    plain = lambda c: F.when(F.col("_plain"), c)
    line = ["_s", "_id"]
    rows = scan(rows, keys, line, before={"_left": plain(F.struct("_e", "_st"))}, sums={"_place": F.lit(1).cast("long")})
    near = lambda left_end, right_start, one, other: F.coalesce((right_start - left_end <= gap) & one.eqNullSafe(other), F.lit(False))
    joins_left = near(F.col("_left._e"), F.col("_s"), F.col("_left._st"), F.col("_st"))
    rows = scan(rows.withColumn("_by_left", joins_left), keys, line, sums={"_run": (F.col("_plain") & ~F.col("_by_left")).cast("long")})
    rows = scan(rows, keys, line, after={"_right": plain(F.struct("_s", "_st", "_run", "_place"))})
    rows = store(rows)
    by_right = near(F.col("_e"), F.col("_right._s"), F.col("_st"), F.col("_right._st"))
    seeds = rows.where("_seed").select(
        *keys, F.col("_id").alias("seed_id"),
        F.when(F.col("_plain") | F.col("_by_left"), F.col("_run")).when(by_right, F.col("_right._run")).alias("_run"),
        F.when(F.col("_plain") | F.col("_by_left"), F.lit(0)).otherwise(F.col("_right._place")).alias("_from"),
    )
    members = rows.where("_plain").select(*keys, "_run", "_id", "_place")
    got = seeds.join(members, [*keys, "_run"]).where(F.col("_place") >= F.col("_from")).select(*keys, "seed_id", F.col("_id").alias(row_id))
    own = rows.where("_seed and not _plain").select(*keys, F.col("_id").alias("seed_id"), F.col("_id").alias(row_id))
    return got.unionByName(own)


def set_cover(df: DataFrame, key: str, group: str, member: str) -> DataFrame:
    """(key, group, turn): for each key, groups chosen one by one that add most uncovered members (a tie goes to the larger
    group, then the smaller name) until nothing is added. All keys take their turn at once, as joins and aggregates, so a
    key of any size is spread; rows with a null take no part."""
    rows = store(df.select(key, group, member).dropna().distinct())
    sizes = store(rows.groupBy(key, group).agg(F.count(F.lit(1)).alias("_size")))
    left, chosen, turn = rows, [], 0
    while not chosen or not chosen[-1].isEmpty():
        turn += 1
        gains = left.groupBy(key, group).agg(F.count(F.lit(1)).alias("_gain")).join(sizes, [key, group])
        best = F.min(F.struct((-F.col("_gain")).alias("gain"), (-F.col("_size")).alias("size"), F.col(group).alias("name")))
        chosen.append(store(gains.groupBy(key).agg(best.alias("_best")).select(key, F.col("_best.name").alias(group), F.lit(turn).alias("turn"))))
        covered = rows.join(chosen[-1], [key, group]).select(key, member)
        left = store(left.join(covered, [key, member], "left_anti"))
    return reduce(DataFrame.unionByName, chosen)
