"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

Vectors are dealt to blocks by a hash of the row, and each dimension of a block is a sorted list. A query reads the lists in
turn from the end where its own component's products are large, to growing depths, for many queries at once. A vector's score
lies between bounds: read components count in full, unread ones at most as the list's frontier and at least as its far end.
The k-th lower bound is what a vector must reach. A query stops when no unseen vector can reach it and few seen ones still
can; only those get their final scores. (With max(c, frontier) in place of c, the upper bounds of all queries and vectors are
matrix products.)

Each query first meets one block, then GROWTH times as many blocks as it has met, and so on. Its k-th score so far is its floor
in the next pass: it is compared with the bound that each block's extreme components give before the query is sent there, and
it stops the reading of the lists early. So a pass finds about GROWTH x k vectors for a query, however many blocks there are.
Vectors are shuffled once for each pass, queries once for each block that may still beat their floor; a task holds one block
and reads its queries in batches.

Defined results: a vector takes part if it isn't null and all components are finite; vectors of other lengths are not
compared; scores are exact while they stay below 2^62; each row is a candidate of all other rows' queries, so rows that repeat are queries of their own and candidates of
each other; a null vec_id is no query and loses ties; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, ship_by_value, shuffle_partitions

ship_by_value(__name__)

NO_ID = (1 << 63) - 1
NO_FLOOR = -(1 << 62)
DEPTHS = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875)
#: Share of a block that may be left to resolve when reading stops, rows that are looked at to choose the depth, and queries at once.
RESOLVE, PROBE, BATCH = 0.125, 64, 256
LEAST_BLOCK, MOST_BLOCK = 2048, 16_384
GROWTH = 8
MOST_BROADCAST_BLOCKS = 20_000  # of some 1 KB for 64 dimensions


def integer_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors with null or non-finite components are left out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(x.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _kth_largest(a: np.ndarray, k: int) -> np.ndarray:
    return np.partition(a, a.shape[1] - k, axis=1)[:, a.shape[1] - k]


class Block:
    """The sorted lists of a block's vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.c, self.order = rows[order], ids[order], c[order], order
        self.lists = np.sort(self.c, axis=0)
        self.largest = float(np.abs(c).max(initial=0))
        self.at: dict = {}

    def bounds(self, depth: float, kind: type) -> tuple[np.ndarray, ...]:
        """Frontiers from above and from below, and components (of products with positive, then negative ones) that give
        upper bounds and lower bounds."""
        if (depth, kind) not in self.at:
            c, lists, n = self.c.astype(kind), self.lists.astype(kind), len(self.c)
            t = min(n - 1, int(n * depth))
            hi, lo = lists[n - 1 - t], lists[t]  # what a list still holds is at most hi, or at least lo
            upper = np.concatenate((np.maximum(c, hi), np.minimum(c, lo)), axis=1)
            lower = np.concatenate((np.where(c >= hi, c, lists[0]), np.where(c <= lo, c, lists[-1])), axis=1)
            self.at[depth, kind] = hi, lo, upper, lower
        return self.at[depth, kind]


def nra(block: Block, q: np.ndarray, q_rows: np.ndarray, floor: np.ndarray, k: int, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score), by places in `q` and in the block, of at most k vectors for each query that reach its floor
    and are its best in the block, ties to smaller ids. floor: NO_FLOOR where none is known."""
    n, dims = block.c.shape
    most = float(np.abs(q).max(initial=0)) * block.largest * max(dims, 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**52 else np.int64  # exact in each
    q_all, c = q.astype(kind), block.c.astype(kind)
    signed = np.concatenate((np.maximum(q_all, 0), np.minimum(q_all, 0)), axis=1)
    reach = np.maximum(floor, -np.int64(min(most, 2.0**62)) - 1).astype(kind)
    known = floor > NO_FLOOR
    left = np.arange(len(q_all))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def resolve(queries: np.ndarray, may: np.ndarray) -> None:
        i, j = np.nonzero(may & (block.rows[None, :] != q_rows[queries][:, None]))
        if stats is not None:
            stats["resolved"] = stats.get("resolved", 0) + len(i)
        for at in range(0, len(i), 1 << 17):
            a, b = queries[i[at : at + (1 << 17)]], j[at : at + (1 << 17)]
            scores = np.einsum("ij,ij->i", q_all[a], c[b])
            good = scores >= reach[a]
            found.append((a[good], b[good], scores[good].astype(np.int64)))

    probe = np.arange(0, n, max(1, n // PROBE))
    for depth in DEPTHS:
        if not len(left):
            break
        hi, lo, upper, lower = block.bounds(depth, kind)
        if known[left].all() and ((signed[left] @ upper[probe].T) >= reach[left][:, None]).mean() > RESOLVE:
            continue  # most vectors still qualify here: read on
        if n > k and not known[left].all():  # the query's own row may be among the k + 1 best
            reach[left] = np.maximum(reach[left], _kth_largest(signed[left] @ lower.T, min(k + 1, n)))
        frontier = signed[left] @ np.concatenate((hi, lo))
        may = (signed[left] @ upper.T) >= reach[left][:, None]
        done = (frontier < reach[left]) & (may.mean(axis=1) <= RESOLVE)
        if stats is not None:
            stats["read"] = stats.get("read", 0.0) + depth * n * int(done.sum())
        if done.any():
            resolve(left[done], may[done])
            left = left[~done]
    if len(left):  # their lists are read to the end, where both bounds are the score
        scores = q_all[left] @ c.T
        if n > k:
            reach[left] = np.maximum(reach[left], _kth_largest(scores, min(k + 1, n)))
        may = (scores >= reach[left][:, None]) & (block.rows[None, :] != q_rows[left][:, None])
        i, j = np.nonzero(may)
        found.append((left[i], j, scores[i, j].astype(np.int64)))
        if stats is not None:
            stats["read"] = stats.get("read", 0.0) + n * len(left)
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, -score, i))  # places in the block are in the order of ids
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    best = place < k
    return i[best], j[best], score[best]


def _matrix(table: pa.Table) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


FOUND = "row long, query_id long, vec_id long, score long"


def _search(k: int) -> Callable:
    """Rows sorted by block, a block's vectors before its queries: each query's best vectors of the block."""

    def answer(block: Block, ids: pa.Array, queries: pa.Table) -> pa.RecordBatch:
        i, j, score = nra(block, _matrix(queries), queries["row"].to_numpy(), queries["floor"].to_numpy(), k)
        take = pa.array(i)
        return pa.record_batch([queries["row"].combine_chunks().take(take), queries["vec_id"].combine_chunks().take(take), ids.take(pa.array(block.order[j])), pa.array(score)], names=["row", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, vectors, block, ids = None, [], None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = ("block", "dims", "is_query")
            kinds = list(zip(*(table[c].to_pylist() for c in names), strict=True))
            cuts = [0, *(i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1]), len(kinds)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if kinds[a][:2] != key:
                    key, vectors, block = kinds[a][:2], [], None
                if not kinds[a][2]:
                    vectors.append(table.slice(a, b - a))
                    continue
                if block is None and vectors:
                    whole = pa.concat_tables(vectors).combine_chunks()
                    ids, vectors = whole["vec_id"].combine_chunks(), []
                    block = Block(whole["row"].to_numpy(), ids.fill_null(NO_ID).to_numpy(), _matrix(whole))
                for at in range(a, b, BATCH) if block is not None else ():
                    yield answer(block, ids, table.slice(at, min(BATCH, b - at)))

    return run


def _meet(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The best vectors of each query in the blocks that it is sent to. queries: block, dims, row, vec_id, v, floor."""
    columns = ["block", "dims", "is_query", "row", "vec_id", "v", "floor"]
    both = queries.withColumn("is_query", F.lit(True)).select(*columns).unionByName(vectors.withColumn("is_query", F.lit(False)).withColumn("floor", F.lit(NO_FLOOR)).select(*columns))
    dealt = both.repartition(shuffle_partitions(both.sparkSession), "block", "dims").sortWithinPartitions("block", "dims", "is_query")
    return dealt.mapInArrow(_search(k), FOUND)


def block_bounds(vectors: DataFrame) -> DataFrame:
    """(block, dims, ends): the least and the largest component of each block in each dimension."""
    each = vectors.select("block", "dims", F.posexplode("v").alias("at", "x")).groupBy("block", "dims", "at").agg(F.max("x").alias("hi"), F.min("x").alias("lo"))
    return each.groupBy("block", "dims").agg(F.array_sort(F.collect_list(F.struct("at", "hi", "lo"))).alias("ends"))


def top_k(rows: DataFrame, is_query: Column, k: int = 20, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products. is_query: a condition on vec_id.

    block: vectors to a block; by default a quarter of a partition's, between LEAST_BLOCK and MOST_BLOCK."""
    spark = rows.sparkSession
    v = materialize(integer_vectors(rows).withColumn("dims", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    n = v.count()
    block = block or min(MOST_BLOCK, max(LEAST_BLOCK, n // (4 * shuffle_partitions(spark))))
    blocks = max(1, -(-n // block))
    v = v.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    queries = v.where(F.col("vec_id").isNotNull() & is_query)
    order = W.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = ranked(_meet(queries.withColumn("floor", F.lit(NO_FLOOR)), v, k))
    if blocks > 1:
        ends = materialize(block_bounds(v), "topk-bounds")
        few = ends.count() <= MOST_BROADCAST_BLOCKS
    met = 1
    while met < blocks:
        best = materialize(best, "topk-best")
        floors = best.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(NO_FLOOR).alias("floor"))
        waiting = queries.withColumnRenamed("block", "_own").join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR)))
        next_met = min(blocks, met * (1 + GROWTH))
        turn = F.pmod(F.col("block") - F.col("_own"), F.lit(blocks)).between(met, next_met - 1)
        if few:
            product = F.zip_with("v", "ends", lambda a, e: a.cast("double") * F.when(a > 0, e["hi"]).otherwise(e["lo"]))
            bound = F.aggregate(product, F.lit(0.0), lambda s, x: s + x)
            waiting = waiting.join(F.broadcast(ends), "dims").where(turn & (bound + F.abs(bound) * 1e-9 >= F.col("floor"))).drop("ends")
        else:
            waiting = waiting.withColumn("block", F.explode(F.transform(F.sequence(F.lit(met), F.lit(next_met - 1)), lambda x: F.pmod(F.col("_own") + x, F.lit(blocks)).cast("int"))))
        best = ranked(best.drop("rank").unionByName(_meet(waiting, v, k)))
        met = next_met
    return best.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
