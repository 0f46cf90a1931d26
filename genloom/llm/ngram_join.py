"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles; equal sets are one node. In each run, a set chooses a token with a chance of
1 / (threshold x size), by a hash that all sets share, and so on along the path: sets that are alike choose alike, so
the tokens chosen so far name a bucket. A bucket that is small enough is compared by brute force; a larger one is split
by the next chosen token, row by row, without ever being brought together. Runs are repeated until a pair at the
threshold, even one whose buckets are all large but those of the deepest level, is missed with less than the chance
that the target recall leaves. Brute force in buckets uses sketches and
keeps a forest; groups so connected are then verified on their whole sets: all pairs of a group, in blocks of bounded
size, so that links that no run brought together count too, and counts are exact without pairs ever being written.

Defined results: a text of fewer than five words is one shingle of them all; a null or wordless text has no links and is
a class of its own; copies (equal sets) are links of each other; a class is named by its smallest doc_id; rows that
repeat are copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, materialize, shuffle_partitions, ship_by_value
from .graph import components
from .shingles import mix64, shingle_sets

ship_by_value(__name__)

WIDTH = 5
THRESHOLD = (4, 5)  # a fraction, so that comparisons are exact
TARGET_RECALL = 0.9999
DEPTH = 3
SKETCH, SKETCH_LEAST = 32, 0.45
BUCKET = 1024
BLOCK = 1000
MOST_BROADCAST = 1_000_000
SIZES = 1000  # from this size on, runs are as many as for the size below


def missed(n: int, depth: int = DEPTH) -> float:
    """The chance that a run has no path of `depth` that a pair at the threshold shares, the larger set having n tokens.

    Each shared token is chosen by both with a chance of 1 / (threshold x n), and a path uses a token once."""
    num, den = THRESHOLD
    shared, chance, miss = -(-num * n // den), min(1.0, den / (num * n)), 0.0
    for used in reversed(range(depth)):
        miss = (1 - chance + chance * miss) ** max(0, shared - used)
    return miss


def runs_for(recall: float) -> np.ndarray:
    """Runs of a set, by its size (the last for all larger ones), until a pair is missed with a chance of 1 - recall at most.

    A pair may have to be told apart at the deepest level, as its buckets above are large. Both sets of a pair take part
    in as many runs as the larger one needs. Sets that are alike but not equal have a larger one of five tokens at least."""
    num, den = THRESHOLD
    least = num // (den - num) + 1
    need = [0 if n < least else math.ceil(math.log(1 - recall) / math.log(missed(n))) for n in range(SIZES * den // num + 2)]
    return np.array([max(1, *need[n : n * den // num + 1]) if n else 1 for n in range(SIZES)])


def _chosen(tokens: np.ndarray, salts: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(path, token) index pairs: the tokens that each path, named by its salt, chooses."""
    return np.nonzero((tokens[None, :] ^ salts[:, None]) * np.uint64(0x9E3779B97F4A7C15) <= limit)  # tokens and salts are hashes


def chosen_paths(tokens: np.ndarray, runs: int, depth: int = DEPTH) -> np.ndarray:
    """Rows of bucket names along each path of a set, one column for each depth; 0 where a path has ended."""
    limit = np.uint64(min(2**64 - 1, int(2**64 * THRESHOLD[1] / (THRESHOLD[0] * len(tokens)))))
    salts = mix64(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    rows, used = np.zeros((runs, depth), np.uint64), np.zeros((runs, depth), np.int64)
    ended: list[np.ndarray] = []
    for d in range(depth):
        p, t = _chosen(tokens, salts, limit)
        if d:
            fresh = (used[p, :d] != t[:, None]).all(axis=1)
            p, t = p[fresh], t[fresh]
            alive = np.zeros(len(salts), bool)
            alive[p] = True
            ended.append(rows[~alive])
        salts = mix64(salts[p] * np.uint64(5) + tokens[t]) | np.uint64(1)
        rows, used = rows[p], used[p]
        rows[:, d], used[:, d] = salts, t
    return np.concatenate([*ended, rows])


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """A byte of the least token in each of SKETCH classes; 0 for a class without tokens."""
    out = np.zeros(SKETCH, np.uint8)
    kind, at = np.unique((tokens % np.uint64(SKETCH)).astype(np.int64), return_index=True)
    out[kind] = (tokens[at] >> np.uint64(33)) % np.uint64(255) + np.uint64(1)
    return out


def _name(tokens: np.ndarray) -> int:
    """A set's name, by all of its tokens."""
    total = mix64(np.array([mix64(tokens + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64))
    return int(total.astype(np.int64)[0])


def _describe(runs: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            names, sizes, sketches, paths = [], [], [], []
            for tokens in shingle_sets(batch.column(1), WIDTH):
                some = len(tokens) > 0
                names.append(_name(tokens) if some else None)
                sizes.append(len(tokens))
                sketches.append(_sketch(tokens).tobytes() if some else None)
                paths.append(chosen_paths(tokens, int(runs[min(len(tokens), len(runs) - 1)])).tobytes() if some else None)
            yield pa.record_batch([batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(paths, pa.binary())], names=["doc_id", "node", "n", "sketch", "paths"])

    return run


def _unpack(depth: int) -> Callable:
    """Each set's distinct buckets at a depth, with the bucket above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = []
                for packed in part.column(3):
                    keys = np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, DEPTH)
                    keys = keys[keys[:, depth - 1] != 0]
                    found.append(keys[np.unique(keys[:, depth - 1], return_index=True)[1]])
                keys = np.concatenate(found)
                take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                above = keys[:, depth - 2] if depth > 1 else np.zeros(len(keys), np.int64)
                yield pa.record_batch([pa.array(np.ascontiguousarray(above)), pa.array(np.ascontiguousarray(keys[:, depth - 1])), *(part.column(i).take(take) for i in range(3))], names=["above", "key", "node", "n", "sketch"])

    return run


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that are sorted by `keys`, one at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        columns = [table[k].to_numpy() for k in keys]
        if not table.num_rows:
            continue
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts = [0, *change.tolist(), table.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def _forest(near: np.ndarray) -> np.ndarray:
    """The first member of each member's connected group, by a symmetric matrix."""
    label = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        now = np.where(near, label[None, :], len(near)).min(axis=1)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest over the members of each bucket whose sketches and sizes may be as alike as asked."""
    share = THRESHOLD[0] / THRESHOLD[1]
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for group in groups_of(batches, ["key"]):
        node, at = np.unique(group["node"].to_numpy(), return_index=True)
        if len(node) < 2:
            continue
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)[at]
        n = group["n"].to_numpy()[at]
        near = np.empty((len(node), len(node)), bool)
        for i in range(0, len(node), 128):
            x = sketch[i : i + 128, None, :]
            some = ((x > 0) | (sketch[None] > 0)).sum(axis=2)
            near[i : i + 128] = ((x == sketch[None]) & (x > 0)).sum(axis=2) >= SKETCH_LEAST * some
        near &= np.minimum(n[:, None], n[None]) >= share * np.maximum(n[:, None], n[None]) - 1e-9
        root = _forest(near)
        linked = root != np.arange(len(node))
        a.append(node[linked])
        b.append(node[root[linked]])
        if len(a) >= 10_000:
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            a, b = [], []
    if a:
        yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _large_buckets(rows: DataFrame) -> tuple[DataFrame, int]:
    """(large, how many): keys with more than BUCKET rows. Their rows are not brought together."""
    large = materialize(rows.groupBy("key").count().where(F.col("count") > BUCKET).select(F.col("key").alias("large")), "join-large")
    return large, large.count()


def _by_large(rows: DataFrame, column: str, large: DataFrame, n: int, how: str) -> DataFrame:
    """Semi or anti join with the large buckets: sent to all tasks if they are few, else spread by a salt."""
    if n <= MOST_BROADCAST:
        return rows.join(F.broadcast(large), F.col(column) == F.col("large"), how)
    spread = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.join(spread, (F.col(column) == F.col("large")) & (F.pmod(F.xxhash64("node"), F.lit(64)) == F.col("_salt")), how)


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """(a, b): forests of nodes that may be alike. nodes: node, n, sketch, paths.

    A bucket of the first depth that is too large is left to the next depth, whose rows are unpacked then."""
    buckets, star, above = None, None, None
    for depth in range(1, DEPTH + 1):
        rows = nodes.select("node", "n", "sketch", "paths").mapInArrow(_unpack(depth), "above long, key long, node long, n int, sketch binary")
        if above is not None:
            rows = materialize(_by_large(rows, "above", *above, "left_semi"), "join-level")
        large, n = _large_buckets(rows)
        small = (_by_large(rows, "key", large, n, "left_anti") if n else rows).drop("above")
        buckets = small if buckets is None else buckets.unionByName(small)
        if not n:
            break
        above = (large, n)
        if depth == DEPTH:  # sets that agree on every token of a whole path, many of them: tied to the first, to be verified
            rest = materialize(_by_large(rows, "key", large, n, "left_semi").select("key", "node"), "join-rest")
            first = materialize(rest.groupBy("key").agg(F.min("node").alias("b")), "join-rest-first")
            star = rest.join(broadcast_if(first, first.count(), MOST_BROADCAST), "key").select(F.col("node").alias("a"), "b").where("a <> b")
    dealt = buckets.repartition(shuffle_partitions(nodes.sparkSession), "key").sortWithinPartitions("key")
    edges = dealt.mapInArrow(_bucket_edges, "a long, b long")
    return (edges if star is None else edges.unionByName(star)).distinct()


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
        sets = list(shingle_sets(batch.column(0), WIDTH))
        some = [s for s in sets if len(s)]
        yield pa.record_batch([pa.array([_name(s) for s in some], pa.int64()), pa.array([s.tobytes() for s in some], pa.binary())], names=["node", "tokens"])


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections: within `sets`, or between `sets` and `others`."""
    if others is None and len(sets) == 2:
        both = np.sort(np.concatenate(sets))
        shared = int((both[1:] == both[:-1]).sum())
        return np.array([[len(sets[0]), shared], [shared, len(sets[1])]])
    every = sets + (others or [])
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    tokens, place, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], number[place[keep]]
    total = np.zeros((len(sets), len(others) if others is not None else len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = max(1, 2_000_000 // len(every))
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(place, [a, a + width])
        table = np.zeros((len(every), width), np.float32)
        table[owner[lo:hi], place[lo:hi] - a] = 1
        total += table[: len(sets)] @ (table[len(sets) :] if others is not None else table).T
    total = total.astype(np.int64)
    if others is None:
        np.fill_diagonal(total, [len(s) for s in sets])
    return total


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node in a block pair: its links there (documents, texts), and the first node of its connected part."""
    num, den = THRESHOLD
    for group in groups_of(batches, ["part", "i", "j"]):
        node, copies, block = (group[c].to_numpy() for c in ("node", "copies", "block"))
        i, j = int(group["i"][0].as_py()), int(group["j"][0].as_py())
        once = np.unique(node, return_index=True)[1]  # a doc_id that repeats brings its set more than once
        order = once[np.lexsort((node[once], block[once] != i))]
        node, copies, block = node[order], copies[order], block[order]
        raw = group["tokens"].to_pylist()
        sets = [np.frombuffer(raw[k], np.uint64) for k in order]
        n = np.array([len(s) for s in sets])
        cut = int((block == i).sum()) if i != j else len(node)
        if len(node) < 2 or (i != j and cut in (0, len(node))):
            continue
        shared = _overlaps(sets, None) if i == j else _overlaps(sets[:cut], sets[cut:])
        x, y = (n[:, None], n[None]) if i == j else (n[:cut, None], n[None, cut:])
        alike = shared * (num + den) >= num * (x + y)
        near = np.zeros((len(node), len(node)), bool)
        if i == j:
            near = alike & ~np.eye(len(node), dtype=bool)
        else:
            near[:cut, cut:] = alike
            near[cut:, :cut] = alike.T
        root = node[_forest(near)]
        some = near.any(axis=1)
        yield pa.record_batch([pa.array(node[some]), pa.array((near @ copies)[some]), pa.array(near.sum(axis=1)[some].astype(np.int64)), pa.array(root[some])], names=["node", "links", "texts", "root"])


def near_duplicates(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, n_links (other documents at the threshold or above), n_texts (other sets among them).

    class_id: the smallest doc_id of the document's class, where a class is connected by links."""
    described = materialize(docs.select("doc_id", "text").mapInArrow(_describe(runs_for(recall)), "doc_id long, node long, n int, sketch binary, paths binary"), "join-described")
    nodes = materialize(described.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")), "join-nodes")
    once = described.where("node is not null").select("node", "n", "sketch", "paths").dropDuplicates(["node"])
    grouped = materialize(components(candidate_edges(once)), "join-groups")
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    sizes = materialize(sizes.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "join-sizes")
    split = sizes.agg(F.max("blocks")).first()[0] or 1
    members = materialize(grouped.join(sizes, "root").join(nodes, "node").select("node", "copies", "first_doc", F.col("root").alias("part"), "blocks"), "join-members")

    # whole sets of the members, read again from one document of each
    readers = materialize(members.select(F.col("first_doc").alias("_doc")).distinct(), "join-readers")
    texts = docs.select("doc_id", "text").join(broadcast_if(readers, readers.count(), MOST_BROADCAST), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi").select("text")
    sets = texts.mapInArrow(_with_sets, "node long, tokens binary")
    placed = sets.join(broadcast_if(members.drop("first_doc"), members.count(), MOST_BROADCAST), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    pairs = placed.withColumn("ij", F.explode(others)).select("part", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"), "block", "node", "copies", "tokens")
    pairs = pairs.repartition(shuffle_partitions(docs.sparkSession), "part", "i", "j").sortWithinPartitions("part", "i", "j")
    found = materialize(pairs.mapInArrow(_verify, "node long, links long, texts long, root long"), "join-found")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"), F.min("root").alias("root"))
    if split > 1:  # groups seen in several blocks: connect their parts
        roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        linked = linked.drop("root").join(roots, "node")
    linked = materialize(linked.join(nodes, "node"), "join-linked")
    classes = materialize(linked.groupBy("root").agg(F.min("first_doc").alias("class_doc")), "join-classes")
    linked = materialize(linked.join(classes, "root").select("node", "links", "texts", "class_doc"), "join-classed")
    info = materialize(nodes.join(linked, "node", "left").select(F.col("node").alias("_node"), "copies", F.coalesce("class_doc", "first_doc").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts")), "join-info")
    rows = described.select("doc_id", "node").join(info, F.col("node") == F.col("_node"), "left")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"))
