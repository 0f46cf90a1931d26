"""Ranked lexical search by sort-based accumulation.

The query texts are a table of (item, term); tasks read whole documents once and store, for each, its length and the
frequencies of the terms that some item asks for (a direct index of the query vocabulary). Corpus counts (N, L, df) are
aggregates over all documents. Scoring takes the stored rows in ranges: for each range the matched (item, document, impact)
arrays are concatenated, item and document packed into one integer key, the keys sorted by radix (16 bits a pass), and equal
keys summed with `numpy.add.reduceat`. Every task keeps one heap of the `k` best for each item; the heaps' rows are then
range-partitioned by item, in two steps (by item and group of tasks, then by item), so that no partition gets more than k rows
for each item and group.

The items are taken in blocks of about `most_places` (item, term) pairs; what a task holds for the items (vocabulary, lists
of items for each term, heaps) has that bound, however many items there are. An item with more distinct terms than that makes
its block larger by itself.

Defined results: null texts, and texts without a term, hold nothing, don't count in N and are never found; an item with a
null or empty text finds nothing; each row of the items is an item of its own, even if it repeats an item_id or has none;
documents that share a doc_id are ranked one by one, equal scores by ascending doc_id, nulls last; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, ship_by_value

ship_by_value(__name__)

#: Terms in UTF-8 after A-Z have been lower-cased: digits, a-z, and every byte above ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
K = 50
MOST_PLACES = 500_000
#: (item, document, impact) triples that are sorted at a time.
TRIPLES = 2_000_000
GROUPS = 32


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())  # bytes.lower() changes A-Z alone


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
            found = sorted(set(terms_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary())], ["item", "term"])


def _lists(values: list[int], ends: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(values, pa.int32()))


def _index_rows(vocabulary) -> object:
    """doc_id, n, terms, tfs of every document: its number of terms, and the numbers and frequencies of those in the vocabulary."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary.value)}
        for batch in batches:
            lengths, terms, tfs, ends = [], [], [], []
            for text in batch["text"].to_pylist():
                found = terms_of(text)
                lengths.append(len(found))
                for t, c in Counter(found).items():
                    if (i := number.get(t)) is not None:
                        terms.append(i)
                        tfs.append(c)
                ends.append(len(terms))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(lengths, pa.int64()), _lists(terms, ends), _lists(tfs, ends)], ["doc_id", "n", "terms", "tfs"])

    return index


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of keys of 0 or more: the least 16 bits first, one counting pass for each 16 bits that are in use."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    top, shift = int(keys.max(initial=0)), 16
    while top >> shift:
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def accumulate(items: np.ndarray, rows: np.ndarray, impacts: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum the impacts of equal (item, row): items and rows in order, and their sums."""
    keys = items * n_rows + rows
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return *np.divmod(keys[starts], n_rows), np.add.reduceat(impacts[order], starts)


def document_weight(n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """m of documents with n terms, in whole numbers."""
    if int(n.max(initial=0)) * total_docs * 50 < 1 << 62:
        return 50 + 50 * n * total_docs // total_terms
    return np.array([50 + 50 * int(x) * total_docs // total_terms for x in n], np.int64)


class _Best:
    """The k best (score, -doc_id) of each item; a document without an id is below all with the same score."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.heaps, self.floor = k, [[] for _ in range(n_items)], np.ones(n_items, np.int64)

    def add(self, items: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, scores: np.ndarray) -> None:
        able = np.flatnonzero(scores >= self.floor[items])
        items = items[able]
        cuts = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1], [True]])) if len(able) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            item, some = int(items[a]), able[a:b]
            if b - a > self.k:  # only those that reach the k-th best of these
                least = np.partition(scores[some], b - a - self.k)[b - a - self.k]
                some = some[scores[some] >= least]
            heap = self.heaps[item]
            for score, doc, none in zip(scores[some].tolist(), ids[some].tolist(), unnamed[some].tolist(), strict=True):
                entry = (score, -(1 << 64) if none else -doc)
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[item] = heap[0][0]

    def rows(self) -> pa.RecordBatch:
        flat = [(i, None if d == -(1 << 64) else -d, s) for i, heap in enumerate(self.heaps) for s, d in heap]
        columns = zip(*flat, strict=True) if flat else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["at", "doc_id", "score"])


def _score_rows(sent, k: int) -> object:
    """The best of each item among a task's stored rows."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, first, fan, listed, n_items, total_docs, total_terms = sent.value
        best = _Best(n_items, k)
        for batch in batches:
            ids = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            unnamed = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            m = document_weight(batch["n"].to_numpy(), total_docs, total_terms)
            lists = batch["terms"]
            terms = lists.flatten().to_numpy().astype(np.int64)
            tf = batch["tfs"].flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            rows = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
            impact = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[rows]))
            # cut between rows, so that each document is summed whole
            made = np.concatenate([[0], np.cumsum(fan[terms])])[np.concatenate([[0], ends])]
            cuts = np.unique(np.concatenate([[0], np.searchsorted(made, np.arange(TRIPLES, made[-1] + TRIPLES, TRIPLES), "right") - 1, [len(ids)]]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                s = slice(ends[a - 1] if a else 0, ends[b - 1])
                t, n = terms[s], fan[terms[s]]
                if not n.sum():
                    continue
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at, row, sums = accumulate(listed[np.repeat(first[t], n) + inner], np.repeat(rows[s] - a, n), np.repeat(impact[s], n), int(b - a))
                best.add(at, ids[a + row], unnamed[a + row], sums)
        yield best.rows()

    return score


def _search_block(docs: DataFrame, places: DataFrame, k: int) -> DataFrame | None:
    """item, doc_id, score: for the items of one block, candidates that hold the k best of each."""
    spark = docs.sparkSession
    pairs = places.collect()  # a block: bounded by most_places
    items = sorted({r["item"] for r in pairs})
    vocabulary = sorted({bytes(r["term"]) for r in pairs})
    if not vocabulary:
        return None
    number, place = {t: i for i, t in enumerate(vocabulary)}, {x: i for i, x in enumerate(items)}
    index = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index_rows(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, tfs array<int>")
    index = materialize(index.where("n > 0"), "lexical-index")
    total_docs, total_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not total_docs:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for term, c in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect():  # of the block's vocabulary
        df[term] = c
    weight = np.array([math.floor(1000 * math.log((2 * total_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    of = np.array([(number[bytes(r["term"])], place[r["item"]]) for r in pairs], np.int64)
    of = of[np.lexsort((of[:, 1], of[:, 0]))]
    fan = np.bincount(of[:, 0], minlength=len(vocabulary))
    fan_used = np.where((weight > 0) & (df > 0), fan, 0)  # a term of weight 0 adds nothing
    sent = spark.sparkContext.broadcast((weight, np.cumsum(fan) - fan, fan_used, of[:, 1].copy(), len(items), total_docs, total_terms))
    found = index.where(F.size("terms") > 0).mapInArrow(_score_rows(sent, k), "at long, doc_id long, score long").withColumn("task", F.spark_partition_id())
    names = spark.createDataFrame(list(enumerate(items)), "at long, item long")
    return found.join(F.broadcast(names), "at").select("item", "task", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, most_places: int = MOST_PLACES) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents (doc_id, text) of each item (item_id, text)."""
    spark: SparkSession = docs.sparkSession
    listed = materialize(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "lexical-items")
    places = materialize(listed.select("item", "text").mapInArrow(_item_terms, "item long, term binary"), "lexical-places")
    blocks = max(1, math.ceil(places.count() / most_places))
    parts = [_search_block(docs, places.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k) for b in range(blocks)]
    parts = [p for p in parts if p is not None]
    if not parts:
        empty = spark.createDataFrame([], "rank int, doc_id long, score long")
        return listed.select("item_id").limit(0).join(empty, F.lit(True)).select("item_id", "rank", "doc_id", "score")
    found = materialize(reduce(DataFrame.unionByName, parts), "lexical-best")  # finding the ranges reads it twice
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    by_group = found.withColumn("part", F.pmod("task", F.lit(GROUPS)))
    few = by_group.repartitionByRange("item", "part").withColumn("rank", F.row_number().over(W.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    last = few.repartitionByRange("item").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return last.join(listed.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
c AS (SELECT count(*)::BIGINT AS N, sum(len(w))::BIGINT AS L FROM d WHERE len(w) > 0),
it AS (SELECT DISTINCT q, t FROM (SELECT q, unnest(w) AS t FROM i)),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
wt AS (SELECT t, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS wt FROM df, c),
m AS (SELECT r, doc_id, 50 + ((50 * len(w)::BIGINT * N) // L) AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT q, r, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM it JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (r) GROUP BY q, r),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= 50
"""
