"""Benchmark decontamination with a distributed positional inverted index.

The training texts are read once: every token that is a term of the test set becomes a stored posting (row, position,
term), and every row a stored length. For each 13-word window of a test item, the two rarest terms are its anchors
(terms that never occur rule the window out). Anchor postings, shifted by their place in the item, meet on
(row, item, offset): where two anchors agree, all of the item's terms are looked up at that offset, and runs of
consecutive matches at least as long as a window are exact occurrences. Only DataFrame operations are used. Term and
anchor tables have the size of the test set and are broadcast after a check of it; postings of frequent terms stay
where they were read.

Defined results: null and wordless texts have no words and are not contaminated; an item without words occurs nowhere;
an item shorter than a window is one window; items that share an item_id count once; an item with a null
item_id hits words, but isn't counted or named; rows that repeat are judged one
by one; empty tables give empty or clean results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
LENGTH_TERM = -1  # the posting that holds a row's length
MOST_BROADCAST = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


class PositionalIndex:
    """Stored postings of the terms of `items` in `docs`.

    postings: row, pos, term (LENGTH_TERM: doc_id and n_words of the row); places: item, n, j, term."""

    def __init__(self, docs: DataFrame, items: DataFrame) -> None:
        listed = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), words(F.col("text")).alias("w"))
        listed = materialize(listed.where(F.size("w") > 0), "phrase-items")
        self.items = listed.select("item", "item_id")
        spelled = listed.select("item", F.size("w").alias("n"), F.posexplode("w").alias("j", "word"))
        terms = spelled.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term"))
        terms = materialize(terms.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(LENGTH_TERM).cast("long").alias("term"))), "phrase-terms")
        self.n_terms = terms.count()
        self.places = materialize(spelled.join(terms, "word").select("item", "n", "j", "term"), "phrase-places")
        self.n_places = self.places.count()
        rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
        rows = rows.select("doc_id", "row", F.size("w").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("at", "word"))
        length = F.col("term") == LENGTH_TERM
        stored = rows.join(broadcast_if(terms, self.n_terms, MOST_BROADCAST), "word").select(
            "row", (F.col("at") - 1).alias("pos"), "term", F.when(length, F.col("doc_id")).alias("doc_id"), F.when(length, F.col("n_words")).alias("n_words")
        )
        self.postings = materialize(stored, "phrase-postings")

    def rows(self) -> DataFrame:
        """row, doc_id, n_words of every document."""
        return self.postings.where(F.col("term") == LENGTH_TERM).select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))

    def frequencies(self) -> DataFrame:
        return materialize(self.postings.where(F.col("term") != LENGTH_TERM).groupBy("term").agg(F.count(F.lit(1)).alias("cf")), "phrase-counts")

    def anchors(self, frequencies: DataFrame, window: int, per_window: int = 2) -> DataFrame:
        """item, n, j, term: the rarest places of each window whose terms all occur."""
        known = self.places.join(broadcast_if(frequencies, self.n_terms, MOST_BROADCAST), "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
        first, last = F.greatest(F.col("j") - (window - 1), F.lit(0)), F.least(F.col("j"), F.greatest(F.col("n") - window, F.lit(0)))
        inside = known.withColumn("w", F.explode(F.sequence(first, last)))
        by = W.partitionBy("item", "w")
        ranked = inside.withColumn("rarest", F.min("cf").over(by)).withColumn("place", F.row_number().over(by.orderBy("cf", "j")))
        return ranked.where((F.col("rarest") > 0) & (F.col("place") <= per_window)).select("item", "n", "j", "term").distinct()

    def alignments(self, window: int) -> DataFrame:
        """row, item, diag: offsets of an item in a row at which two anchors (one, for one-word items) agree."""
        anchors = materialize(self.anchors(self.frequencies(), window), "phrase-anchors")
        met = self.postings.select("row", "pos", "term").join(broadcast_if(anchors, anchors.count(), MOST_BROADCAST), "term")
        agreed = met.groupBy("row", "item", (F.col("pos") - F.col("j")).alias("diag")).agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
        return agreed.where(F.col("c") >= F.least(F.col("n"), F.lit(2))).select("row", "item", "diag")

    def occurrences(self, window: int = WINDOW) -> DataFrame:
        """row, item, diag, j, pos: words of rows inside exact occurrences of the items' windows."""
        found = materialize(self.alignments(window), "phrase-alignments")
        wanted = found.join(broadcast_if(self.places, self.n_places, MOST_BROADCAST), "item").select("row", "item", "diag", "n", "j", (F.col("diag") + F.col("j")).alias("pos"), "term")
        hit_rows = materialize(found.select("row").distinct(), "phrase-rows")
        lists = self.postings.select("row", "pos", "term").join(broadcast_if(hit_rows, hit_rows.count(), MOST_BROADCAST), "row", "left_semi")
        matched = wanted.join(lists, ["row", "pos", "term"])
        by = W.partitionBy("row", "item", "diag")
        runs = matched.withColumn("run", F.col("j") - F.row_number().over(by.orderBy("j")))
        runs = runs.withColumn("length", F.count(F.lit(1)).over(W.partitionBy("row", "item", "diag", "run")))
        return runs.where(F.col("length") >= F.least(F.col("n"), F.lit(window))).select("row", "item", "diag", "j", "pos")

    def near(self, slack: int = 3) -> DataFrame:
        """row, item, pos: proximity matches, where every term of an item lies within `slack` words more than its length
        around an occurrence of its rarest term."""
        counts = self.frequencies()
        terms = self.places.groupBy("item", "n", "term").agg(F.min("j").alias("j")).join(counts, "term", "left")
        every = W.partitionBy("item")
        terms = terms.withColumn("kinds", F.count(F.lit(1)).over(every)).withColumn("place", F.row_number().over(every.orderBy(F.coalesce("cf", F.lit(0)), "j")))
        terms = materialize(terms.select("item", "n", "term", "kinds", "place"), "phrase-near")
        rare = broadcast_if(terms.where("place = 1"), self.n_places, MOST_BROADCAST)
        lists = self.postings.select("row", "pos", "term")
        starts = lists.join(rare, "term").select("row", "item", "n", "kinds", F.col("pos").alias("at"))
        others = lists.join(broadcast_if(terms.select("item", "term"), self.n_places, MOST_BROADCAST), "term").select("row", "item", "pos", "term")
        close = F.abs(F.col("pos") - F.col("at")) < F.col("n") + slack
        return starts.join(others, ["row", "item"]).where(close).groupBy("row", "item", "at", "kinds").agg(F.countDistinct("term").alias("c")).where("c = kinds").select("row", "item", F.col("at").alias("pos"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a hit, and n_hit at least n_words / share)."""
    index = PositionalIndex(docs, items)
    found = materialize(index.occurrences(window), "phrase-found")
    hits = found.select("row", "pos").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.join(broadcast_if(index.items, index.n_places, MOST_BROADCAST), "item").where("item_id is not null").select("row", F.col("item_id").cast("string").alias("id")).distinct()
    named = named.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    rows = index.rows().join(hits.join(named, "row", "left"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT r, s, l, array_to_string(w[s:s + l - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d) x, (SELECT DISTINCT l FROM iw) y WHERE s + l - 1 <= len(w)),
h AS (SELECT r, s, dw.l, item_id FROM dw JOIN iw ON dw.l = iw.l AND dw.g = iw.g),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS pos FROM h) GROUP BY r),
n AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items, sha256(COALESCE(ids, '')) AS items_sha256,
  COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN n USING (r)
"""
