"""Tags and their classes: multi-label assignment, tag sets, common tags, and scores from them."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed order in which a row's first class counts, and the classes that have a bonus.
CLASS_ORDER = ("kripp", "transporter", "regulator", "peptidase", "biosyn")
BONUS = {"transporter": 5.0, "peptidase": 3.0, "regulator": 3.0, "biosyn": 0.0}


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """Marked for broadcast if its counted rows are few; otherwise left to a shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def categories(items: DataFrame, key: str, tags: DataFrame, classes: DataFrame, tag: str = "tag", category: str = "category") -> DataFrame:
    """Items with `categories`: the sorted classes of any of their tags; ['other'] without any. tags: key, tag; classes:
    category, tag."""
    found = tags.join(small(classes.select(tag, category)), tag).groupBy(key).agg(F.array_sort(F.collect_set(category)).alias("categories"))
    return items.join(found, key, "left").withColumn("categories", F.coalesce("categories", F.array(F.lit("other"))))


#: Needles of one automaton.
MOST_NEEDLES = 200_000


def substring_classes(items: DataFrame, key: str, text: str, needles: DataFrame) -> DataFrame:
    """(key, label): labels whose needle is inside the text. needles: label, needle. An empty needle is in every text that isn't
    null.

    The needles become an automaton (goto and failure links), sent to all tasks, and each text is read through it once in Arrow
    batches, however many needles there are. More than MOST_NEEDLES are several automata, each with a pass of its own."""
    known = store(needles.select("label", "needle").where("needle is not null").distinct())
    blocks = max(1, -(-known.count() // MOST_NEEDLES))
    kinds = {"key": items.schema[key].dataType.simpleString(), "label": needles.schema["label"].dataType.simpleString()}
    found = None
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b).toArrow()  # a block: about MOST_NEEDLES
        part = items.select(key, text).mapInArrow(_through(items.sparkSession.sparkContext.broadcast(_automaton(rows))), f"`{key}` {kinds['key']}, label {kinds['label']}")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _automaton(rows: pa.Table) -> tuple:
    """The automaton of the needles, whose values are places in the list of labels, and the places of the empty needles."""
    import ahocorasick

    by_needle: dict[str, list[int]] = {}
    for i, needle in enumerate(rows["needle"].to_pylist()):
        by_needle.setdefault(needle, []).append(i)
    built = ahocorasick.Automaton()
    for needle, places in by_needle.items():
        if needle:
            built.add_word(needle, places)
    if len(built):
        built.make_automaton()
    return built, rows["label"].combine_chunks(), by_needle.get("", [])


def _through(sent) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, labels, always = sent.value
        for batch in batches:
            at, of = [], []
            for i, text in enumerate(batch[1].to_pylist()):
                if text is None:
                    continue
                hits = set(always)
                if len(built):
                    for _, places in built.iter(text):
                        hits.update(places)
                at += [i] * len(hits)
                of += sorted(hits)
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(at, pa.int64())), labels.take(pa.array(of, pa.int64()))], [batch.schema.names[0], "label"])

    return run


def tag_sets(rows: DataFrame, key: list[str], tag: str, name: str = "tags", where: Column | None = None) -> DataFrame:
    """(key, name): sorted distinct tags of the rows that pass; empty if none does."""
    counted = F.col(tag) if where is None else F.when(where, F.col(tag))
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set(counted)).alias(name))


def cluster_tag_sets(members: DataFrame, classes: list[str]) -> DataFrame:
    """Of each cluster: n_core, precursors, all_domains, and for each class its tags and genes over core rows that aren't
    hits (precursor: over all core rows), `_all` over core and flanks. members: cluster_id, gene_id, is_core, svm_hit,
    domains, categories (arrays), class_domains (map class -> array)."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(c)))
    core, plain = F.col("is_core"), F.col("is_core") & ~F.col("svm_hit")
    none = F.array().cast("array<string>")
    out = [
        F.count_if(core).alias("n_core"),
        F.array_sort(F.collect_set(F.when(core & F.col("svm_hit"), F.col("gene_id")))).alias("precursors"),
        flat(F.collect_list(F.when(core, F.coalesce("domains", none)))).alias("all_domains"),
    ]
    for c in classes:
        inside = core if c == "precursor" else plain
        mine = F.coalesce(F.try_element_at("class_domains", F.lit(c)), none)
        has = F.array_contains("categories", c)
        out += [
            flat(F.collect_list(F.when(inside, mine))).alias(c), flat(F.collect_list(F.when(~F.col("svm_hit"), mine))).alias(f"{c}_all"),
            F.array_sort(F.collect_set(F.when(inside & has, F.col("gene_id")))).alias(f"genes_{c}"), F.array_sort(F.collect_set(F.when(~F.col("svm_hit") & has, F.col("gene_id")))).alias(f"genes_{c}_all"),
        ]
    return members.groupBy("cluster_id").agg(*out)


def common_tags(members: DataFrame, group: str, item: str, tag: str, share: float = 0.5) -> DataFrame:
    """(group, tag, n_items, n_tagged): tags of at least `share` of a group's items. members: group, item, tag (null: none)."""
    sizes = members.groupBy(group).agg(F.countDistinct(item).alias("n_items"))
    counts = members.where(F.col(tag).isNotNull()).groupBy(group, tag).agg(F.countDistinct(item).alias("n_tagged"))
    return counts.join(sizes, group).where(F.col("n_tagged") >= share * F.col("n_items")).select(group, tag, "n_items", "n_tagged")


def first_class(categories_column: Column, order=CLASS_ORDER) -> Column:
    """The first class, in the fixed order, that the row has."""
    out = F.when(F.lit(False), None)
    for c in order:
        out = out.when(F.array_contains(categories_column, c), c)
    return out


def base_score(counts: dict[str, Column], bonus: dict[str, float] = BONUS) -> Column:
    """Counted rows of each class (each row in its first class), and a bonus where a class has more than one."""
    total = F.lit(0.0)
    for c, n in counts.items():
        total = total + n + F.when(n > 1, F.lit(bonus.get(c, 0.0))).otherwise(0.0)
    return total


def cluster_score(base: Column, n_seeds: Column, cog: Column, seed_weight: float = 1.0, cog_weight: float = 1.0) -> Column:
    """base x seeds^w1 / cog^w2; a missing or zero cog divides by 1."""
    divisor = F.when(cog.isNull() | (cog == 0), F.lit(1.0)).otherwise(cog)
    return base * F.pow(n_seeds.cast("double"), F.lit(seed_weight)) / F.pow(divisor, F.lit(cog_weight))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` over `old`, by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def rename_repeats(df: DataFrame, name: list[str], order: list[str], prefix: Column, out: str = "unique_name") -> DataFrame:
    """Adds `out`: the name where it is used once, otherwise prefix_n, numbered in order."""
    from pyspark.sql import Window as W

    by = W.partitionBy(*name)
    n, place = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy(*order))
    plain = F.concat_ws("_", *[F.col(c).cast("string") for c in name])
    return df.withColumn(out, F.when(n > 1, F.concat_ws("_", prefix, place.cast("string"))).otherwise(plain))


def name_census(df: DataFrame, name: str, start: str, end: str) -> DataFrame:
    """(name, uses): distinct places that carry a name."""
    return df.groupBy(name).agg(F.countDistinct(F.struct(start, end)).alias("uses"))
