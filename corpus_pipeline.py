"""A training corpus from `documents`, stage by stage: quality, near duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of `documents`, but for the last, which
returns where each row goes: doc_id, size, text_crc32, law, shard, slot, grown_shard. A stage's result is written as
Parquet and read again as the next one's docs. Near duplicates and contaminated documents are dropped by their doc_id and
text, so rows with a null doc_id, or one that repeats, are judged by their own text; rows with one id and one text are
copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genloom.llm import decontam, mixing, ngram_join, quality, sharding
from genloom.llm.common import broadcast_if, materialize, stage_scratch

MOST_BROADCAST = 1_000_000
SHARDS = 24

#: The quality classifier is trained on the way, so SQL can't give run()'s rows.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a 64-bit hash of each row's doc_id and text, and the hash's column, unlike any of `docs`.

    The hash is the same on every read, so no copy of the documents has to be stored to tell rows apart; rows that share it
    have one id and one text, and every stage below judges them alike."""
    key = "_key"
    while any(c.startswith(key) for c in docs.columns):
        key = "_" + key
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def _by_key(keyed: DataFrame, key: str) -> DataFrame:
    """The texts of `keyed` with the key as their doc_id."""
    return keyed.select(F.col(key).alias("doc_id"), "text")


def _where_key(keyed: DataFrame, key: str, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of `keyed` with `keys` (column: key); texts are only shuffled if `keys` is too large to send."""
    return keyed.join(broadcast_if(keys, keys.count(), MOST_BROADCAST), key, how)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    with stage_scratch(spark):
        return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id (nulls last) of each class of near duplicates."""
    with stage_scratch(spark):
        keyed, key = _keyed(docs)
        found = ngram_join.near_duplicates(_by_key(keyed, key)).where("n_links > 0")  # rows with others like them
        found = materialize(found.groupBy("class_id", F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias("rows")), "pipeline-classes")
        ids = _where_key(keyed.select(key, "doc_id"), key, found.select(key), "left_semi").distinct()
        members = materialize(found.join(ids, key), "pipeline-members")
        first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", key)
        kept = members.groupBy("class_id").agg(F.min(first)[key].alias(key))
        dropped = members.join(kept.select(key), key, "left_anti").select(key)
        repeated = materialize(members.join(kept.select(key), key, "left_semi").where("rows > 1").select(key), "pipeline-repeated")
        gone = materialize(dropped.unionByName(repeated), "pipeline-dropped")
        once = _where_key(keyed, key, repeated, "left_semi").dropDuplicates([key])
        return _where_key(keyed, key, gone, "left_anti").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to count as contaminated."""
    with stage_scratch(spark):
        keyed, key = _keyed(docs)
        judged = decontam.contamination(_by_key(keyed, key), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        gone = materialize(judged.where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "pipeline-dropped")
        return _where_key(keyed, key, gone, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    with stage_scratch(spark):
        return mixing.mix_documents(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes."""
    with stage_scratch(spark):
        return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
