"""FASTA in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq): records are split at `>`; of repeated headers the first in its file is kept."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    parts = F.split(F.regexp_replace("value", "^>", ""), "\n", 2)
    rows = raw.select("file", "n", F.trim(parts[0]).alias("header"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("seq")).where("header <> ''")
    first = F.row_number().over(W.partitionBy("header").orderBy("file", "n"))
    return rows.withColumn("_first", first).where("_first = 1").select("header", "seq")


def wrapped(seq: Column, width: int = 75) -> Column:
    """A sequence broken into lines."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def write_fasta(df: DataFrame, path: str, name: str = "gene_id", seq: str = "transl", parts: int | None = None, width: int = 75) -> None:
    """Each name once; with `parts`, records are dealt in turn, in the order of a hash, over that many folders (part=0, 1, ...)."""
    rows = df.select(F.col(name).alias("name"), F.col(seq).alias("seq")).where("seq is not null").dropDuplicates(["name"])
    record = F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrapped(F.col("seq"), width)).alias("value")
    if parts is None:
        rows.select(record).write.text(path)
    else:
        from ..operators.ordered import even_parts

        turns = rows.withColumn("_turn_key", F.pmod(F.xxhash64("name"), F.lit((1 << 53) - 1)))
        even_parts(turns, "_turn_key", parts).select(record, "part").write.partitionBy("part").text(path)
