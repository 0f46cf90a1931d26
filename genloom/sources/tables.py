"""Readers of the text tables that sequence tools write. Paths may be files, folders or globs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Ten-column similarity table; lines with # are comments."""
    return spark.read.schema(schema.HIT).option("sep", "\t").option("comment", "#").csv(path)


def read_domains(spark: SparkSession, path: str, db: str) -> DataFrame:
    """Domain hits from white-space columns: 1 protein, 5 accession (without version), 13 independent e-value, 18 and 19
    coordinates; # lines are comments."""
    f = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(f, F.lit(i))
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(
        at(0).alias("gene_id"), F.lit(db).alias("db"), F.regexp_replace(at(4), r"\.\d+$", "").alias("domain_id"), at(17).cast("int").alias("ali_from"), at(18).cast("int").alias("ali_to"), at(12).cast("double").alias("evalue")
    )


def read_gene_calls(spark: SparkSession, path: str, genome_id: str) -> DataFrame:
    """Gene coordinates (`>n_start_end_strand` lines after a header with seqhdr="..."): starts become 0-based, names are
    numbered with the genome's prefix. A sequence's lines follow its header, so the scan's rows end where a header's name begins
    and a large file is split by bytes."""
    blocks = spark.read.option("lineSep", 'seqhdr="').text(path)
    named = blocks.select(F.regexp_extract("value", r'^([^"\s#>]+)[^"\n]*"', 1).alias("name"), F.explode(F.filter(F.split("value", r"\r?\n"), lambda x: x.startswith(">"))).alias("value"))
    rows = named.withColumn("scaffold_id", F.when(F.col("name") != "", F.col("name")))
    g = lambda i: F.regexp_extract("value", r"^>(\d+)_(\d+)_(\d+)_([+-])", i)
    return rows.select(F.concat(F.lit(f"{genome_id}_"), F.col("scaffold_id"), F.lit("_"), g(1)).alias("gene_id"), F.lit(genome_id).alias("genome_id"), "scaffold_id", (g(2).cast("int") - 1).alias("start"), g(3).cast("int").alias("end"), g(4).alias("strand"))


def read_tax_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy nodes: tab-separated columns 0, 2 and 4."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) > 4).select(f[0].alias("tax_id"), f[2].alias("parent_id"), f[4].alias("rank"))


def read_assemblies(spark: SparkSession, path: str) -> DataFrame:
    """Assembly summary: # lines are headers; columns 0, 4, 6, 7, 8, 11 and 19."""
    f = F.split("value", "\t")
    names = {"accession": 0, "category": 4, "tax_id": 6, "name": 7, "strain": 8, "level": 11, "ftp": 19}
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(f) > 19)).select(*[f[i].alias(n) for n, i in names.items()])


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Category files: the first active line names the category, the others are `id<tab or space>description`; # switches
    a line off."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#")).alias("x")).where(F.size("x") > 0)
    rows = lines.select(F.col("x")[0].alias("category"), F.explode(F.slice("x", 2, 1 << 30)).alias("line"))
    f = F.split("line", r"[\t ]+", 2)
    return rows.select("category", f[0].alias("domain_id"), F.coalesce(F.get(f, F.lit(1)), F.lit("")).alias("descr"))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Five-column accession table: accession and description."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) >= 5).select(f[0].alias("domain_id"), f[4].alias("descr"))


def read_groups(spark: SparkSession, path: str, min_size: int = 1) -> DataFrame:
    """(group_id, node): one tab-separated group on each line; small ones are dropped."""
    rows = spark.read.text(path).select(F.filter(F.split("value", "\t"), lambda x: x != "").alias("g")).where(F.size("g") >= min_size)
    return rows.select(F.array_min("g").alias("group_id"), F.explode("g").alias("node"))


def read_orf_table(spark: SparkSession, path: str, columns: str, header: bool = True, key: str | None = None) -> DataFrame:
    """Tab-separated rows; with `key`, a repeated key is an error."""
    rows = spark.read.schema(columns).option("sep", "\t").option("header", header).csv(path)
    if key is not None and (bad := rows.groupBy(key).count().where("count > 1").first()) is not None:
        raise ValueError(f"{key} {bad[key]} is repeated")
    return rows


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Names separated by tabs or lines."""
    return spark.read.text(path).select(F.explode(F.split("value", r"[\t\r]")).alias("name")).select(F.trim("name").alias("name")).where("name <> ''").distinct()


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def find_input(spark: SparkSession, folder: str, extension: str, word: str | None = None, without: str | None = None) -> str:
    """The one file in a folder (of any store that Spark reads) with an extension, a word in its name, and not another;
    more or none is an error. Empty files count, too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = {f.getPath().getName(): f.getPath().toString() for f in listed if f.isFile()}
    found = [full for name, full in names.items() if name.endswith(extension) and (word or "") in name and not (without and without in name)]
    if len(found) != 1:
        raise FileNotFoundError(f"{'no' if not found else 'more than one'} file *{extension} in {folder}")
    return found[0]


def newest(paths: DataFrame, path: str = "path", date: str = "date") -> DataFrame:
    """The path with the latest date: which stored result to load."""
    return paths.agg(F.max_by(path, date).alias(path))
