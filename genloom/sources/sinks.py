"""Writers: reports, networks, attribute maps, GenBank files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.summary import or_na


def cluster_report(clusters: DataFrame, tag_columns: list[str]) -> DataFrame:
    """A text row for each cluster: span, score to two places, counts, score statistics (N/A where missing), tags joined."""
    return clusters.select(
        "cluster_id", "genome_id", "scaffold_id", "strand", (F.col("start") + 1).alias("start"), "end", F.round("score", 2).alias("score"), "n_core", "n_precursors",
        or_na(F.col("cog_avg")).alias("cog_avg"), or_na(F.col("cog_std")).alias("cog_std"), *[F.array_join(F.array_sort(c), ",").alias(c) for c in tag_columns],
    )


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.option("sep", "\t").option("header", header).csv(path)


def network(edges: DataFrame, kinds: list[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Both directions of combined edges (src, dst, jaccard, seed_weight, combined), rounded, with the edge's kind. An edge
    that only has the combined weight is `combined_only`. kinds: only edges of these. nodes: cluster_id and attributes,
    which become the source's `src_...` columns; `has_reference` tells whether either end has `is_reference`."""
    both = edges.unionByName(edges.withColumn("_s", F.col("src")).withColumn("src", F.col("dst")).withColumn("dst", F.col("_s")).drop("_s"))
    kind = F.when(F.col("jaccard").isNotNull() & F.col("seed_weight").isNotNull(), "precursor_domains").when(F.col("seed_weight").isNotNull(), "precursor").when(F.col("jaccard").isNotNull(), "jaccard").otherwise("combined_only")
    out = both.select("src", "dst", kind.alias("kind"), F.round("seed_weight", 3).alias("seed_weight"), F.round("jaccard", 2).alias("jaccard"), F.round("combined", 2).alias("combined")).distinct()
    out = out if kinds is None else out.where(F.col("kind").isin(kinds))
    if nodes is None:
        return out
    own = nodes.select(F.col("cluster_id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in nodes.columns if c != "cluster_id"])
    out = out.join(own, "src", "left")
    if "is_reference" in nodes.columns:
        other = nodes.select(F.col("cluster_id").alias("dst"), F.col("is_reference").alias("_dst_reference"))
        out = out.join(other, "dst", "left").withColumn("has_reference", F.coalesce("src_is_reference", F.lit(False)) | F.coalesce("_dst_reference", F.lit(False))).drop("_dst_reference")
    return out


def weighted_pairs(edges: DataFrame, least: float | None = None) -> DataFrame:
    """src, dst, weight rows for graph tools; weights under `least` are dropped."""
    rows = edges.select("src", "dst", "weight")
    return rows if least is None else rows.where(F.col("weight") >= least)


def attribute_json(df: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """(key, json): each row's attributes, without those that have their default value."""

    def kept(c: str) -> Column:
        return F.when(F.col(c) != F.lit(defaults[c]), F.col(c)) if c in defaults else F.col(c)

    return df.select(key, F.to_json(F.struct(*[kept(c).alias(c) for c in df.columns if c != key])).alias("json"))


def group_json(groups: DataFrame) -> DataFrame:
    """(group_id, json): the sorted names of each group."""
    return groups.groupBy("group_id").agg(F.to_json(F.array_sort(F.collect_set("cluster_id"))).alias("json"))


def genbank_records(clusters: DataFrame, genes: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """(cluster_id, record): a GenBank record of each cluster, in coordinates from its extra_start. genes: cluster_id,
    gene_id, start, end, strand, transl."""
    from ..functions.sequence import dna_slice

    at = lambda c: F.col(c) - F.col("extra_start")
    span = F.concat((at("start") + 1).cast("string"), F.lit(".."), at("end").cast("string"))
    where = F.when(F.col("strand") == "-", F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)
    placed = genes.join(clusters.select("cluster_id", "extra_start"), "cluster_id")
    line = F.concat(F.lit("     CDS             "), where, F.lit('\n                     /locus_tag="'), F.col("gene_id"), F.lit('"'), F.coalesce(F.concat(F.lit('\n                     /translation="'), F.col("transl"), F.lit('"')), F.lit("")))
    features = placed.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "gene_id", line.alias("t")))), lambda x: x["t"]), "\n").alias("features"))
    rows = clusters.join(features, "cluster_id").join(scaffolds.select("genome_id", "scaffold_id", "seq"), ["genome_id", "scaffold_id"])
    dna = F.lower(dna_slice(F.col("seq"), F.col("extra_start"), F.col("extra_end"), F.lit("+")))
    locus = F.substring(F.reverse(F.substring(F.reverse("cluster_id"), 1, 27)), 1, 27)
    head = F.concat(F.lit("LOCUS       "), locus, F.lit(" "), F.length(dna).cast("string"), F.lit(" bp    DNA\nFEATURES             Location/Qualifiers\n"))
    return rows.select("cluster_id", F.concat(head, F.col("features"), F.lit("\nORIGIN\n"), origin_lines(dna), F.lit("\n//")).alias("record"))


def origin_lines(dna: Column) -> Column:
    """A sequence in GenBank's lines of six blocks of ten, numbered from 1."""
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.length(dna), F.lit(1)) - 1) / 60).cast("int"))
    line = lambda i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.regexp_replace(F.substring(dna, i * 60 + 1, F.lit(60)), "(.{10})(?=.)", "$1 "))
    return F.array_join(F.transform(starts, line), "\n")


def write_genbank(records: DataFrame, path: str, per_cluster: bool = False) -> None:
    """Files of many records, or one folder for each cluster."""
    rows = records.select(F.col("record").alias("value"), "cluster_id")
    if per_cluster:
        rows.write.partitionBy("cluster_id").text(path)
    else:
        rows.select("value").write.text(path)
