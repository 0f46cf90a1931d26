"""The two genome stages as flows of DataFrames.

Stage 1: genes and a similarity table give every gene its conservation frequency. Stage 2: scored genes give clusters,
annotated, filtered, scored, linked and grouped. Each stage's tables can be written as Parquet and read by the next.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import predicates as P
from ..operators import graph, intervals, ordered, orthology, sequential, similarity, summary, tags
from ..operators.scratch import store


@dataclass
class Conservation:
    genes: DataFrame
    tuples: DataFrame
    cutoffs: DataFrame
    classes: DataFrame


def _grown(pairs: DataFrame, true: DataFrame, genomes: list[str], config: EngineConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tuples, their pairs of genes, cutoffs by pair of genomes) of a group of genomes."""
    tuples = store(orthology.unique_tuples(orthology.grow_tuples(true, genomes)) if len(genomes) > 1 else true.sparkSession.createDataFrame([], "tuple_id long, genes array<struct<genome:string,gene:string>>"))
    within = orthology.tuple_pairs(tuples)
    scored = pairs.join(within.select(F.col("a").alias("q"), F.col("b").alias("s")), ["q", "s"], "left_semi").where("genome_q < genome_s")
    scored = scored.select(F.col("genome_q").alias("genome_a"), F.col("genome_s").alias("genome_b"), ((F.col("pident_qs") + F.col("pident_sq")) / 2).alias("score"))
    return tuples, within, store(orthology.adaptive_cutoffs(scored, ["genome_a", "genome_b"], "score", config.cutoff_std_factor))


def conservation(genes: DataFrame, hits: DataFrame, config: EngineConfig | None = None) -> Conservation:
    """Stage 1. genes: see schema.GENE; hits: see schema.HIT. The genomes' list is small and kept on the driver.

    If the tuples of all genomes are too few or their least cutoff too low, groups of genomes that share enough take their
    place; a pair of genomes in several groups has the mean of their cutoffs."""
    config = config or EngineConfig()
    plain = store(genes.where("not intergenic"))
    rows = store(orthology.read_coverage(hits, plain, config.min_coverage))
    pairs = store(orthology.mutual_best(rows, config.mutual_min_pident))
    near = ordered.flanks(genes, ["genome_id", "scaffold_id"], "start", "end", "gene_id", F.col("intergenic")).select(F.col("gene_id").alias("id"), "left_id", "right_id")
    near = store(near)
    true = orthology.conserved_neighbours(pairs.select(F.col("q").alias("a"), F.col("s").alias("b")), near, near)
    true = pairs.join(true.select(F.col("a").alias("q"), F.col("b").alias("s")), ["q", "s"], "left_semi")
    genomes = sorted(r["genome_id"] for r in plain.select("genome_id").distinct().collect())
    covered = plain.select(F.lit(1).alias("group_no"), F.col("genome_id").alias("genome")).distinct()
    tuples, within, cutoffs = _grown(pairs, true, genomes, config)
    worst = cutoffs.agg(F.min("cutoff")).first()[0]
    if tuples.count() < config.min_group_tuples or worst is None or worst < config.min_group_cutoff:
        # all genomes together are no group: groups of those that share more
        groups = orthology.covering_groups(orthology.genome_groups(true, config.min_group_tuples, config.min_group_genomes))
        found = true.sparkSession.createDataFrame([(i, g) for i, group in enumerate(groups, 1) for g in group], "group_no int, genome string")
        grown = [_grown(pairs, true, group, config) for group in groups]
        if grown:
            covered = found
            tuples, within, each = (reduce(DataFrame.unionByName, x) for x in zip(*grown, strict=True))
            cutoffs = store(each.groupBy("genome_a", "genome_b").agg(F.sum("n").alias("n"), F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.avg("cutoff").alias("cutoff")))
    edges = orthology.filter_by_cutoff(rows, cutoffs, within.where("a < b") if config.propagate_true_pairs else None)
    groups = graph.markov_clusters(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), config.inflation)
    of = plain.select(F.col("gene_id").alias("node"), F.col("genome_id").alias("genome"))
    classes = store(groups.join(of, "node").select(F.col("group_id").alias("class_id"), F.col("node").alias("gene"), "genome"))
    found = orthology.occurrence(classes, covered)
    return Conservation(orthology.with_default_occurrence(genes, found, len(genomes)), tuples, cutoffs, classes)


def simple_clusters(genes: DataFrame, gap: int = 750) -> DataFrame:
    """(cluster_id, gene_id, is_core): runs on one strand around hits; `genes` without the runs that hold none."""
    placed = ordered.runs(genes, ["genome_id", "scaffold_id"], "start", "end", "gene_id", gap, ["strand"])
    kept = ordered.seeded(placed, ["genome_id", "scaffold_id", "run"], F.col("svm_hit"))
    return kept.select(F.concat_ws("_", "genome_id", "scaffold_id", F.col("run").cast("string")).alias("cluster_id"), "gene_id", F.lit(True).alias("is_core"))


def island_clusters(genes: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """As simple_clusters, by islands of close genes: lone seeds join a neighbour, then islands with like scores fuse."""
    config = config or EngineConfig()
    keys = ["genome_id", "scaffold_id"]
    placed = store(ordered.two_level_islands(genes, keys, "start", "end", "gene_id", config.gene_gap, config.island_gap, ["strand"]))
    islands = ordered.islands_of(placed, keys, "start", "end", ["region", "island"])
    lone = ordered.merge_lone(islands, keys)
    seeds = placed.where("svm_hit").select(*keys, "island").distinct()
    moved = lone.join(seeds, [*keys, "island"], "left_semi").select(*keys, "island", "merged")  # only lone seeds move
    rows = store(placed.join(moved, [*keys, "island"], "left").withColumn("island", F.coalesce("merged", "island")).drop("merged"))
    fused = sequential.island_fusion(rows.select(*keys, "region", "island", "cog", "svm_hit"), [*keys, "region"], "island", "cog", "svm_hit", config.island_score_gap)
    members = rows.join(fused, [*keys, "region", "island"])
    return members.select(F.concat_ws("_", *keys, F.col("seed_island").cast("string")).alias("cluster_id"), "gene_id", F.lit(True).alias("is_core"))


def merged_clusters(members: DataFrame, genes: DataFrame, gap: int = 50) -> DataFrame:
    """Clusters of a scaffold and strand merged over small gaps; (cluster_id, gene_id, is_core), renumbered by place."""
    rows = members.select("cluster_id", "gene_id").join(genes, "gene_id")
    spans = rows.groupBy("cluster_id", "genome_id", "scaffold_id", "strand").agg(F.min("start").alias("start"), F.max(F.struct("start", "end"))["end"].alias("end"))
    merged = ordered.coalesce_intervals(spans, ["genome_id", "scaffold_id", "strand"], "start", "end", "cluster_id", gap)
    named = merged.select("cluster_id", F.concat_ws("_", "genome_id", "scaffold_id", F.when(F.col("strand") == "+", "p").otherwise("m"), F.col("merged").cast("string")).alias("merged_id"))
    return members.join(named, "cluster_id").select(F.col("merged_id").alias("cluster_id"), "gene_id", "is_core").distinct()


def extended_clusters(members: DataFrame, genes: DataFrame, by: int = 5) -> DataFrame:
    """(cluster_id, gene_id, ord, is_core): clusters with up to `by` genes on either side."""
    annotated = genes.where("not intergenic or svm_hit").join(members, "gene_id", "left")
    out = ordered.extend(annotated.select("genome_id", "scaffold_id", "start", "gene_id", "cluster_id").distinct(), ["genome_id", "scaffold_id"], "start", "gene_id", "cluster_id", by)
    return out.select("cluster_id", "gene_id", "ord", "is_core")


def annotated_clusters(members: DataFrame, genes: DataFrame, domains: DataFrame, classes: DataFrame) -> DataFrame:
    """Clusters with spans, statistics, tag sets and score. domains: gene_id, db, domain_id, ali_from, ali_to, evalue
    (overlapping hits are resolved here); classes: category, domain_id."""
    kept = sequential.greedy_intervals(domains, ["gene_id", "db"], "ali_from", "ali_to", ["evalue", "ali_from", "domain_id"]).select("gene_id", "domain_id")
    kept = store(kept)
    typed = tags.categories(genes.select("gene_id"), "gene_id", kept.withColumnRenamed("domain_id", "tag"), classes.select("category", F.col("domain_id").alias("tag")))
    per_class = kept.join(classes, "domain_id").groupBy("gene_id", "category").agg(F.array_sort(F.collect_set("domain_id")).alias("d")).groupBy("gene_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "d"))).alias("class_domains"))
    lists = kept.groupBy("gene_id").agg(F.array_sort(F.collect_set("domain_id")).alias("domains"))
    rows = store(members.join(genes.drop("cog").join(genes.select("gene_id", "cog"), "gene_id"), "gene_id").join(typed, "gene_id").join(per_class, "gene_id", "left").join(lists, "gene_id", "left"))
    names = sorted(r["category"] for r in classes.select("category").distinct().collect())
    sets = tags.cluster_tag_sets(rows, names).drop("n_core")
    counted = rows.where("is_core and not svm_hit").withColumn("first", tags.first_class(F.col("categories")))
    counts = counted.groupBy("cluster_id").agg(*[F.count_if(F.col("first") == c).alias(f"count_{c}") for c in tags.CLASS_ORDER])
    spans = summary.cluster_rows(rows, ["cluster_id", "genome_id", "scaffold_id"])
    out = spans.join(sets, "cluster_id").join(counts, "cluster_id", "left").fillna(0, [f"count_{c}" for c in tags.CLASS_ORDER])
    base = tags.base_score({c: F.col(f"count_{c}") for c in tags.CLASS_ORDER})
    return out.withColumn("score", tags.cluster_score(base, F.col("n_precursors"), F.col("cog_avg")))


def with_overlaps(clusters: DataFrame, external: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """Clusters with `overlaps`: array of (ext_id, product, kind, fraction) of known clusters that they overlap."""
    placed = intervals.with_contig_fallback(external, scaffolds).select("genome_id", "scaffold_id", "ext_id", "product", F.col("start").alias("ext_start"), F.col("end").alias("ext_end"))
    found = intervals.overlaps(clusters.select("genome_id", "scaffold_id", "cluster_id", "start", "end"), placed.drop("product"), ["genome_id", "scaffold_id"])
    found = found.join(placed.select("ext_id", "product").distinct(), "ext_id").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("ext_id", "product", "kind", "fraction"))).alias("overlaps"))
    return clusters.join(found, "cluster_id", "left")


def profiles(clusters: DataFrame, groups: DataFrame, settings: dict[str, dict[str, float]], config: EngineConfig | None = None) -> DataFrame:
    """(profile, group_id, cluster_id): for each named set of minima the clusters that pass, in groups that keep more than
    one that isn't a reference; reference clusters always pass."""
    config = config or EngineConfig()
    out = None
    for name, minima in settings.items():
        test = P.from_settings(minima, config.min_core_genes, config.max_avg_cog)
        passed = clusters.where(test | F.coalesce("is_reference", F.lit(False))).select("cluster_id", "is_reference")
        kept = groups.join(passed, "cluster_id")
        large = kept.groupBy("group_id").agg(F.count_if(~F.col("is_reference")).alias("n")).where("n > 1").select("group_id")
        rows = kept.join(large, "group_id", "left_semi").select(F.lit(name).alias("profile"), "group_id", "cluster_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@dataclass
class Networks:
    edges: DataFrame
    seed_groups: DataFrame
    tag_groups: DataFrame
    combined_groups: DataFrame
    genome_groups: DataFrame


def networks(clusters: DataFrame, members: DataFrame, seed_hits: DataFrame, config: EngineConfig | None = None, genomes: DataFrame | None = None) -> Networks:
    """Clusters linked by their tags and by their seeds' similarity, grouped by each and by both. Families of the size of
    one are dropped but for combined ones. genomes: genome_id of all genomes; one without clusters is a group with a null
    cluster_id."""
    config = config or EngineConfig()
    tagged = store(similarity.set_join(clusters.select("cluster_id", "all_domains"), "cluster_id", "all_domains", config.jaccard))
    seeds = store(similarity.seed_edges(seed_hits, config.seed_max_evalue, config.seed_min_bitscore))
    gene_groups = graph.markov_clusters(seeds.select(F.col("q").alias("src"), F.col("s").alias("dst"), F.col("bitscore").alias("weight")), config.inflation, config.min_family)
    links = members.where("is_core").select(F.col("gene_id").alias("node"), "cluster_id").distinct()
    seed_groups = store(graph.families(gene_groups, links))
    lift = lambda x, y: links.select(F.col("node").alias(x), F.col("cluster_id").alias(y))
    lifted = store(similarity.lift_edges(seeds.select(F.col("q").alias("a"), F.col("s").alias("b"), F.col("pident").alias("weight")), lift("a", "src"), lift("b", "dst")))
    edges = store(similarity.combine_edges(tagged, lifted.where("src < dst")))
    tag_groups = graph.markov_clusters(tagged.withColumnRenamed("jaccard", "weight"), config.inflation, config.min_family).withColumnRenamed("node", "cluster_id")
    both = graph.markov_clusters(edges.where("combined is not null").select("src", "dst", F.col("combined").alias("weight")), config.inflation).withColumnRenamed("node", "cluster_id")
    by_genome = clusters.select("genome_id", "cluster_id")
    by_genome = by_genome if genomes is None else genomes.select("genome_id").distinct().join(by_genome, "genome_id", "left")
    return Networks(edges, seed_groups, tag_groups, both, by_genome.withColumnRenamed("genome_id", "group_id"))
