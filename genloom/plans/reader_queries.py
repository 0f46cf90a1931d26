"""Readers as queries: text tables in the formats of sequence tools are written from the test tables into the shared folder,
and read back. Families, profiles and tag sets over the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph, tags
from ..operators.scratch import shared_folder
from ..sources import fasta, genbank, tables
from .network_queries import DNA, dna
from .ordered_queries import table


def _folder(spark) -> str:
    path = f"{shared_folder(spark)}/genloom/text-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def _written(lines, spark, head: str = "# a comment"):
    """The folder of a text table: `lines` has one column; a line of comment goes before."""
    path = _folder(spark)
    spark.createDataFrame([(head,)], "value string").unionByName(lines.toDF("value")).write.text(path)
    return path


def _fields(*columns, sep="\t"):
    return F.concat_ws(sep, *[c.cast("string") if not isinstance(c, str) else F.lit(c) for c in columns])


def hit_table(spark, sf_dir):
    """Lines of orders as similarity hits, through a ten-column table."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    row = _fields(F.concat(F.lit("o"), F.col("l_orderkey")), F.concat(F.lit("p"), F.col("l_partkey")), F.col("l_quantity"), F.col("l_linenumber"), "1", "0", F.col("l_suppkey"), "7", "1e-5", F.col("l_extendedprice"))
    return tables.read_hits(spark, _written(l.select(row), spark)).select("q", "s", "pident", "length", "qlen", "evalue", "bitscore")


HIT_TABLE = "SELECT 'o' || l_orderkey AS q, 'p' || l_partkey AS s, l_quantity::DOUBLE AS pident, l_linenumber::INT AS length, l_suppkey::INT AS qlen, 1e-5::DOUBLE AS evalue, l_extendedprice::DOUBLE AS bitscore FROM lineitem"


def domain_table(spark, sf_dir):
    """Parts' types as domain hits, through white-space columns."""
    p = table(spark, sf_dir, "part")
    row = _fields(F.concat(F.lit("g"), F.col("p_partkey")), "-", "90", F.col("p_type"), F.concat(F.lit("PF"), F.col("p_size"), F.lit(".12")), *["-"] * 7, "0.5", *["-"] * 4, F.col("p_size"), F.col("p_size") + 9, "x", "y", sep="   ")
    return tables.read_domains(spark, _written(p.select(row), spark), "parts")


DOMAIN_TABLE = "SELECT 'g' || p_partkey AS gene_id, 'parts' AS db, 'PF' || p_size AS domain_id, p_size::INT AS ali_from, (p_size + 9)::INT AS ali_to, 0.5::DOUBLE AS evalue FROM part"


def gene_call_table(spark, sf_dir):
    """Customers' orders as gene calls on a scaffold for each customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    calls = o.select("o_custkey", F.col("o_orderkey").alias("n"), F.concat(F.lit(">"), F.col("o_orderkey"), F.lit("_"), F.col("o_orderkey") + 1, F.lit("_"), F.col("o_orderkey") + 91, F.when(F.col("o_orderkey") % 2 == 0, "_+").otherwise("_-")).alias("value"))
    heads = o.select("o_custkey").distinct().select("o_custkey", F.lit(-1).cast("long").alias("n"), F.concat(F.lit('# Sequence Data: seqnum=1;seqlen=9;seqhdr="c'), F.col("o_custkey"), F.lit(' a customer"')).alias("value"))
    path = _folder(spark)
    heads.unionByName(calls).repartition(4, "o_custkey").sortWithinPartitions("o_custkey", "n").select("value").write.text(path)
    return tables.read_gene_calls(spark, path, "G")


GENE_CALL_TABLE = """SELECT 'G_c' || o_custkey || '_' || o_orderkey AS gene_id, 'G' AS genome_id, 'c' || o_custkey AS scaffold_id, o_orderkey::INT AS "start", (o_orderkey + 91)::INT AS "end", CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders"""


def taxonomy_table(spark, sf_dir):
    """Suppliers under nations under regions under a root, as taxonomy nodes, and assemblies of suppliers below a region."""
    line = lambda node, parent, rank: _fields(node, "|", parent, "|", rank, "|")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    regions = table(spark, sf_dir, "region").select(line(name("r", "r_regionkey"), F.lit("1"), F.lit("region")))
    nations = table(spark, sf_dir, "nation").select(line(name("n", "n_nationkey"), name("r", "n_regionkey"), F.lit("nation")))
    supplier = table(spark, sf_dir, "supplier")
    suppliers = supplier.select(line(name("s", "s_suppkey"), name("n", "s_nationkey"), F.lit("supplier")))
    nodes = tables.read_tax_nodes(spark, _written(regions.union(nations).union(suppliers), spark, "1\t|\t1\t|\troot\t|"))
    row = _fields(name("A", "s_suppkey"), "a", "b", "c", "Representative genome", "d", name("s", "s_suppkey"), F.col("s_name"), "strain=x", "e", "f", F.when(F.col("s_suppkey") % 2 == 0, "Complete Genome").otherwise("Contig"), *["-"] * 7, "ftp://x", "-")
    assemblies = tables.read_assemblies(spark, _written(supplier.select(row), spark))
    found, _ = graph.below(assemblies, nodes, "r2", ["complete genome"])
    return found.select("accession", "tax_id", "name", "level", "ftp")


TAXONOMY_TABLE = "SELECT 'A' || s_suppkey AS accession, 's' || s_suppkey AS tax_id, s_name AS name, 'Complete Genome' AS level, 'ftp://x' AS ftp FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 AND s_suppkey % 2 = 0"


def category_table(spark, sf_dir):
    """Parts' names by type, as category files with switched-off lines; and descriptions that win over them."""
    p = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_name")
    path = _folder(spark)
    body = p.groupBy("p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: F.concat(F.when(x["p_partkey"] % 5 == 0, "#").otherwise(""), F.lit("D"), x["p_partkey"].cast("string"), F.lit("\t"), x["p_name"])), "\n").alias("b"))
    body.select(F.concat(F.lit("# note\n\n"), F.col("p_type"), F.lit("\n"), F.col("b")).alias("value"), F.col("p_type").alias("t")).write.partitionBy("t").text(path)
    found = tables.read_categories(spark, f"{path}/t=*")
    told = tables.read_descriptions(spark, _written(p.where("p_partkey % 3 = 0").select(_fields(F.concat(F.lit("D"), F.col("p_partkey")), "-", "-", "-", F.concat(F.lit("told "), F.col("p_name")))), spark))
    return found.join(told.withColumnRenamed("descr", "told"), "domain_id", "left").select("category", "domain_id", F.coalesce("told", "descr").alias("descr"))


CATEGORY_TABLE = "SELECT p_type AS category, 'D' || p_partkey AS domain_id, CASE WHEN p_partkey % 3 = 0 THEN 'told ' ELSE '' END || p_name AS descr FROM part WHERE p_partkey % 5 <> 0"


def group_table(spark, sf_dir):
    """Parts by name and size as tab-separated groups of two or more; the names that a list switches on."""
    p = table(spark, sf_dir, "part")
    lines = p.groupBy("p_name", "p_size").agg(F.array_join(F.collect_list(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))), "\t").alias("value")).select("value")
    path = _folder(spark)
    lines.write.text(path)
    names = _folder(spark)
    p.where("p_partkey % 2 = 0").groupBy("p_brand").agg(F.array_join(F.collect_list(F.concat(F.lit(" p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))), "\t").alias("value")).select("value").write.text(names)
    return tables.read_groups(spark, path, 2).join(tables.read_names(spark, names), F.col("node") == F.col("name"), "left_semi")


GROUP_TABLE = """WITH g AS (SELECT 'p' || lpad(p_partkey::VARCHAR, 9, '0') AS node, p_partkey, min('p' || lpad(p_partkey::VARCHAR, 9, '0')) OVER w AS group_id, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_name, p_size))
SELECT group_id, node FROM g WHERE n >= 2 AND p_partkey % 2 = 0"""


def fasta_round_trip(spark, sf_dir):
    """Each document's DNA through FASTA files, dealt in turn to three folders."""
    path = _folder(spark)
    rows = dna(spark, sf_dir).where("seq <> ''").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "seq")
    fasta.write_fasta(rows, path, "name", "seq", 3)
    return fasta.read_fasta(spark, f"{path}/part=*").select("header", F.length("seq").alias("n"), F.md5("seq").alias("md5"))


FASTA_ROUND_TRIP = f"WITH {DNA} SELECT 'doc' || doc_id AS header, length(seq)::INT AS n, md5(seq) AS md5 FROM dna WHERE seq <> ''"


def genbank_genes(spark, sf_dir):
    """Each document's DNA as a GenBank record with two coding features, one of them without a translation; read as genes."""
    from ..sources import sinks

    seqs = dna(spark, sf_dir).where("length(seq) >= 90").select(F.lit("G").alias("genome_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("scaffold_id"), "seq")
    clusters = seqs.select("genome_id", "scaffold_id", F.col("scaffold_id").alias("cluster_id"), F.lit(0).alias("extra_start"), F.length("seq").alias("extra_end"))
    gene = lambda n, start, end, strand, transl: clusters.select("cluster_id", F.concat("cluster_id", F.lit(n)).alias("gene_id"), F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(strand).alias("strand"), F.lit(transl).alias("transl"))
    path = _folder(spark)
    sinks.write_genbank(sinks.genbank_records(clusters, gene("a", 0, 30, "+", "MKKK").unionByName(gene("b", 30, 90, "-", None)), seqs), path)
    found = genbank.genes(genbank.read_genbank(spark, path))
    return found.select("gene_id", "scaffold_id", "start", "end", "strand", F.length("transl").alias("n_aa"))


GENBANK_GENES = f"""WITH {DNA}, s AS (SELECT 'doc' || doc_id AS id, translate(reverse(substr(seq, 31, 60)), 'ACGT', 'TGCA') AS t, substr(seq, 31, 3) AS last FROM dna WHERE length(seq) >= 90)
SELECT id || 'a' AS gene_id, id AS scaffold_id, 0 AS "start", 30 AS "end", '+' AS strand, 4 AS n_aa FROM s
UNION ALL SELECT id || 'b', id, 30, 90, '-', CASE WHEN substr(t, 58, 3) IN ('TAA', 'TAG', 'TGA') THEN 19 ELSE 20 END FROM s"""


def group_families(spark, sf_dir):
    """Groups of parts (one name and size) as groups of the suppliers that sell them, without groups of reference ones only."""
    groups = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_name", F.col("p_size").cast("string")).alias("group_id"), F.col("p_partkey").alias("node"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("cluster_id")).distinct()
    reference = table(spark, sf_dir, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("cluster_id"))
    return graph.families(groups, links, reference)


GROUP_FAMILIES = """WITH f AS (SELECT DISTINCT p_name || '/' || p_size AS group_id, l_suppkey AS cluster_id FROM part JOIN lineitem ON l_partkey = p_partkey)
SELECT group_id, cluster_id FROM f WHERE group_id IN (SELECT group_id FROM f WHERE cluster_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12))"""


def profile_groups(spark, sf_dir):
    """Suppliers of a nation that pass one of two sets of minima, in nations that keep more than one; reference ones pass."""
    from .genome import profiles

    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    big, small = F.collect_set(F.when(F.col("p_type") == "LARGE", F.col("l_partkey"))), F.collect_set(F.when(F.col("p_type") == "SMALL", F.col("l_partkey")))
    clusters = lines.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_core"), (F.avg("l_discount") * 2).alias("cog_avg"), big.alias("genes_large"), small.alias("genes_small"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("group_id"))
    clusters = clusters.select(F.col("l_suppkey").alias("cluster_id"), "n_core", "cog_avg", "genes_large", "genes_small", (F.col("l_suppkey") % 10 == 0).alias("is_reference"))
    groups = supplier.select("group_id", F.col("s_suppkey").alias("cluster_id"))
    return profiles(clusters, groups, {"large": {"genes_min_large": 90}, "both": {"genes_min_large": 80, "genes_min_small": 85}})


PROFILE_GROUPS = """WITH c AS (SELECT l_suppkey AS c, count(*) AS n, avg(l_discount) * 2 AS cog, count(DISTINCT CASE WHEN p_type = 'LARGE' THEN l_partkey END) AS large, count(DISTINCT CASE WHEN p_type = 'SMALL' THEN l_partkey END) AS small, l_suppkey % 10 = 0 AS ref FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
p AS (SELECT 'large' AS profile, * FROM c WHERE ref OR (n >= 3 AND cog <= 0.25 AND large >= 90) UNION ALL SELECT 'both', * FROM c WHERE ref OR (n >= 3 AND cog <= 0.25 AND large >= 80 AND small >= 85)),
g AS (SELECT profile, s_nationkey AS group_id, c AS cluster_id, count(*) FILTER (NOT ref) OVER (PARTITION BY profile, s_nationkey) AS k FROM p JOIN supplier ON s_suppkey = c)
SELECT profile, group_id, cluster_id FROM g WHERE k > 1"""


def order_tag_sets(spark, sf_dir):
    """Brands and parts of each order's lines by type: all of them, those of its cheap lines are flanks, returned ones hits."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("p_size") > 25, "large").otherwise("small")
    rows = lines.select(
        F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").cast("string").alias("gene_id"), (F.col("l_quantity") > 10).alias("is_core"), (F.col("l_returnflag") == "R").alias("svm_hit"),
        F.array("p_brand").alias("domains"), F.array(kind).alias("categories"), F.create_map(kind, F.array("p_brand")).alias("class_domains"),
    )
    found = tags.cluster_tag_sets(rows, ["large"])
    return found.select("cluster_id", "n_core", *[F.array_join(c, ",").alias(c) for c in ("precursors", "all_domains", "large", "large_all", "genes_large", "genes_large_all")])


ORDER_TAG_SETS = """WITH r AS (SELECT l_orderkey AS o, l_partkey::VARCHAR AS g, l_quantity > 10 AS core, l_returnflag = 'R' AS hit, p_brand AS d, p_size > 25 AS large FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT o AS cluster_id, count(*) FILTER (core) AS n_core, COALESCE(string_agg(DISTINCT g, ',' ORDER BY g) FILTER (core AND hit), '') AS precursors, COALESCE(string_agg(DISTINCT d, ',' ORDER BY d) FILTER (core), '') AS all_domains,
  COALESCE(string_agg(DISTINCT d, ',' ORDER BY d) FILTER (core AND NOT hit AND large), '') AS large, COALESCE(string_agg(DISTINCT d, ',' ORDER BY d) FILTER (NOT hit AND large), '') AS large_all,
  COALESCE(string_agg(DISTINCT g, ',' ORDER BY g) FILTER (core AND NOT hit AND large), '') AS genes_large, COALESCE(string_agg(DISTINCT g, ',' ORDER BY g) FILTER (NOT hit AND large), '') AS genes_large_all FROM r GROUP BY 1"""


QUERIES = {
    "hit_table": (hit_table, HIT_TABLE), "domain_table": (domain_table, DOMAIN_TABLE), "gene_call_table": (gene_call_table, GENE_CALL_TABLE), "taxonomy_table": (taxonomy_table, TAXONOMY_TABLE),
    "category_table": (category_table, CATEGORY_TABLE), "group_table": (group_table, GROUP_TABLE), "fasta_round_trip": (fasta_round_trip, FASTA_ROUND_TRIP), "genbank_genes": (genbank_genes, GENBANK_GENES),
    "group_families": (group_families, GROUP_FAMILIES), "profile_groups": (profile_groups, PROFILE_GROUPS), "order_tag_sets": (order_tag_sets, ORDER_TAG_SETS),
}
