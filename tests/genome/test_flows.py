"""Readers and writers, and the genome flows from files to networks."""

import pytest
from pyspark.sql import functions as F

from genloom.config import EngineConfig
from genloom import schema
from genloom.plans import genome
from genloom.sources import fasta, genbank, sinks, tables
from genloom.streaming import runs

RECORD = """LOCUS       SC1 200 bp DNA
VERSION     SC1.1
FEATURES             Location/Qualifiers
     source          1..200
     gene            5..40
                     /locus_tag="t1"
     CDS             5..40
                     /locus_tag="t1"
                     /translation="MKPGF
                     KK"
     tRNA            50..60
                     /locus_tag="r1"
     CDS             complement(70..99)
                     /locus_tag="none"
                     /gene="gx|y"
     gene            110..130
                     /locus_tag="p1"
                     /pseudo
     protocluster    1..150
                     /protocluster_number="3"
                     /product="thio"
ORIGIN
        1 acgtatgaaa cccgggtttt aacatgaaac ccgggttttt
       41 aacatgaaac ccgggttttt aacatgaaac ccgggttttt
//
"""


def write(path, text):
    path.write_text(text)
    return str(path)


def test_text_readers(spark, tmp_path):
    hits = tables.read_hits(spark, write(tmp_path / "hits.tsv", "# c\nq\ts\t90.0\t75\t1\t0\t100\t90\t1e-5\t200\n"))
    assert [(r.q, r.pident, r.length) for r in hits.collect()] == [("q", 90.0, 75)]
    cols = ["p1"] + ["x"] * 3 + ["PF1.12"] + ["x"] * 7 + ["1e-9"] + ["x"] * 4 + ["3", "40"]
    assert [tuple(r) for r in tables.read_domains(spark, write(tmp_path / "d.txt", "# c\n" + "  ".join(cols) + "\n"), "pfam").collect()] == [("p1", "pfam", "PF1", 3, 40, 1e-9)]
    sco = tables.read_gene_calls(spark, write(tmp_path / "g.sco", '# Sequence Data: seqhdr="S1"\n>1_5_40_+\n# x seqhdr="S2"\n>1_2_9_-\n'), "G")
    assert sorted((r.gene_id, r.start, r.end, r.strand) for r in sco.collect()) == [("G_S1_1", 4, 40, "+"), ("G_S2_1", 1, 9, "-")]
    cats = tables.read_categories(spark, write(tmp_path / "c.txt", "#x\nkin\nD1\tfirst one\n#D2 off\nD3 third\n"))
    assert sorted(tuple(r) for r in cats.collect()) == [("kin", "D1", "first one"), ("kin", "D3", "third")]
    groups = tables.read_groups(spark, write(tmp_path / "m.txt", "b\ta\tc\nd\n"), 2)
    assert sorted(tuple(r) for r in groups.collect()) == [("a", "a"), ("a", "b"), ("a", "c")]
    nodes = tables.read_tax_nodes(spark, write(tmp_path / "n.dmp", "5\t|\t3\t|\tspecies\t|\n"))
    assert [tuple(r) for r in nodes.collect()] == [("5", "3", "species")]
    asm = tables.read_assemblies(spark, write(tmp_path / "a.txt", "# h\n# h2\n" + "\t".join(f"v{i}" for i in range(22)) + "\n"))
    assert asm.first().asDict() == {"accession": "v0", "category": "v4", "tax_id": "v6", "name": "v7", "strain": "v8", "level": "v11", "ftp": "v19"}
    with pytest.raises(ValueError):
        tables.read_orf_table(spark, write(tmp_path / "o.tsv", "id\tn\na\t1\na\t2\n"), "id string, n int", key="id")
    assert sorted(r.name for r in tables.read_names(spark, write(tmp_path / "l.txt", "a\tb\nc\n")).collect()) == ["a", "b", "c"]
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "x.gbk", "")
    write(tmp_path / "in" / "x_old.gbk", "")
    assert tables.find_input(spark, str(tmp_path / "in"), ".gbk", without="old").endswith("x.gbk")
    with pytest.raises(FileNotFoundError):
        tables.find_input(spark, str(tmp_path / "in"), ".gbk")


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "A" * 160), ("b", "C" * 75), ("b", "G"), ("c", None)], "gene_id string, transl string")
    fasta.write_fasta(df.where("transl <> 'G' or transl is null"), f"{tmp_path}/f", parts=2)
    got = fasta.read_fasta(spark, f"{tmp_path}/f/*/*.txt")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "A" * 160), ("b", "C" * 75)]


def test_genbank(spark, tmp_path):
    features = genbank.read_genbank(spark, write(tmp_path / "G1.gbk", RECORD)).cache()
    assert features.where("type = 'CDS'").count() == 2 and len(genbank.scaffolds(features).first()["seq"]) == 80
    got = {r.gene_id: r for r in genbank.genes(features).collect()}
    assert set(got) == {"t1", "gxy", "p1"} and got["t1"].transl == "MKPGFKK" and got["t1"].start == 4 and got["gxy"].strand == "-" and got["p1"].pseudo and got["t1"].svm_candidate and not got["p1"].svm_candidate
    assert [(r.product, r.start, r.end) for r in genbank.external_clusters(features).collect()] == [("thio", 0, 150)]
    gaps = genbank.intergenic(features, overlap=2).orderBy("gap_id").collect()
    assert gaps[0].gap_start == 0 and len(gaps[0].seq) == 6 and gaps[0].gap_id.endswith("000001")
    assert genbank.short_orfs(features, overlap=60).count() >= 0


def test_reports(spark):
    edges = spark.createDataFrame([("a", "b", 0.666, None, None), ("a", "c", None, 0.91234, None), ("b", "c", None, None, 0.5)], "src string, dst string, jaccard double, seed_weight double, combined double")
    got = {(r.src, r.dst): (r.kind, r.jaccard, r.seed_weight) for r in sinks.network(edges).collect()}
    assert len(got) == 6 and got["b", "a"] == ("jaccard", 0.67, None) and got["c", "a"] == ("precursor", None, 0.912) and got["b", "c"][0] == "combined_only"
    js = sinks.attribute_json(spark.createDataFrame([("k", 0, "x")], "key string, n int, t string"), "key", {"n": 0})
    assert js.first()["json"] == '{"t":"x"}'
    assert sinks.group_json(spark.createDataFrame([("g", "b"), ("g", "a")], "group_id string, cluster_id string")).first()["json"] == '["a","b"]'


def genomes(spark):
    """Three genomes with the same order of twelve genes; ids g<genome>_<place>."""
    rows, hits, domains = [], [], []
    for g in "abc":
        for i in range(12):
            name = f"{g}_{i:02d}"
            seed = i == 5
            rows.append((name, g, f"{g}s", i * 300, i * 300 + 280, "+", "MKC", False, seed, seed, False, None))
            for h in "abc":
                if h != g:
                    hits.append((name, f"{h}_{i:02d}", 80.0 + i, 100, 0, 0, 100, 100, 1e-30, 200.0))
            if i in (3, 4, 6, 7):
                domains.append((name, "db", "T1" if i < 5 else "B1", 1, 50, 1e-9))
    return spark.createDataFrame(rows, schema.GENE), spark.createDataFrame(hits, schema.HIT), spark.createDataFrame(domains, schema.GENE_DOMAIN)


def test_groups_of_genomes_take_the_place_of_all(spark):
    import dataclasses

    rows, hits = [], []
    for half in ("abc", "def"):
        for g in half:
            for i in range(12):
                rows.append((f"{g}_{i:02d}", g, f"{g}s", i * 300, i * 300 + 280, "+", "MKC", False, False, False, False, None))
                hits += [(f"{g}_{i:02d}", f"{h}_{i:02d}", 80.0 + i, 100, 0, 0, 100, 100, 1e-30, 200.0) for h in half if h != g]
    genes, hits = spark.createDataFrame(rows, schema.GENE), spark.createDataFrame(hits, schema.HIT)
    config = dataclasses.replace(EngineConfig(), min_group_genomes=3, min_group_tuples=5)
    found = genome.conservation(genes, hits, config)
    assert found.tuples.count() == 20 and {(r.genome_a, r.genome_b) for r in found.cutoffs.collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("d", "e"), ("d", "f"), ("e", "f")}
    assert {r.cog for r in found.genes.where("gene_id like '%_05'").collect()} == {1.0}
    whole = genome.conservation(genes, hits, dataclasses.replace(config, min_group_genomes=4))  # no group is large enough
    assert whole.tuples.count() == 0 and whole.genes.count() == 72


def test_flows(spark):
    genes, hits, domains = genomes(spark)
    stage1 = genome.conservation(genes, hits)
    scored = {r.gene_id: r.cog for r in stage1.genes.collect()}
    assert len(scored) == 36 and scored["a_05"] == 1.0 and stage1.tuples.count() == 10
    genes = stage1.genes.cache()
    simple = genome.simple_clusters(genes)
    assert simple.count() == 36
    islands = genome.island_clusters(genes)
    members = genome.merged_clusters(islands, genes)
    assert members.select("cluster_id").distinct().count() == 3
    extended = genome.extended_clusters(members, genes)
    classes = spark.createDataFrame([("transporter", "T1", ""), ("biosyn", "B1", "")], schema.DOMAIN_CATEGORY)
    clusters = genome.annotated_clusters(extended, genes, domains, classes).cache()
    row = clusters.where("genome_id = 'a'").first()
    assert (row.n_core, row.n_precursors, row.count_transporter, row.count_biosyn, row.score) == (12, 1, 2, 2, 9.0) and row.all_domains == ["B1", "T1"] and row.precursors == ["a_05"]
    external = spark.createDataFrame([("a", "as.1", "x", "thio", 0, 10_000)], schema.EXTERNAL_CLUSTER)
    scaffolds = genes.select("genome_id", F.concat("scaffold_id", F.lit(".1")).alias("scaffold_id")).distinct()
    assert genome.with_overlaps(clusters.withColumn("scaffold_id", F.concat("scaffold_id", F.lit(".1"))), external, scaffolds).where("overlaps is not null").first()["overlaps"][0]["kind"] == "total"
    seeds = hits.where("q like '%_05' and s like '%_05'")
    found = genome.networks(clusters, extended, seeds)
    assert found.edges.where("kind = 'precursor_domains'").count() == 3
    for groups in (found.seed_groups, found.tag_groups, found.combined_groups):
        assert groups.select("group_id").distinct().count() == 1 and groups.count() == 3
    kept = genome.profiles(clusters.withColumn("is_reference", F.lit(False)).withColumn("cog_avg", F.lit(0.2)), found.tag_groups, {"mild": {"min_biosyn": 1}, "strict": {"min_biosyn": 9}})
    assert {r.profile for r in kept.collect()} == {"mild"} and kept.count() == 3
    records = sinks.genbank_records(clusters.select("cluster_id", "genome_id", "scaffold_id", "extra_start", "extra_end"), extended.join(genes, "gene_id").select("cluster_id", "gene_id", "start", "end", "strand", "transl"), genes.select("genome_id", "scaffold_id").distinct().withColumn("seq", F.lit("ACGT" * 1000)))
    parsed = next(genbank.parse_records(records.first()["record"]))
    assert len(parsed["features"]) == 12 and parsed["features"][0]["start"] == 0
    assert sinks.cluster_report(clusters, ["all_domains"]).first()["cog_std"] == "0.000"


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 03:00:00", 2.0), (1, "2024-01-02 00:00:00", 3.0), (2, "2024-01-01 00:00:00", 4.0), (3, "2024-02-01 00:00:00", 0.0)], "user int, at string, value double").withColumn("at", F.col("at").cast("timestamp")).withColumn("kind", F.lit("k"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, run in (("sessions", lambda d: runs.session_runs(d, ["user"], "at")), ("windows", lambda d: runs.windowed_summary(d, "at", "value", "kind"))):
        q = run(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        got = {tuple(r) for r in spark.sql(f"select * from {name}").collect()}
        want = {tuple(r) for r in run(rows).collect()}
        assert got < want and len(want - got) == 1  # the last window is still open


def test_one_file_of_many_records_is_read_by_many_tasks(spark, tmp_path):
    body = "".join(RECORD.replace("LOCUS       ", f"LOCUS       L{i}").replace("VERSION     ", f"VERSION     V{i}") for i in range(120))
    path = write(tmp_path / "many.gbk", body)
    fields = lambda df: sorted(map(str, df.collect()))
    whole = fields(genbank.read_genbank(spark, path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        records = genbank.read_records(spark, path)
        assert records.rdd.getNumPartitions() > 10 and records.count() == 120
        assert fields(genbank.read_genbank(spark, path)) == whole and len(whole) > 240
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    plan = genbank.read_genbank(spark, path).where("type = 'CDS'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineSep") <= 1 and "Union" not in plan  # no branch for the DNA
