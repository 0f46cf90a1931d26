import numpy as np
import pytest
from pyspark.sql import functions as F

from genloom.functions import sequence
from genloom.operators import lookup
from genloom.plans import scorer


def test_lookups(spark):
    members = spark.createDataFrame([("k1", "a", True), ("k2", "b", False), ("k3", "b", True)], "cluster_id string, gene_id string, is_core boolean")
    genes = spark.createDataFrame([("a", "g1"), ("b", "g2"), ("c", "g1")], "gene_id string, genome_id string")
    assert {r.gene_id: r.cluster_id for r in lookup.clusters_of(genes, members).collect()} == {"a": "k1", "b": "k3", "c": None}
    assert lookup.check_one_cluster(members).count() == 3
    with pytest.raises(ValueError):
        lookup.check_one_cluster(members.withColumn("is_core", F.lit(True)))
    with pytest.raises(ValueError):
        lookup.resolve(genes, members, "gene_id")
    assert lookup.resolve(members, genes, "gene_id").where("genome_id = 'g2'").count() == 2
    assert [r.gene_id for r in lookup.without_partitions(genes, genes.where("genome_id = 'g1'")).collect()] == ["b"]
    types = spark.createDataFrame([(["Lanthi", "x", "thio"],)], "t array<string>").select(lookup.known_types(F.col("t"), {"lanthi": "lanthipeptide"}, ["thio"]).alias("t"))
    assert types.first()["t"] == ["lanthipeptide", "other", "thio"]
    nested = spark.createDataFrame([], "a struct<id: int, b: array<struct<id: int>>>, id int").schema
    assert lookup.find_fields(nested, "id") == ["a.id", "a.b[].id", "id"]


def test_peptides_are_scored(spark, tmp_path):
    n = len(sequence.FEATURES)
    members = [("rbf", np.zeros((1, n)), np.array([10.0]), 0.0, 0.0), ("poly3", np.zeros((1, n)), np.array([10.0]), 0.0, 0.0), ("poly4", np.zeros((1, n)), np.array([0.0]), 0.0, 0.0)]
    score = sequence.kernel_ensemble(members, np.zeros(n), np.ones(n))
    rows = spark.createDataFrame([("p", "MKC"), ("q", "AAAA")], "gene_id string, transl string")
    got = scorer.score_peptides(rows, score, 0.8)
    assert got.count() == 2 and got.first()["score"] == pytest.approx((1 / (1 + np.exp(-10)) * 2 + 0.5) / 3)
    assert scorer.score_peptides(rows, score, 0.9).count() == 0
    assert scorer.peptide_table(rows).columns == ["gene_id", *sequence.FEATURES]
    (tmp_path / "x.fasta").write_text(">p\nMKC\n>q\nAA\n")
    scorer.score_fasta(spark, str(tmp_path / "x.fasta"), f"{tmp_path}/out", score, 0.8)
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/out").count() == 2
