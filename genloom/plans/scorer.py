"""Peptides from files to scores: read, compute features, score, keep what passes, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import FEATURES, peptide_vector
from ..sources.fasta import read_fasta
from ..sources.sinks import write_tsv


def peptide_table(peptides: DataFrame, name: str = "gene_id", seq: str = "transl") -> DataFrame:
    """(name, the 36 features)."""
    rows = peptides.select(F.col(name), peptide_vector(F.col(seq)).alias("f"))
    return rows.select(name, *[F.col("f")[i].alias(f) for i, f in enumerate(FEATURES)])


def score_peptides(peptides: DataFrame, scorer, cutoff: float = 0.9, name: str = "gene_id", seq: str = "transl") -> DataFrame:
    """(name, seq, poly4, poly3, rbf, score) of peptides scored strictly above the cutoff."""
    rows = peptides.select(name, seq, scorer(peptide_vector(F.col(seq))).alias("s"))
    return rows.select(name, seq, "s.*").where(F.col("score") > cutoff)


def mark_hits(genes: DataFrame, hits: DataFrame) -> DataFrame:
    """Genes with svm_hit set where they are among the hits."""
    return genes.drop("svm_hit").join(hits.select("gene_id", F.lit(True).alias("svm_hit")).distinct(), "gene_id", "left").withColumn("svm_hit", F.coalesce("svm_hit", F.lit(False)))


def score_fasta(spark: SparkSession, path: str, out: str, scorer, cutoff: float = 0.9) -> None:
    """FASTA in, a table of passing peptides out."""
    write_tsv(score_peptides(read_fasta(spark, path), scorer, cutoff, "header", "seq"), out)
