"""Stages handed on through stored runs."""

import os
import shutil

import pytest

from genloom.plans import genome, stages

from .test_flows import genomes


def test_stage_two_starts_from_a_stored_stage_one(spark, tmp_path):
    genes, hits, _ = genomes(spark)
    stage1 = genome.conservation(genes, hits)
    path = str(tmp_path)
    stages.save_stage({"genes": stage1.genes, "classes": stage1.classes}, path, "conservation")
    loaded = stages.load_stage(spark, path, "conservation")
    assert loaded["genes"].schema == stage1.genes.schema and set(loaded) == {"genes", "classes"}
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(loaded["genes"]) == rows(stage1.genes)
    assert rows(genome.simple_clusters(loaded["genes"])) == rows(genome.simple_clusters(stage1.genes)) != []


def test_the_newest_whole_run_is_loaded(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        stages.load_stage(spark, path, "s")
    save = lambda n: stages.save_stage({"t": spark.range(n).repartition(2), "u": spark.range(0).selectExpr("id as x")}, path, "s")
    count = lambda: stages.load_stage(spark, path, "s")["t"].count()
    save(3)
    assert count() == 3 and stages.load_stage(spark, path, "s")["u"].columns == ["x"]
    second = save(5)
    assert count() == 5
    third = save(7)
    part = next(f for f in os.listdir(f"{third}/t") if f.startswith("part-"))
    os.remove(f"{third}/t/{part}")  # a table that lost a file
    assert count() == 5
    spark.range(9).write.parquet(f"{path}/s/unfinished/t")  # a run without a manifest
    assert count() == 5
    manifest = next(f for f in os.listdir(f"{second}/manifest") if f.startswith("part-"))
    os.remove(f"{second}/manifest/.{manifest}.crc")
    with open(f"{second}/manifest/{manifest}", "w") as file:
        file.write('{"stage": "s"')  # cut off
    assert count() == 3
    shutil.rmtree(f"{path}/s")
    with pytest.raises(FileNotFoundError):
        stages.load_stage(spark, path, "s")
