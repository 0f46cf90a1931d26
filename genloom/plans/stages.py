"""Hand-off between stages: a stage's tables in a folder, and a manifest, written last, that makes them whole.

A run of a stage is `<path>/<stage>/<run>/`, one Parquet table for each name, then `manifest`: one line of JSON with the time, and of
each table its schema and its number of files. A run without a manifest, or with other files than it names, isn't whole and is
passed over; the newest whole run is loaded. All files are read and written by Spark, so the folder may be in any store it knows.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def save_stage(tables: dict[str, DataFrame], path: str, stage: str) -> str:
    """Write the tables as a new run; returns its folder."""
    if not tables:
        raise ValueError("a stage has a table at least")
    spark = next(iter(tables.values())).sparkSession
    run = f"{path.rstrip('/')}/{stage}/{uuid.uuid4().hex}"
    told = {}
    for name, df in tables.items():
        df.write.parquet(f"{run}/{name}")
        told[name] = {"schema": json.loads(df.schema.json()), "files": len(spark.read.schema(df.schema).parquet(f"{run}/{name}").inputFiles())}
    manifest = json.dumps({"stage": stage, "saved": datetime.now(timezone.utc).isoformat(), "tables": told})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{run}/manifest")
    return run


def _runs(spark: SparkSession, path: str, stage: str) -> list[tuple[dict, str]]:
    """Manifests and folders of the runs that have one, the newest first."""
    folder = f"{path.rstrip('/')}/{stage}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/manifest/part-*")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        return []
    rows = spark.read.text(f"{folder}/*/manifest").select("value", F.regexp_extract("_metadata.file_path", r"/([^/]+)/manifest/", 1).alias("run")).collect()
    found = []
    for r in rows:
        try:
            found.append((json.loads(r["value"]), f"{folder}/{r['run']}"))
        except ValueError:  # a manifest that was cut off
            continue
    return sorted(found, key=lambda x: (x[0]["saved"], x[1]), reverse=True)


def load_stage(spark: SparkSession, path: str, stage: str) -> dict[str, DataFrame]:
    """The tables of the newest whole run, with the schemas they were saved with."""
    for manifest, run in _runs(spark, path, stage):
        tables = {name: spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{run}/{name}") for name, t in manifest["tables"].items() if _there(spark, f"{run}/{name}")}
        if len(tables) == len(manifest["tables"]) and all(len(df.inputFiles()) == manifest["tables"][name]["files"] for name, df in tables.items()):
            return tables
    raise FileNotFoundError(f"no whole run of stage {stage} in {path}")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
