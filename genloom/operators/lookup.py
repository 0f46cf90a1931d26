"""Lookups, checks and small helpers around keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def resolve(rows: DataFrame, names: DataFrame, key: str, most_broadcast: int = 200_000) -> DataFrame:
    """Rows with the attributes of what their key names; a key that names nothing gives nulls, and one that names more
    than one row is an error."""
    if (bad := names.groupBy(key).count().where("count > 1").first()) is not None:
        raise ValueError(f"{key} {bad[key]} names {bad['count']} rows")
    few = names.limit(most_broadcast + 1).count() <= most_broadcast
    return rows.join(F.broadcast(names) if few else names, key, "left")


def clusters_of(genes: DataFrame, members: DataFrame, core_only: bool = True) -> DataFrame:
    """Genes with the first cluster (by name) whose core, or any part, has them."""
    found = members.where("is_core") if core_only else members
    return genes.join(found.groupBy("gene_id").agg(F.min("cluster_id").alias("cluster_id")), "gene_id", "left")


def check_one_cluster(members: DataFrame) -> DataFrame:
    """`members`, unless a gene is core in two clusters, which is an error."""
    bad = members.where("is_core").groupBy("gene_id").agg(F.countDistinct("cluster_id").alias("n")).where("n > 1").first()
    if bad is not None:
        raise ValueError(f"{bad['gene_id']} is core in {bad['n']} clusters")
    return members


def without_partitions(rows: DataFrame, removed: DataFrame, key: str = "genome_id") -> DataFrame:
    return rows.join(removed.select(key).distinct(), key, "left_anti")


def known_types(types: Column, aliases: dict[str, str], known: list[str]) -> Column:
    """Sorted distinct types after aliasing, those unknown as `other`."""
    table = F.create_map(*[F.lit(x) for kv in {**{k: k for k in known}, **aliases}.items() for x in kv])
    return F.array_sort(F.array_distinct(F.transform(types, lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), F.lit("other")))))


def find_fields(schema: DataType, name: str, path: str = "") -> list[str]:
    """Paths of all fields with a name, however nested."""
    if isinstance(schema, ArrayType):
        return find_fields(schema.elementType, name, path + "[]")
    if isinstance(schema, MapType):
        return find_fields(schema.valueType, name, path + "{}")
    if not isinstance(schema, StructType):
        return []
    out = []
    for field in schema.fields:
        here = f"{path}.{field.name}".lstrip(".")
        out += ([here] if field.name == name else []) + find_fields(field.dataType, name, here)
    return out
