"""Bounded traversal: impact and model impact by level-wise joins (G01, G02, G06), file dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

IMPACT = ["Imports", "DependsOn", "Calls", "Implements", "Tests"]
MODEL_IMPACT = ["Imports", "DependsOn", "Calls", "Contains", "Exposes", "Migrates"]


def impact(edges: DataFrame, roots: DataFrame, types: list[str] = IMPACT, levels: int = 3) -> DataFrame:
    """(root_id, id, level): what reaches each root(root_id) against the edges' direction, breadth first, each node
    once per root at its least level. The root itself is level 0 and left out. Many roots are walked at once; a level
    only joins the previous frontier."""
    back = cut(edges.where(F.col("type").isin(types)).select(F.col("target_id").alias("id"), F.col("source_id").alias("next")).where("id <> next").distinct())
    front = roots.select("root_id", F.col("root_id").alias("id")).distinct()
    seen = front.withColumn("level", F.lit(0))
    for level in range(1, levels + 1):
        reached = front.join(back, "id").select("root_id", F.col("next").alias("id")).distinct()
        front = cut(reached.join(seen.select("root_id", "id"), ["root_id", "id"], "left_anti"))  # read by the next level and the result
        seen = seen.unionByName(front.withColumn("level", F.lit(level)))
    return seen.where("level > 0")


def model_impact(nodes: DataFrame, edges: DataFrame, roots: DataFrame, levels: int = 3) -> DataFrame:
    """(root_id, id, level, category): service, controller, transfer (DTO and view models), migration, other."""
    role = F.coalesce(F.element_at("properties", "architectural_role"), F.lit(""))
    category = F.when(F.col("type") == "Service", "service").when(role == "controller", "controller").when(F.col("type").isin("DTO", "ViewModel"), "transfer").when(F.col("type") == "Migration", "migration").otherwise("other")
    found = impact(edges, roots, MODEL_IMPACT, levels)
    return found.join(nodes.select("id", category.alias("category")), "id").select("root_id", "id", "level", "category")


def file_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, peer_path, relation): dependencies out of and dependents into a file by Imports and DependsOn, and
    callers from other files."""
    at = nodes.where("file_path <> ''").select("id", "file_path")
    e = edges.where("type in ('Imports', 'DependsOn', 'Calls')").select("type", "source_id", "target_id")
    e = e.join(at.select(F.col("id").alias("source_id"), F.col("file_path").alias("s")), "source_id").join(at.select(F.col("id").alias("target_id"), F.col("file_path").alias("t")), "target_id").where("s <> t")
    out = e.where("type <> 'Calls'").select(F.col("s").alias("file_path"), F.col("t").alias("peer_path"), F.lit("dependency").alias("relation"))
    back = e.select(F.col("t").alias("file_path"), F.col("s").alias("peer_path"), F.when(F.col("type") == "Calls", "caller").otherwise("dependent").alias("relation"))
    return out.unionByName(back).distinct()


DIFF_TYPES = ["Imports", "DependsOn", "Calls", "Implements", "Tests"]


def diff_impact(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """changed(path, status) -> (path, id, peer_id, peer_path, type): what other files point at the symbols of changed
    files; deleted files are skipped."""
    live = changed.where("status <> 'deleted'").select("path").distinct()
    own = nodes.join(live, F.col("file_path") == F.col("path")).select("path", F.col("id").alias("target_id"))
    e = edges.where(F.col("type").isin(DIFF_TYPES)).select("type", "source_id", "target_id")
    peer = nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("peer_path"))
    return own.join(e, "target_id").join(peer, "source_id").where("peer_path <> path").select("path", F.col("target_id").alias("id"), F.col("source_id").alias("peer_id"), "peer_path", "type").distinct()


def branch_symbols(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Symbols of the files changed on a branch."""
    live = changed.where("status <> 'deleted'").select(F.col("path").alias("file_path")).distinct()
    return nodes.where("type <> 'File'").join(live, "file_path", "left_semi")
