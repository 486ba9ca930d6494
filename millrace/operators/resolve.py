"""Entity resolution over identifier mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpointed


def vertices(mapping: DataFrame) -> DataFrame:
    """Distinct (id, id_type) of both ends."""
    ends = F.array(F.struct(F.col("src_entity_id").alias("id"), F.col("src_id_type").alias("id_type")), F.struct(F.col("dst_entity_id").alias("id"), F.col("dst_id_type").alias("id_type")))
    return mapping.select(F.explode(ends).alias("v")).select("v.id", "v.id_type").distinct()


def edges(mapping: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(a, b) in both directions for mappings with enough confidence."""
    rows = mapping.where(F.col("confidence") >= threshold).select("src_entity_id", "dst_entity_id")
    ends = F.array(F.struct(F.col("src_entity_id").alias("a"), F.col("dst_entity_id").alias("b")), F.struct(F.col("dst_entity_id").alias("a"), F.col("src_entity_id").alias("b")))
    return rows.select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


MISSING = "Missing"


def graph(mapping: DataFrame, known: DataFrame | None = None, threshold: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a mapping; ends of edges that known (id, id_type) lacks have the type Missing."""
    links = edges(mapping, threshold)
    nodes = vertices(mapping) if known is None else known.select("id", "id_type").distinct()
    lost = links.select(F.col("a").alias("id")).distinct().join(nodes, "id", "left_anti").withColumn("id_type", F.lit(MISSING))
    return nodes.unionByName(lost), links


def find_targets(mapping: DataFrame, target_type: str, threshold: float = 1.0, max_hops: int = 20) -> DataFrame:
    """(id, target_id, hops): for each reachable vertex the nearest vertex of a type, the least id of equals.

    Breadth first from the target vertices, so that every hop touches each edge once; stops when nothing
    changes or after max_hops.
    """
    links = edges(mapping, threshold)
    found = frontier = checkpointed(vertices(mapping).where(F.col("id_type") == target_type).select("id", F.col("id").alias("target_id"), F.lit(0).alias("hops")))
    for hop in range(1, max_hops + 1):
        step = links.join(frontier.select(F.col("id").alias("a"), "target_id"), "a").groupBy(F.col("b").alias("id")).agg(F.min("target_id").alias("target_id"))
        frontier = checkpointed(step.join(found.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)))
        if not frontier.limit(1).count():
            break
        found = found.unionByName(frontier)  # of checkpoints: every frontier is written once
    return found


def map_entities(df: DataFrame, id_column: str, mapping: DataFrame, target_type: str, target_column: str, threshold: float = 1.0, max_hops: int = 20) -> DataFrame:
    """df with the resolved target id as its first column; null where nothing is reached."""
    target = find_targets(mapping, target_type, threshold, max_hops).select(F.col("id").alias(id_column), F.col("target_id").alias(target_column))
    return df.join(target, id_column, "left").select(target_column, *df.columns)
