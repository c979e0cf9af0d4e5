"""Graph operators over (source_id, target_id, rel_type): bounded expansion, paths, degrees.

Every step is an equi-join of a frontier with the edges; visited nodes are removed with
an anti-join.  Breadth-first operators write each frontier before the next step, so that a
step reads the edges once; paths and walks are one plan, bounded by MAX_HOPS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import cut

MAX_HOPS = 10


def degrees(edges: DataFrame) -> DataFrame:
    """(entity_id, out_degree, in_degree)."""
    ends = edges.select(F.col("source_id").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target_id").alias("entity_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("entity_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def neighbors(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """Breadth-first: (entity_id, depth, via), each node at its first depth; ties take the least type.  The start is left out."""
    depth = max(0, min(depth, MAX_HOPS))
    seen = edges.sparkSession.createDataFrame([(start, 0, None)], "entity_id string, depth int, via string")
    frontier = seen
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("entity_id").alias("source_id")), "source_id")
        frontier = cut(step.groupBy(F.col("target_id").alias("entity_id")).agg(F.min("rel_type").alias("via")).join(seen.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lit(d).alias("depth"), "via"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def simple_paths(edges: DataFrame, source: str, target: str, max_hops: int) -> DataFrame:
    """Node-simple paths that stop at the target: (hops, nodes), nodes joined with '>'."""
    max_hops = max(0, min(max_hops, MAX_HOPS))
    e = edges.select("source_id", "target_id").distinct()
    walk = e.where(F.col("source_id") == source).select(F.array("source_id", "target_id").alias("nodes"), F.col("target_id").alias("at")).where(F.col("at") != source)
    found = None
    for d in range(1, max_hops + 1):
        done = walk.where(F.col("at") == target).select(F.lit(d).alias("hops"), F.array_join("nodes", ">").alias("nodes"))
        found = done if found is None else found.unionByName(done)
        if d < max_hops:
            walk = walk.where(F.col("at") != target).join(e, F.col("at") == e["source_id"]).where(~F.array_contains("nodes", F.col("target_id"))).select(F.concat("nodes", F.array("target_id")).alias("nodes"), F.col("target_id").alias("at"))
    return found


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int | None = None) -> DataFrame:
    """The first shortest path by node order: (hops, nodes); no row where there is none, or none within max_hops.

    Breadth-first with visited nodes: of all shortest ways to a node only the least text is kept,
    which the least way to any node beyond it begins with.
    """
    spark = edges.sparkSession
    e = edges.select("source_id", "target_id")
    frontier = spark.createDataFrame([(source, source)], "entity_id string, nodes string")
    seen, d = frontier.select("entity_id"), 0
    while source != target and (max_hops is None or d < max_hops):
        d += 1
        step = e.join(frontier, e["source_id"] == frontier["entity_id"]).select("target_id", F.concat_ws(">", "nodes", "target_id").alias("nodes"))
        frontier = cut(step.groupBy(F.col("target_id").alias("entity_id")).agg(F.min("nodes").alias("nodes")).join(seen, "entity_id", "left_anti"))
        found = frontier.where(F.col("entity_id") == target)
        if not found.isEmpty():
            return found.select(F.lit(d).alias("hops"), "nodes")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("entity_id"))
    return spark.createDataFrame([], "hops int, nodes string")


def hops(edges: DataFrame, start: str, k: int) -> DataFrame:
    """Distinct (entity_id, depth) reached by directed walks of 1..k edges."""
    k = max(1, min(k, MAX_HOPS))
    e = edges.select("source_id", "target_id").distinct()
    at = e.where(F.col("source_id") == start).select(F.col("target_id").alias("entity_id")).distinct()
    out = at.withColumn("depth", F.lit(1))
    for d in range(2, k + 1):
        at = at.join(e, at["entity_id"] == e["source_id"]).select(F.col("target_id").alias("entity_id")).distinct()
        out = out.unionByName(at.withColumn("depth", F.lit(d)))
    return out
