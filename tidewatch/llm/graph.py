"""Connected components over a distributed edge list, and size-bounded cells for pair work in groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop_staged, staged

#: so many edges of two longs (8 MB) one task may hold, and so many array elements a broadcast
LIGHT_EDGES, LIGHT_ROWS = 500_000, 1_000_000


def _smaller_first(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _with_least(rows: DataFrame) -> DataFrame:
    """Staged rows(a, b) with m, the least b of each a; no task gets all rows of an a with very many."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("copies"))
    return join_classes(rows, staged(least, "least"), key="a")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all edges of one task: labels hook to the smaller one and are shortened until nothing changes."""
    parts = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, place = np.unique(np.concatenate(parts, 1), return_inverse=True)
    x, y = place.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        if (p == q).all():
            break
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def components(edges: DataFrame, max_rounds: int = 60, light_edges: int = LIGHT_EDGES) -> DataFrame:
    """edges(a, b) -> (node, label): label is the smallest node reachable; nodes without an edge are absent.

    Up to light_edges distinct edges are solved in one task of that bounded size.  More go through
    alternating large-star and small-star steps; every step is a partial minimum per
    node and a join with it, where those of the nodes with the most neighbours are
    broadcast.  Each round is written to the shared folder.  Both ways give the same labels.
    """
    now = staged(_smaller_first(edges), "edges")
    if now.count() <= light_edges:
        return now.coalesce(1).mapInArrow(_solve, "node long, label long")
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = staged(now.select("a", "b").union(now.select(F.col("b"), F.col("a"))), "both")
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = staged(large.where("a <> b").distinct(), "large")
        small = _with_least(large).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = staged(small.where("a <> b").distinct(), "edges")
        drop_staged(now, both, large)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def cells(rows: DataFrame, group: str, key: str, block: int = 128, least: int = 1, more: DataFrame | None = None) -> DataFrame:
    """Add (cell_i, cell_j, own): every unordered pair of rows of a group meets in exactly one cell.

    Groups of fewer than `least` rows are left out.  `more`(key, ...) is joined to the rows of the others.

    A group is cut into blocks of about `block` rows by a hash of the key, and each
    cell holds one or two blocks, so no task ever holds a whole group.  In a cell
    with cell_i < cell_j only pairs of different blocks (`own`) are to be compared.
    """
    sized = rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(group, F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.col("_blocks")).cast("int")
    out = rows.join(sized, group).withColumn("own", own)
    if more is not None:
        out = out.join(more, key)
    out = out.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    out = out.withColumn("cell_i", F.least("own", "_j")).withColumn("cell_j", F.greatest("own", "_j")).drop("_j", "_blocks")
    # dealt by cell: the rows' partitioning by group would satisfy a grouping by cell too, with a hot group in one task
    return out.repartition(F.col(group), F.col("cell_i"), F.col("cell_j"))


def join_classes(rows: DataFrame, classes: DataFrame, fraction: int = 1000, key: str = "key") -> DataFrame:
    """rows(key, ...) with the columns of classes(key, copies, ...), where `copies` counts the rows of each key.

    Classes of more than 1/fraction of the rows, which are fewer than `fraction` by that
    alone, are broadcast; so no task gets all copies of a hot class.  Both tables are read
    twice and should be staged.
    """
    hot = F.col("copies") > F.lit(rows.count() // fraction)
    large, small = F.broadcast(classes.where(hot).drop("copies")), classes.where(~hot).drop("copies")
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(small, key))


def left_classes(rows: DataFrame, classes: DataFrame, values: str, key: str = "digest", light_values: int = LIGHT_ROWS) -> DataFrame:
    """rows with the array column `values` of classes(key, copies, values), null where there is none.

    classes, a staged table, is broadcast if all its arrays hold light_values elements at most;
    beyond that only its hot keys are, and rows, which should be staged too, is read three times.
    """
    held = classes.agg(F.coalesce(F.sum(F.size(values) + 1), F.lit(0)).alias("n")).first()["n"]
    if held <= light_values:
        return rows.join(F.broadcast(classes.select(key, values)), key, "left")
    own = classes.select(key)
    without = rows.join(own, key, "left_anti").withColumn(values, F.lit(None).cast(classes.schema[values].dataType))
    return without.unionByName(join_classes(rows.join(own, key, "left_semi"), classes.select(key, "copies", values), key=key))
