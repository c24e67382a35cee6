"""Connected components of an edge table: forests inside tasks, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.deploy import ship
from fieldscope.durable import cut

#: Edges that one task contracts at a time: 16 bytes each.
AT_ONCE = 1 << 20


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest v of each u.

    The sum with 0 hides from Spark that the rows are already dealt by u: a join with them then deals both
    sides anew, and Spark may split the edges of a node with very many neighbours among tasks.
    """
    return edges.groupBy(F.col("u").alias("g")).agg(F.min("v").alias("m")).select((F.col("g") + F.lit(0)).alias("u"), "m")


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (u, v), and of each the smallest node reachable over them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, top = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        high, low = np.maximum(top[a], top[b]), np.minimum(top[a], top[b])
        apart = high != low
        if not apart.any():
            return nodes, nodes[top]
        a, b = a[apart], b[apart]
        np.minimum.at(top, high[apart], low[apart])
        while not np.array_equal(up := top[top], top):
            top = up


def _forests(most: int):
    """Arrow function: the edges of a task, ``most`` at a time, as (node, its smallest node)."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def tree() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(table["u"].to_numpy(), table["v"].to_numpy())], ["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield tree()
                held, n = [], 0
        if held:
            yield tree()

    return joined


def connected_components(edges: DataFrame, left: str, right: str, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component) for every node that an edge touches; component is the smallest node reachable.

    Nodes are longs. Self loops, repeated edges and either orientation are fine; edges with a null end are
    ignored. Every task first contracts its own edges to a forest. If the forests have ``at_once`` edges at
    most, one task (of so bounded a size) joins them. Else rounds follow: each sends every edge to the smallest
    neighbour of its ends (minimum by partial aggregation, then a join that AQE may split at hot nodes); they
    end when no edge moves, after about log(n) rounds. Forests and rounds are checkpointed.
    """
    ship(edges.sparkSession)
    known = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    known = known.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    e = cut(known.mapInArrow(_forests(at_once), "u long, v long"))
    if e.count() <= at_once:
        return e.coalesce(1).mapInArrow(_forests(2 * at_once + 1), "u long, v long").toDF("node", "component")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = cut(e.where("u > v").distinct())
    before = None
    while (now := _digest(e)) != before and now[0]:
        before = now
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        both = both.select("e.u", "e.v")
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _least(large)
        small = large.join(low, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        e = cut(small.distinct())
    root = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
