"""Connected components of a graph that is kept distributed: each task contracts its own edges to stars, and what is left is contracted by
one task if it is small, else by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import cut

#: Contracted edges that one task takes together (16 MB); more are joined in rounds, of some ten shuffles each.
ALONE = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (u, v) that isn't the least it can reach, and that least one; loops vanish."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(batches):
    """Edges (u, v), v the lesser, that connect what those of the task do; at most ALONE and a batch lie in memory."""
    u = v = np.zeros(0, np.int64)
    held, rows = [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        rows += batch.num_rows
        if len(u) + rows > ALONE:
            u, v = stars(*(np.concatenate(c) for c in zip((u, v), *held)))
            held, rows = [], 0
            if 2 * len(u) > ALONE:
                yield out()
                u = v = np.zeros(0, np.int64)
    u, v = stars(*(np.concatenate(c) for c in zip((u, v), *held)))
    yield out()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its greater neighbours to the least of itself and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them. Edges point from the greater node u to the smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v: long, no nulls); component is the least node reachable.

    Each round's edges are cut off by a checkpoint. Aggregates combine before the shuffle, so a node of many links is no hot key there.
    """
    named = lambda now: now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    now = cut(edges.select("u", "v").mapInArrow(_contracted, "u long, v long"))
    if now.count() <= ALONE:
        return named(cut(now.coalesce(1).mapInArrow(_contracted, "u long, v long")))
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == state:
            return named(now)
        state = (seen["n"], seen["h"])
        now = cut(_small_star(_large_star(now).distinct()).distinct())
