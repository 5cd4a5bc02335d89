"""Connected components of a graph of any size, by alternating stars."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakecross.sources.tables import stored

# Edges that a task contracts at once.
HELD_EDGES = 4_000_000


def _star(edges: DataFrame) -> DataFrame:
    """Every neighbour of a vertex that is larger than it, moved to the vertex' smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex' smaller neighbours and itself, moved to the smallest of them. Edges have v below u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Edges (node, smallest node of its component) of the graph of edges u - v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            moved = label != np.arange(len(nodes))
            return np.stack([nodes[moved], nodes[label[moved]]], 1)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest with the same components as the edges that a task holds, in parts of bounded size."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        edges = forest(np.concatenate([u for u, _ in held]), np.concatenate([v for _, v in held]))
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0], pa.int64()), pa.array(edges[:, 1], pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("u", "v")])
        size += batch.num_rows
        if size >= HELD_EDGES:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of the edges (u, v) that is not itself the root, its component's smallest vertex.

    Each task first contracts the edges it holds to a forest, so rounds start from few edges. Each round writes its
    edges to the shared folder, so lineage stays short and lost executors cost a task. Neighbours are never gathered
    in one place: minima are pre-aggregated and joined back. Loops and repeated edges do not matter; no edges give no rows.
    """

    def state(frame: DataFrame):
        return frame.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    pairs = edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    current = stored(pairs.mapInArrow(_contracted, "u long, v long").distinct())
    known = state(current)
    while True:
        following = stored(_small_star(_star(current).where("u <> v")).where("u <> v").distinct())
        now = state(following)
        if now == known:
            return following.select(F.col("u").alias("node"), F.col("v").alias("root"))
        current, known = following, now
