"""Connected components of large graphs by alternating large-star and small-star rounds.

Neighbourhood minima are partial aggregations. They are written before they meet the edges again: both sides of
that join are then plain shuffles, and adaptive execution splits a node with very many edges over several tasks
(an aggregation in the same stage would forbid it). Each round is cut by checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

ROUNDS = 60


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v), and each one's smallest connected node."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with those of each partition replaced by stars round their smallest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, root = local_roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                own = node != root
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(root[own])], ["a", "b"])

    return edges.mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of the edges, and the smallest node that it is connected with.

    Edges with a null end or equal ends are left out; repeated edges count once; no edges give no rows.
    """
    now = contract(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b"))
    now = materialize(now.distinct())
    for _ in range(ROUNDS):
        n_edges = now.count()
        if n_edges == now.select("a").distinct().count() and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break  # every node has one edge, to the centre of its star
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = both.where("b > a").join(least, "a")
        large = materialize(large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = materialize(small.where("a <> b").distinct())
    else:
        raise RuntimeError(f"components didn't settle within {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
