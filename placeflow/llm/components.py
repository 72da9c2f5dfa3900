"""Connected components by contraction: every round hooks each node to its smallest neighbour, so long paths fold quickly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import stage

#: Edges that one task may finish by itself.
ONE_TASK = 1 << 19


class Forest:
    """Merges labelled items; edges that connect nothing new cost one comparison."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            to = np.arange(len(self.label))
            np.minimum.at(to, high, low)
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, to (the smallest node reachable) of all edges (a, b)."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        a, b = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        forest.join(at[: len(a)], at[len(a) :])
        for lo in range(0, len(nodes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + 50_000]), pa.array(nodes[forest.label[lo : lo + 50_000]])], ["node", "to"])


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the undirected edges (a, b), whole numbers; null ends don't count.

    A round lets each node point to the smallest of its neighbours and itself, follows pointers twice, renames the edges' ends and
    drops loops and repeats. Hot nodes meet in partial minima, and only pointers of nodes that still have edges move. Once
    one_task edges are left at most, one task finishes them, which takes some megabytes.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    left = stage(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    names = stage(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().select("node", F.col("node").alias("component")), "cc-names")
    for _ in range(most_rounds):
        count = left.count()
        if not count:
            return names
        if count <= one_task:
            to = stage(left.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).repartition(1).mapInArrow(_finished, "node long, to long"), "cc-to")
        else:
            both = left.union(left.select("b", "a")).toDF("node", "other")
            to = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("to"))
            for _ in range(2):  # a pointer never goes up, so following it stays within the component
                up = to.select(F.col("node").alias("to"), F.col("to").alias("further"))
                to = stage(to.join(up, "to").select("node", F.col("further").alias("to")), "cc-to")
            a, b = to.toDF("a", "a2"), to.toDF("b", "b2")
            moved = left.join(a, "a").join(b, "b").where("a2 <> b2")
            left = stage(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "cc-edges")
        names = stage(names.join(to.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "cc-names")
        if count <= one_task:
            return names
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
