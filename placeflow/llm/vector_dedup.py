"""Embedding near-dedup: a navigable small-world graph per shard, every shard searched for every vector, links verified.

Equal vectors are one class throughout. Classes are dealt to shards by hash, each shard gets its graph, and blocks of classes are
sent to all shards. A shard first widens its beam until an audit of links against brute force passes; queries whose beam is full of
links are searched with wider beams, and beyond the widest against the whole shard. A block reports per class the number of linked vectors, and
edges that connect what it has found, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import bound_batches, stage
from .components import Forest, components
from .hnsw import BATCH, Hnsw

#: Cosine of a link; vectors of a shard and shards at least; vectors of a block; first beam; recall that an audit must show.
COSINE, SHARD_ROWS, SHARDS, BLOCK_ROWS, BEAM, RECALL = 0.95, 32_768, 4, 16_384, 12, 0.99
#: Vectors that an audit compares with the whole shard, and the beam beyond which the shard is read instead.
AUDIT, WIDEST = 256, 1024


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Directions in double precision; scaled first, so that very large and small ones keep their length."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _near(graph: Hnsw, unit: np.ndarray, vectors: np.ndarray, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) that are links, by the graph. A query whose beam is mostly links is searched again with a wider one; beyond
    WIDEST its links are too many for a beam, and it is compared with the shard's vectors."""

    def links(q: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        close = np.einsum("nd,nd->n", vectors[q], unit[s]) >= COSINE
        return q[close], s[close]

    for lo in range(0, len(vectors), BATCH):
        left, beam = np.arange(lo, min(lo + BATCH, len(vectors))), first
        while len(left):
            if beam > WIDEST or beam >= len(unit):
                for part in np.array_split(left, math.ceil(len(left) * len(unit) / 4e6)):
                    q, s = np.nonzero(vectors[part] @ unit.T >= COSINE - 1e-6)
                    yield links(part[q], s)
                break
            ids, sims = graph.search(vectors[left], beam)
            near = (sims >= COSINE - 1e-4) & (ids >= 0)
            full = near.sum(axis=1) > 0.7 * beam  # there may be more
            q, k = np.nonzero(near & ~full[:, None])
            yield links(left[q], ids[q, k])
            left, beam = left[full], beam * 4


def _audit(graph: Hnsw, unit: np.ndarray) -> tuple[int, float]:
    """The first beam whose searches find RECALL of the links that a look at the whole shard finds, and their recall.

    Asked are nodes turned away by angles up to that of a link, so each has a link at least and none is a node itself.
    """
    rng = np.random.default_rng(1)
    some = unit[rng.permutation(len(unit))[:AUDIT]]
    aside = rng.normal(size=some.shape)
    aside -= np.einsum("nd,nd->n", aside, some)[:, None] * some
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    c = rng.uniform(COSINE + 0.001, 0.995, (len(some), 1))
    asked = np.where(length > 1e-9, c * some + np.sqrt(1 - c * c) * aside / np.maximum(length, 1e-9), some)
    want, beam = int((asked @ unit.T >= COSINE).sum()), BEAM
    while True:
        pairs = np.concatenate([np.zeros(0, np.int64), *(q.astype(np.int64) * len(unit) + s for q, s in _near(graph, unit, asked, beam))])
        recall = min(1.0, len(np.unique(pairs)) / max(want, 1))
        if recall >= RECALL or beam >= len(unit):
            return beam, recall
        beam *= 2


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: node ids, weights, vectors, graph, the beam that passes the audit, and its recall."""
    rows = rows.sort_values("node", ignore_index=True)
    rows = rows.iloc[np.random.default_rng(len(rows)).permutation(len(rows))]
    vectors = np.array(rows["v"].tolist(), np.float64)
    unit = _unit(vectors)
    graph = Hnsw.build(unit)
    beam, recall = _audit(graph, unit)
    return pd.DataFrame({"dim": rows["dim"].iloc[:1].to_numpy(), "shard": rows["shard"].iloc[:1].to_numpy(), "nodes": [rows["node"].to_numpy(np.int64).tobytes()], "weights": [rows["n"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()], "graph": [graph.to_bytes()], "beam": [beam], "recall": [recall]})


def _links(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    """For a block of classes and a shard: node, n (vectors of other classes linked to it), other (an edge, or null)."""
    nothing = pd.DataFrame({"node": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
    if not len(queries) or not len(shard):
        return nothing
    nodes, weights = (np.frombuffer(shard[c].iloc[0], np.int64) for c in ("nodes", "weights"))
    unit = _unit(np.frombuffer(shard["vectors"].iloc[0], np.float64).reshape(len(nodes), -1))
    graph = Hnsw.from_bytes(shard["graph"].iloc[0], unit)
    asked = queries["node"].to_numpy(np.int64)
    vectors = _unit(np.array(queries["v"].tolist(), np.float64))
    count = np.zeros(len(asked), np.int64)
    forest = Forest(len(asked) + len(nodes))
    for q, s in _near(graph, unit, vectors, int(shard["beam"].iloc[0])):
        other = asked[q] != nodes[s]
        np.add.at(count, q[other], weights[s[other]])
        forest.join(q, len(asked) + s)
    some = np.flatnonzero(count)
    root = forest.label
    names = np.concatenate([asked, nodes])
    edge = np.flatnonzero(root != np.arange(len(root)))
    return pd.concat([pd.DataFrame({"node": asked[some], "n": count[some], "other": asked[some]}), pd.DataFrame({"node": names[edge], "n": 0, "other": names[root[edge]]})])


def vector_links(rows: DataFrame) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, its own included), kept, for every row,
    and audit_recall, the smallest share of links that a shard's graph has found in its audit (null without vectors).

    rows has vec_id and embedding, an array of numbers. Two rows link if the cosine of their vectors, in double precision, is at
    least COSINE; vectors of different length don't. Null, empty and zero vectors, those with null or non-finite components, and
    rows without vec_id link with nothing; the last have a null component and are kept. Rows that share a vec_id are rows of their
    own. An empty table gives an empty result; other columns are ignored.
    """
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    bound_batches(rows.sparkSession)
    all_ = rows.select(F.col("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v")).withColumn("sound", sound)
    # -0.0 + 0.0 is 0.0, so equal vectors have equal bytes and one class
    classed = all_.withColumn("node", F.when(F.col("sound"), F.xxhash64("v")))
    classes = stage(classed.where("sound").groupBy("node", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("low")), "vec-classes")
    total = classes.count()
    shards, blocks = max(SHARDS, -(-total // SHARD_ROWS)), max(1, -(-total // BLOCK_ROWS))
    dealt = classes.select("node", "v", "n", F.size("v").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).alias("shard"), F.pmod(F.hash("node", F.lit(7)), F.lit(blocks)).alias("block"))
    graphs = stage(dealt.groupBy("dim", "shard").applyInPandas(_shard, "dim int, shard long, nodes binary, weights binary, vectors binary, graph binary, beam int, recall double"), "vec-graphs")
    asked = dealt.select("dim", "block", "node", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    recall = graphs.agg(F.min("recall")).first()[0]
    held = graphs.drop("recall").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = asked.groupBy("dim", "shard", "block").cogroup(held.groupBy("dim", "shard", "block")).applyInPandas(_links, "node long, n long, other long")
    found = stage(pairs, "vec-links")
    named = components(found.where("node <> other").selectExpr("node AS a", "other AS b"))
    counts = found.groupBy("node").agg(F.sum("n").alias("linked"))
    per_class = classes.join(named, "node", "left").join(counts, "node", "left").select("node", "n", "low", F.coalesce("component", "node").alias("component"), F.coalesce("linked", F.lit(0)).alias("linked"))
    lows = per_class.groupBy("component").agg(F.min("low").alias("component_id"))
    final = per_class.join(lows, "component").select("node", "component_id", (F.col("n") - 1 + F.col("linked")).alias("n_links"))
    out = classed.select("vec_id", "node").join(final, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"))
