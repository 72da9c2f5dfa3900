import numpy as np
import pytest

from placeflow.llm import vector_dedup
from placeflow.llm.components import components
from placeflow.llm.hnsw import Hnsw
from placeflow.llm.vector_dedup import COSINE, vector_links

from . import brute


def expected(rows):
    sound = {i: np.array(v, np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(sound)
    u = np.stack([sound[i] / np.linalg.norm(sound[i]) for i in ids])
    near = u @ u.T >= COSINE
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
    names = brute.closure([i for i, _ in rows], links)
    n = dict(zip(ids, near.sum(1) - 1))
    return {i: (int(n.get(i, 0)), names[i], names[i] == i) for i, _ in rows}


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in docs.select("vec_id", "embedding").collect()]
    assert {r[0]: tuple(r)[1:4] for r in vector_links(docs).collect()} == expected(rows)


def test_groups_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1500)]
    hub = rng.normal(size=16)
    rows += [(3000 + i, hub.tolist()) for i in range(400)]
    rows += [(4000 + i, (hub + rng.normal(0, 0.12, 16)).tolist()) for i in range(500)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [1.0] * 15 + [None]), (9004, [float("nan")] + [1.0] * 15), (9005, [float("inf")] * 16), (9006, (hub * 1e-200).tolist())]
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, shard int").repartition(4)
    got = {r[0]: tuple(r)[1:4] for r in vector_links(docs).collect()}
    want = expected([(i, v) for i, v in rows if i != 9006] + [(9006, hub.tolist())])
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}
    true, mine = sum(v[0] for v in want.values()), sum(v[0] for v in got.values())
    assert all(got[k][0] <= want[k][0] for k in want) and mine >= 0.99 * true


def test_empty(spark):
    assert vector_links(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 50, 3000])
def test_recall(n):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Hnsw.from_bytes(Hnsw.build(v).to_bytes(), v)
    ids, _ = graph.search(v, 64)
    top = np.argsort(-(v @ v.T), axis=1)[:, : min(5, n)]
    assert np.mean([len(set(a) & set(b)) / len(b) for a, b in zip(ids.tolist(), top.tolist())]) > 0.9


def clustered(n, clusters, dim=48, seed=0):
    """Tight clusters among others: members of one link, those of different ones don't."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    v = centres[np.arange(n) % clusters] + rng.normal(0, 0.12, (n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_clusters_are_searched_by_the_graph(monkeypatch):
    """8,000 rows in 40 clusters: nearly all links come from graph searches, not from a look at the whole shard."""
    v = clustered(8000, 40)
    graph = Hnsw.build(v)
    beam, recall = vector_dedup._audit(graph, v)
    asked, whole = v[:400], []
    split = np.array_split
    monkeypatch.setattr(np, "array_split", lambda left, n: whole.append(len(left)) or split(left, n))
    found = sum(len(q) for q, _ in vector_dedup._near(graph, v, asked, beam))
    assert recall >= vector_dedup.RECALL and found >= 0.98 * (asked @ v.T >= COSINE).sum() > 400
    assert sum(whole) < 0.1 * len(asked)


def test_recall_of_a_table_with_links(spark):
    """The audit's recall goes with the result, and what it promises holds against all pairs."""
    v = clustered(3000, 30, seed=4)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    found = vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    want = expected(rows)
    recalls = {r["audit_recall"] for r in found}
    assert len(recalls) == 1 and vector_dedup.RECALL <= min(recalls) <= 1.0
    mine, true = sum(r["n_links"] for r in found), sum(x[0] for x in want.values())
    assert true > 20_000 and 0.98 * true <= mine <= true and all(r["component_id"] == want[r["vec_id"]][1] for r in found)


def test_repeated_null_ids_and_lengths(spark):
    """Rows that share a vec_id are rows of their own; a row without id has no component; vectors of other lengths don't link."""
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (4, [0.0, 1.0])]
    got = sorted((tuple(r)[:4] for r in vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    assert got == sorted([(5, 1, 5, True), (5, 1, 5, True), (3, 0, 3, True), (None, 0, None, True), (4, 0, 4, True)], key=str), got


@pytest.mark.parametrize("one_task", [0, 30, 1 << 20])
def test_components(spark, one_task):
    """Paths, a star, loops and repeats, by rounds alone, by rounds and one task, and by one task alone."""
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7), (9, 8), (8, 9), (None, 3), (160, 520)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4), one_task=one_task).collect()}
    links = [e for e in edges if None not in e]
    assert got == brute.closure({x for e in links for x in e}, links)
