import random
import re
from collections import defaultdict

from placeflow.llm.decontaminate import best_match, budget, find_leaks, normal, pieces
from placeflow.llm.mixing import WEIGHTS, mix_to_weights

from . import brute


def shared_out(sizes):
    """Targets by source: excess over three times a source's size goes to the others by weight, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in over}


def mixed(docs):
    return mix_to_weights(docs).collect()


def test_mix_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size, source = {}, {}
    for r in docs.collect():
        size[r["doc_id"]], source[r["doc_id"]] = len(brute.words(r["text"])), r["source"]
    per = defaultdict(int)
    for d, n in size.items():
        per[source[d]] += n
    want, got, taken = shared_out(per), mixed(docs), defaultdict(int)
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in mixed(docs.repartition(7)))
    assert len(got) == len(size)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] in {k * r["size"] for k in range(4)}
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(size[d] for d in size if source[d] == s)


def test_mix_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (4, "x " * 50_000, "b"), (4, "x", "b"), (None, "q r", "c"), (6, "w", "d"), (7, "w", "e")]
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, source string, size int, taken int")
    got = mixed(docs)
    assert len(got) == 8 and {r["target"] for r in got if r["source"] == "a"} == {0.0}
    assert mix_to_weights(docs.limit(0)).count() == 0
    whole = mix_to_weights(docs, whole_rows=True)
    assert whole.count() == 8 and whole.columns[:3] == ["doc_id", "text", "source"]


def test_mix_plan_is_native(spark, sf):
    plan = mix_to_weights(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_myers_and_pieces():
    rng = random.Random(1)
    for _ in range(150):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert best_match(item, text)[0] == brute.edit_in(item, text)
        assert "".join(p for _, p in pieces(item)) == item and len(pieces(item)) == budget(len(item)) + 1


def test_leaks(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(3, 40))) for i in range(12)] + [(50, None), (51, " "), (52, "Tiny"), (53, text(10)), (53, text(10)), (54, items_twice := text(9)), (54, items_twice.upper() + "x"), (55, "o")]
    rows = [(1, None), (2, ""), (3, text(900) + " " + items[0][1]), (4, "a tiny, thing"), (5, "destiny"), (6, f"q {items_twice} r"), (7, "o")]
    for i in range(40):
        item = list(rng.choice(items[:12])[1])
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(item))
            item[at : at + rng.randrange(2)] = rng.choice(["", "Q", item[at].upper()])
        rows.append((10 + i, f"{text(20)}\n{''.join(item)}\t{text(10)}"))
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, leaks string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    reported = [(r["doc_id"], x["item_id"], x["distance"]) for r in find_leaks(docs, bench).collect() for x in r["leaks"]]
    got = {(d, i): n for d, i, n in reported}
    assert len(got) == len(reported)
    want = {}
    for d, t in rows:
        for i, item in items:
            item = normal(item)
            if item and budget(len(item)):
                n = brute.edit_in(item, normal(t))
                if n <= budget(len(item)):
                    want[d, i] = min(n, want.get((d, i), n))
            elif item and re.search(rf"(?<![^\W_]){re.escape(item)}(?![^\W_])", normal(t)):
                want[d, i] = 0
    assert got == want and (4, 52) in got and (5, 52) not in got and got[6, 54] == 0 and got[3, 0] == 0
    assert find_leaks(docs.limit(0), bench).count() == 0 and all(not r["leaks"] for r in find_leaks(docs, bench.limit(0)).collect())


def test_leaks_in_several_blocks(spark, monkeypatch):
    """Blocks of items: each item_id is in one block, and rows keep what earlier blocks have found."""
    from placeflow.llm import decontaminate

    items = [(i // 2, f"item number {i} of the benchmark") for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontaminate.item_blocks(bench, 60))
    assert len(blocks) > 3 and all(len({id(b) for b in blocks if any(x[0] == i for x in b)}) == 1 for i in range(10))
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (60,))
    docs = spark.createDataFrame([(1, " ".join(t for _, t in items)), (2, items[19][1])], "doc_id long, text string")
    found = find_leaks(docs, bench)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in found.collect()}
    assert got[1] == set(range(10)) and 9 in got[2]


def test_blocks_pass_by_again(spark, monkeypatch):
    """Many small pieces of a partition, each met by all blocks: the same leaks as with one block."""
    from placeflow.llm import decontaminate

    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(12))) for i in range(15)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(d, None if d % 9 == 0 else f"before {rng.choice(items)[1]} between {rng.choice(items)[1][1:]} after") for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = {r["doc_id"]: sorted(map(tuple, r["leaks"])) for r in find_leaks(docs, bench).collect()}
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (100,))
    monkeypatch.setattr(decontaminate, "HELD", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {r["doc_id"]: sorted(map(tuple, r["leaks"])) for r in find_leaks(docs, bench).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == whole and sum(map(len, whole.values())) > 100


def test_batches_of():
    import pyarrow as pa

    from placeflow.llm.decontaminate import batches_of

    batches = [pa.record_batch([pa.array([i, i], pa.int64())], ["x"]) for i in range(5)]
    assert [len(x) for x in batches_of(iter(batches), 0)] == [1] * 5 and [len(x) for x in batches_of(iter(batches), 32)] == [2, 2, 1]
