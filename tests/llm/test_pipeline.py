"""The pipeline's stages on a small table with planted cases, each held against what its own input asks for."""

import random

import corpus_pipeline as pipeline

from . import brute


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item = text(30)
    line = "A line of boilerplate that is in many texts"
    rows = [(i, "vile filth " * 3 + text(20) if i % 4 == 0 else text(40), "en", f"s{i % 3}") for i in range(80)]
    rows += [(100 + i, f"{line}\n{text(50)}", "en", "s0") for i in range(6)]
    copy = text(90)
    rows += [(200 + i, copy, "de", "s1") for i in range(4)] + [(210, copy + " more", "de", "s1")]
    rows += [(300, f"{text(20)} {item} {text(9)}", "en", "s2"), (400, None, None, None), (401, "", "en", "s2"), (None, "no id", "en", "s2"), (403, "w " * 20_000, "en", "s0")]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, columns, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), kind.replace(" long", "").replace(" string", "").split(", "), {}
    for name, f in pipeline.STAGES:
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = docs.collect()
        assert name == pipeline.STAGES[-1][0] or docs.columns == columns
    ids = {name: {r["doc_id"] for r in got} for name, got in at.items()}
    everyone = {r[0] for r in rows}
    assert everyone - ids["toxicity"] == {i for i in range(80) if i % 4 == 0}
    assert ids["line dedup"] == ids["toxicity"]
    assert {r["doc_id"] for r in at["line dedup"] if line in (r["text"] or "")} == {105}
    assert all(r["n_chars"] == len(r["text"] or "") for r in at["line dedup"])
    groups = brute.jaccard([(r["doc_id"], r["text"]) for r in at["line dedup"] if r["doc_id"] is not None])
    assert ids["n-gram Jaccard join"] == {d for d, (_, c) in groups.items() if c == d} | {None}
    assert ids["n-gram Jaccard join"] - ids["benchmark decontamination"] == {300}
    last = at["mixing sources to target weights"]
    assert {r["doc_id"] for r in last} <= ids["benchmark decontamination"] and all(1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in last)


def test_near_copies_with_repeated_ids(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    a, b, c, d = text(60), text(60), text(60), text(60)
    kept = [(5, a, "en"), (5, b, "en"), (-3, d, "de"), (7, None, "en"), (7, "", "en"), (7, "", "de"), (None, a, "en"), (None, a, "en")]
    gone = [(5, a, "en"), (5, a, "de"), (6, a + " more", "en"), (8, b + " more", "en"), (4, d, "en"), (7, None, "en")]
    rows = [*kept, *gone, (9, c, "en"), (9, c + " more", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = [tuple(r) for r in pipeline.keep_one_of_near_copies(spark, docs, "").collect()]
    texts = lambda some: sorted(((r[0], r[1]) for r in some if r[0] != 9), key=str)
    assert texts(got) == texts(kept) and sum(r[0] == 9 for r in got) == 1
    again = [tuple(r) for r in pipeline.keep_one_of_near_copies(spark, docs.repartition(3, "lang"), "").collect()]
    assert sorted(again, key=str) == sorted(got, key=str)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score string, flagged string, n_lines int, leaks string, `a.b` int"


def write_tables(spark, folder, rows, kind):
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "the quick brown benchmark item jumps over it all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_clashing_names_and_run(spark, tmp_path):
    """Columns named like an operator's results keep their values through the stages, and run() gives what the stages give."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [(i, "vile filth " * 3 + text(20) if i % 4 == 0 else text(40)) for i in range(80)]
    texts += [(100, None), (101, ""), (102, f"{text(9)} the quick brown benchmark item jumps over it all"), (None, text(20)), (103, same := text(30)), (103, same), (104, same + " x")]
    rows = [(d, t, "en", f"s{i % 2}", len(t or ""), f"mine{i}", "f", i, "l", i) for i, (d, t) in enumerate(texts)]
    write_tables(spark, tmp_path, rows, CLASHING)
    docs, mine = spark.read.parquet(f"{tmp_path}/documents.parquet"), {(r[1], r[5], r[6], r[7], r[8], r[9]) for r in rows}
    columns = docs.columns
    for k, (name, f) in enumerate(pipeline.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            assert {(r["text"], r["score"], r["flagged"], r["n_lines"], r["leaks"], r["a.b"]) for r in docs.collect()} <= mine
    last = sorted(map(str, docs.collect()))
    assert sorted(map(str, pipeline.run(spark, str(tmp_path)).collect())) == last and len(last) > 10
    kept = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert {None, 100, 101, 103} <= kept and not kept & {0, 102, 104}
    assert spark.read.parquet(f"{tmp_path}/3").where("doc_id = 103").count() == 1


def test_empty_documents(spark, tmp_path):
    write_tables(spark, tmp_path, [], CLASHING)
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_results_outlive_the_pipeline(spark, tmp_path):
    """A run deletes its own scratch tables only: what another query has staged can still be read."""
    from placeflow.llm.line_dedup import dedup_lines

    line = "a line that is long enough to be a key"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(4)], "doc_id long, text string")
    before = dedup_lines(docs)
    write_tables(spark, tmp_path, [(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    pipeline.run(spark, str(tmp_path)).collect()
    assert sum(line in r["text"] for r in before.collect()) == 1
