"""Window, suffix and line dedup and the Jaccard join against brute force, on a table and on odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeflow.llm.jaccard import COUNTED, jaccard_components, shingle_sets
from placeflow.llm.line_dedup import LineIndex, dedup_lines
from placeflow.llm.suffix_dedup import dedup_suffixes
from placeflow.llm.window_dedup import dedup_windows

from . import brute

KIND = "doc_id long, text string, lang string, bucket int, row string, kept string, n_words long"


def odd_rows(seed=0):
    """Nulls, blanks, long and short texts, shared passages, copies, a hot line, one word over and over, several bytes a letter."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["žluťoučký", "Größe", "THE", "the", "a b", "日本語"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = text(70), "This is a Line that Many Documents hold"
    copy = text(120)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "the same four words"), (7, "the  SAME four words"), (8, "x " * 400), (9, "x " * 500), (10, text(30_000))]
    rows += [(11 + i, f"{text(20)} {passage} {text(5)}") for i in range(5)]
    rows += [(20 + i, copy) for i in range(6)]
    rows += [(30 + i, " ".join(copy.split()[: 120 - i])) for i in range(6)]
    rows += [(40 + i, f"{text(8)}\n  {line.upper() if i % 2 else line}\t\n{text(6)}\n{line}") for i in range(12)]
    rows += [(60, "short line\nshort line"), (61, "short line"), (62, "short line"), (70, line), (71, line + "\r"), (72, passage), (73, "\n\n\n")]
    rows += [(80 + i, " ".join(copy.split()[i * 3 :])) for i in range(8)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return odd_rows()


@pytest.fixture(scope="module")
def table(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "en", 1, "r", "k", 7) for d, t in rows], KIND).repartition(parts)


@pytest.mark.parametrize("which", ["odd", "table"])
def test_windows(spark, which, request):
    rows = request.getfixturevalue(which)
    got = dedup_windows(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute.windows(rows)


@pytest.mark.parametrize("which", ["odd", "table"])
def test_suffixes(spark, which, request):
    rows = request.getfixturevalue(which)
    got = dedup_suffixes(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute.suffixes(rows)


@pytest.mark.parametrize("held", [1 << 30, 2000])
def test_hot_minimisers_are_split(spark, held):
    """A phrase in every text, amid words of its own: one minimiser has strings of all texts, and is dealt out by windows."""
    rng = random.Random(9)
    phrase = "this phrase is in every single text of the table"
    own = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, f"{own(9)} {phrase} {own(9)}" + (f" {odd_rows()[20][1]}" if i % 5 == 0 else "")) for i in range(120)]
    rows += odd_rows()
    docs = frame(spark, [(1000 + k, t) for k, (_, t) in enumerate(rows)], 4)
    rows = [(1000 + k, t) for k, (_, t) in enumerate(rows)]
    words = dedup_windows(docs, hot=3000, held=held).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, words)) == brute.windows(rows)
    texts = dedup_suffixes(docs, hot=3000, held=held).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, texts)) == brute.suffixes(rows)


@pytest.mark.parametrize("which", ["odd", "table"])
def test_lines(spark, which, request):
    rows = request.getfixturevalue(which)
    got = dedup_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    assert Counter(map(tuple, got)) == brute.lines(rows)


@pytest.mark.parametrize("which", ["odd", "table"])
def test_jaccard(spark, which, request):
    rows = request.getfixturevalue(which)
    got = jaccard_components(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard(rows)


def test_jaccard_hot_groups(spark):
    """A large group whose members drift apart, and groups at the limit: many lists with heavy shingles."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    rows = [(1000 + i, " ".join(base)) for i in range(60)]
    for i in range(150):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(60)] = f"z{rng.randrange(40)}"
        rows.append((i, " ".join(t)))
    for i in range(100):  # small sets around the boundary
        rows.append((2000 + i, " ".join(f"s{(i // 10 * 31 + k) % 97}" for k in range(rng.randrange(4, 15)))))
    got = jaccard_components(frame(spark, rows, 5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard(rows)


def test_jaccard_prefixes_of_different_reach(spark):
    """1 and 2 link, but the prefix of 2 holds its own shingles and four of base, that of 1 only shingles of base, most of them in no other prefix."""
    rng = random.Random(7)

    def counted(start, n):
        """start and n words more, each closing a shingle that is counted."""
        out = list(start)
        while len(out) < len(start) + n:
            out.append(f"c{rng.randrange(10**9)}")
            raw = " ".join(out[-5:]).encode()
            if len(out) >= 5 and shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][0] >= COUNTED * 2**64:
                out.pop()
        return out

    own = lambda n: [f"p{rng.randrange(10**9)}" for _ in range(n)]
    base = counted([], 174)
    families = [counted(base[:8], 100) for _ in range(7)]  # purer than 1 and 2 in the lists of base's first four shingles
    rows = [(1, " ".join(base)), (2, " ".join(base + own(42)))]
    rows += [(100 * (j + 1) + i, " ".join(f + own(1))) for j, f in enumerate(families) for i in range(10)]
    for i in range(90):  # makes all of base and the families but those four more frequent than they are
        rows.append((5000 + i, " ".join([*base[4:], *own(5), *(w for f in families for w in [*f[4:], *own(5)]), *own(300)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, rows, 5)).collect()}
    want = brute.jaccard(rows)
    assert want[2] == (212, 1) and got == want


def test_jaccard_negative_ids(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1, 11):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
        rows += [(-i, text), (i, text + " more")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, rows, 8)).collect()}
    assert got == brute.jaccard(rows) and all(got[i][1] == -i for i in range(1, 11))


def test_rows_without_id_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (None, None), (5, long), (5, long), (6, long), (5, None)]
    docs = frame(spark, rows, 2)
    assert Counter((r[0], r[1]) for r in dedup_windows(docs).select("doc_id", "n_removed").collect()) == Counter({(None, 0): 2, (5, 0): 3, (6, 60): 1})
    assert Counter((r[0], r[1]) for r in dedup_suffixes(docs).select("doc_id", "n_removed").collect()) == Counter({(None, 0): 2, (5, 0): 3, (6, len(long)): 1})
    assert Counter((r[0], r[1]) for r in dedup_lines(docs).select("doc_id", "n_dropped").collect()) == Counter({(None, 0): 2, (5, 0): 3, (6, 0): 1})
    got = jaccard_components(docs).collect()
    # rows of 5 with words are one node; the row without has no set, and takes the component of its id
    assert len(got) == 6 and {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (5, 5), (6, 5)}


def test_empty_tables(spark):
    empty = frame(spark, [], 1)
    for f in (dedup_windows, dedup_suffixes, dedup_lines, jaccard_components):
        assert f(empty).count() == 0


def test_line_index_is_reversible(spark):
    rows = odd_rows()
    first, second = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    index = LineIndex.build(frame(spark, first)).insert(frame(spark, second))
    both = dedup_lines(frame(spark, rows), index).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    assert Counter(map(tuple, both)) == brute.lines(rows)
    back = index.delete(spark.createDataFrame([(d,) for d, _ in second], "doc_id long"))
    got = dedup_lines(frame(spark, first), back).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    assert Counter(map(tuple, got)) == brute.lines(first)


def test_line_index_as_a_log(spark, monkeypatch):
    """Documents come, go and come back; a change writes its own pairs only, and a long log becomes one part."""
    from placeflow.llm import line_dedup

    monkeypatch.setattr(line_dedup, "PARTS", 3)
    line = "This is a Line that Many Documents hold"
    rows = {d: f"{line}\nown line of the document number {d}\n{'another line that some hold here' if d % 2 else 'x'}" for d in range(1, 13)}
    some = lambda ids: frame(spark, [(d, rows[d]) for d in ids])
    gone = lambda ids: spark.createDataFrame([(d,) for d in ids], "doc_id long")

    def check(index, held):
        left = [(d, rows[d]) for d in held]
        got = dedup_lines(frame(spark, left), index).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
        assert Counter(map(tuple, got)) == brute.lines(left)

    index = LineIndex.build(some(range(1, 7)))
    index = index.insert(some(range(5, 10)))
    assert len(index.parts) == 2 and {r["doc_id"] for r in index.parts[1].collect()} == set(range(5, 10))
    index = index.delete(gone([2, 9, 99]))
    assert len(index.parts) == 3 and {r["doc_id"] for r in index.parts[2].collect()} == {2, 9}
    check(index, [1, 3, 4, 5, 6, 7, 8])
    index = index.insert(some([9]))
    assert len(index.parts) == 1
    check(index, [1, 3, 4, 5, 6, 7, 8, 9])
    index = index.delete(gone(range(3, 10)))
    check(index, [1])
