import random

import numpy as np
from placeflow.llm import entry
from placeflow.llm._text import Prints

from . import brute


def twins(n=1024):
    """Two words that every polynomial modulo a power of two takes for one: the Thue-Morse word and its complement."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_prints_of_ranges():
    rng = random.Random(3)
    raw = bytes(rng.choice(b"abAB ") for _ in range(4000))
    buf = np.frombuffer(raw, np.uint8)
    spans = [(a, min(4000, a + rng.randrange(1, 40))) for a in (rng.randrange(4000) for _ in range(3000))]
    start, end = (np.array(x) for x in zip(*spans))
    for fold in (False, True):
        got = Prints(5, fold).ranges(buf, start, end)
        keys = [raw[a:b].lower() if fold else raw[a:b] for a, b in spans]
        assert len(set(zip(keys, got.tolist()))) == len(set(keys)) == len(set(got.tolist()))


def test_twin_words(spark, monkeypatch):
    one, two = twins()
    rows = [(1, one), (2, two), (3, f"{one} x {two} y z"), (4, f"{two} x {one} y z")]
    rows += [(i, f"{one} w{i}") for i in range(5, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(entry, "_read", lambda *_: docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in entry.op10_jaccard_join(spark, "").collect()}
    assert got == brute.jaccard(rows) and got[2][1] == 2
    want = brute.base_scores(rows)
    for r in entry.op2_lm_scoring(spark, "").collect():
        held, tokens, known, train, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, train) and abs(r["base_score"] - base) < 1e-9
