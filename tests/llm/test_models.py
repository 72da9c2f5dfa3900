"""Learned operators: exact parts by brute force, the rest by held-out accuracy."""

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from placeflow.llm import langid, toxicity
from placeflow.llm._text import mix
from placeflow.llm.interpolation import CONTEXTS, learn_weights, score_texts
from placeflow.llm.langid import identify_language, learn_languages
from placeflow.llm.toxicity import learn_toxicity, score_toxicity

from . import brute

ODD = [(1, None), (2, ""), (3, " \n "), (4, "12 34 ..."), (5, "the " * 20_000), (6, "a b c"), (7, "a b c"), (8, "日本語 текст"), (9, "x" * 100_000)]


@pytest.fixture(scope="module")
def q():
    return entry.queries()


@pytest.mark.parametrize("which", ["odd", "table"])
def test_base_score(spark, sf, which):
    rows = ODD if which == "odd" else [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got, want = {r["doc_id"]: r for r in score_texts(docs, held).collect()}, brute.base_scores(rows)
    assert set(got) == set(want)
    for d, w in want.items():
        assert tuple(got[d])[1:5] == w[:4]
        assert math.isclose(got[d]["base_score"], w[4], rel_tol=1e-9, abs_tol=1e-9)
    if which == "table":
        mine = sum(r["score"] for r in got.values() if r["held_out"])
        assert mine > sum(r["base_score"] for r in got.values() if r["held_out"])


def test_probabilities_sum_to_one(spark):
    """All texts of up to n words, of which one is unknown, have a total probability that stays under 1 and comes near it."""
    train = ["a b a c", "b b c", "c a b", "a", "b c a", "a c", "a b", "c c c"] * 4
    asked = [" ".join(t) for n in range(6) for t in itertools.product(["a", "b", "c", "zz"], repeat=n)]
    rows = [(i, t, False) for i, t in enumerate(train)] + [(1000 + i, t, True) for i, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h boolean")
    got = {r["doc_id"]: 10 ** r["score"] for r in score_texts(docs, F.col("h")).collect()}
    total = np.cumsum([sum(got[1000 + i] for i, t in enumerate(asked) if len(t.split()) == n) for n in range(6)])
    assert total[-1] <= 1 + 1e-9 and total[-1] > 0.8, total
    left = 1 - total
    assert all(b < 0.9 * a for a, b in zip(left, left[1:])), left


def test_weights_sum_to_one():
    seen = pd.DataFrame({"bucket": [1, 4, 4], "n": [5, 7, 1], "two": [0.5, 0.0, 0.9], "one": [0.1, 0.2, 0.3]})
    assert np.allclose(learn_weights(seen, 3).sum(1), 1)


def test_score_without_training_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_texts(docs, F.lit(True)).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and got[2]["n_tokens"] == 1 and math.isfinite(got[1]["score"])
    assert score_texts(docs.limit(0), F.lit(True)).count() == 0


def test_language_held_out(spark, q):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in q["op8_language_id"](spark, sf).collect()]
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (brute.crc(r["doc_id"], 4) == 2) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_odd_rows(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "xx", None)], "doc_id long, text string, lang string")
    model = learn_languages(train)
    docs = spark.createDataFrame([(d, t, "zz", 0.5) for d, t in ODD], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in identify_language(docs, model).collect()}
    assert {d for d, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 3, 4}
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[5]["lang_pred"] == "en"
    assert identify_language(docs.limit(0), model).count() == 0
    nothing = learn_languages(train.limit(0))
    assert {r["lang_pred"] for r in identify_language(docs, nothing).collect()} == {"und"}


def test_toxicity_held_out(spark, q):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = q["op4_toxicity"](spark, sf).collect()
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    toxic, clean = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in clean] for a in toxic])
    assert auc > 0.9, auc


def test_toxicity_odd_rows(spark):
    train = spark.createDataFrame([(i, "you vile filth" if i % 2 else "a fine day", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(d, t, None, 2.0, 9) for d, t in [*ODD, (20, "vile filth"), (21, "fine day")]], "doc_id long, text string, lang string, score double, predicted int")
    got = {r["doc_id"]: r for r in score_toxicity(docs, learn_toxicity(train, labels)).collect()}
    assert len(got) == 11 and got[20]["predicted"] == 1 and got[21]["predicted"] == 0
    one = learn_toxicity(train, labels.where("toxic = 0"))
    assert {r["predicted"] for r in score_toxicity(docs, one).collect()} == {0}
    assert score_toxicity(docs.limit(0), one).count() == 0
    assert score_toxicity(docs, learn_toxicity(train.limit(0), labels)).count() == 11


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    # more rows than 4,000, and toxic ones of over 20,000 bytes only, in several shards
    rows = [(i, "vile filth " + "calm words of a day " * 1100 if i % 100 == 0 else f"a fine day {i % 7}", "en") for i in range(4200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(0, 4200)] + [(9000, 1)], "doc_id int, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 1 << 18)
    packed = toxicity._training(docs.union(docs.limit(5)), labels)
    assert packed.select("shard").distinct().count() > 1
    assert toxicity._summed(packed, toxicity._seen)[-4:].reshape(2, 2).sum(axis=0).tolist() == [4158, 42]
    some = spark.createDataFrame([(1, "vile filth", "en"), (2, "a fine day", "en")], docs.schema)
    model = learn_toxicity(docs, labels)
    assert [r["predicted"] for r in score_toxicity(some, model).orderBy("doc_id").collect()] == [1, 0]
    assert score_toxicity(docs.where("doc_id % 100 = 0"), model).where("predicted = 0").isEmpty()


def test_toxicity_calibration_by_plain_search(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.3).astype(int)
    z, langs = np.round(rng.normal(size=400) + 1.5 * y, 1), [(None, "de", "en", "xx")[i] for i in rng.choice(4, 400, p=[0.1, 0.5, 0.38, 0.02])]
    model = toxicity.ToxicityModel(None, None, None, None, 0.0)
    toxicity._calibrate(model, spark.createDataFrame([(float(a), int(b), c) for a, b, c in zip(z, y, langs)], "z double, y int, lang string"))
    a, b = model.scale
    weight, p = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), 1 / (1 + np.exp(-(a * z + b)))
    assert abs(np.sum(weight * (p - y) * z) + 0.5 * (a - 1)) < 1e-9 and abs(np.sum(weight * (p - y)) + 0.5 * b) < 1e-9
    expected = {}
    for lang in ("de", "en", "xx"):
        own = np.array([x == lang for x in langs])
        if y[own].sum() >= 5:
            cuts = np.unique(np.append(p[own], 0.5))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            f1 = [2 * np.sum((p[own] >= c) & (y[own] == 1)) / max(1, np.sum(p[own] >= c) + y[own].sum()) for c in cuts]
            best = cuts[np.array(f1) == max(f1)]
            expected[lang] = best[np.abs(best - 0.5).argmin()]
    assert model.thresholds == pytest.approx(expected, abs=1e-12) and "de" in expected


@pytest.mark.parametrize("which", ["odd", "table"])
def test_mixture_score(spark, sf, which):
    """The score of every text, token by token, with counts made by plain dictionaries and weights that are given."""
    rows = ODD if which == "odd" else [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rng = np.random.default_rng(1)
    weights = rng.dirichlet([1, 1, 1], CONTEXTS)
    held = lambda d: brute.crc(d, 5) == 1
    texts = {d: [*brute.words(brute.low(t)), None] for d, t in rows}
    one, two, begins = Counter(), Counter(), 0
    for d, tokens in texts.items():
        if not held(d):
            one.update(tokens)
            two.update(zip(["begin", *tokens], tokens))
            begins += 1
    total, kinds = sum(one.values()), len(one)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, weights).collect()
    assert len(got) == len(rows)
    for r in got:
        want = 0.0
        for before, token in zip(["begin", *texts[r["doc_id"]]], texts[r["doc_id"]]):
            seen = begins if before == "begin" else one[before]
            w = weights[min(math.ceil(math.log2(seen + 1)), CONTEXTS - 1)]
            want += math.log10(w[0] * (two[before, token] / seen if seen else 0.0) + w[1] * one[token] / total + w[2] / (kinds + 1))
        assert math.isclose(r["score"], want, rel_tol=1e-9), r


def test_learnt_weights_by_plain_em():
    """Binned EM against EM over single tokens whose estimates are those of their bins."""
    rng = np.random.default_rng(2)
    seen = pd.DataFrame({"bucket": rng.integers(1, 4, 200), "n": rng.integers(1, 9, 200), "two": rng.choice([0.0, 0.1, 0.5], 200), "one": rng.random(200) / 50})
    got = learn_weights(seen, 99, 30)
    for b in (1, 2, 3):
        tokens = [(r.two, r.one, 0.01) for r in seen[seen["bucket"] == b].itertuples() for _ in range(r.n)]
        w = [0.3, 0.5, 0.2]
        for _ in range(30):
            shares = np.zeros(3)
            for f in tokens:
                p = np.array(f) * w
                shares += p / p.sum()
            w = shares / len(tokens)
        assert np.allclose(got[b], w, atol=1e-5)


def plain_grams(text):
    """Buckets of a text's n-grams, one character after the other."""
    letter = lambda c: (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0
    codes = [letter(c) for c in text or ""]
    for n in langid.ORDERS:
        for i in range(len(codes) - n + 1):
            if any(codes[i : i + n]):
                h = n
                for c in codes[i : i + n]:
                    h = (h * 0x100000001B3 + c) % 2**64
                yield int(mix(np.array([h], np.uint64))[0]) % langid.BUCKETS


@pytest.mark.parametrize("which", ["odd", "table"])
def test_language_by_plain_bayes(spark, sf, which):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()][:60]
    train, asked = rows[::2], rows[1::2] if which == "table" else [(d, t if d != 5 else "the " * 50, None) for d, t in ODD if d != 9]
    counts, priors = {}, Counter()
    for _, t, lang in train:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(t))
            priors[lang] += 1
    langs = sorted(counts)
    got = {r["doc_id"]: r for r in identify_language(spark.createDataFrame(asked, "doc_id long, text string, lang string"), learn_languages(spark.createDataFrame(train, "doc_id long, text string, lang string"))).collect()}
    for d, t, _ in asked:
        grams = Counter(plain_grams(t))
        if not any(c.isalpha() for c in t or ""):
            assert got[d]["lang_pred"] == "und" and got[d]["score"] == 0
            continue
        z = [math.log(priors[x] / sum(priors.values())) + sum(n * math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * langid.BUCKETS)) for g, n in grams.items()) for x in langs]
        share = 1 / sum(math.exp(v - max(z)) for v in z)
        assert got[d]["lang_pred"] == langs[z.index(max(z))] and math.isclose(got[d]["score"], share, rel_tol=1e-6), (d, got[d], z)


def test_many_languages_and_ties(spark):
    """More labels than any list of languages has; labels with the same texts tie, and the first by code point is given."""
    train = spark.createDataFrame([(i, "same text" if i < 2 else f"only {i} x{i}", f"l{i:03}") for i in range(300)], "doc_id long, text string, lang string")
    model = learn_languages(train)
    got = identify_language(spark.createDataFrame([(1, "same text", "zz")], "doc_id long, text string, lang string"), model).collect()
    assert len(model.langs) == 300 and got[0]["lang_pred"] == "l000"


def test_toxicity_by_plain_forward_pass():
    """Scores of a model with random numbers, filter by filter and place by place."""
    rng = np.random.default_rng(3)
    m = toxicity.ToxicityModel(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), [rng.normal(size=(w * toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS), rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS), 0.3, (0.2, -0.1))
    m.emb[0] = 0
    texts = ["", "one", "two Words, here", " ".join(f"w{i % 7}" for i in range(40))]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = m.score(np.frombuffer(b"".join(raw), np.uint8), offs)
    for text, score in zip(raw, got):
        ids, _ = toxicity.word_ids(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        words = [sum(m.emb[i].astype(float) for i in row) for row in ids] or [np.zeros(toxicity.DIM)]
        blank, z = np.zeros(toxicity.DIM), m.offset
        peaks = []
        for w, tap in zip(toxicity.WIDTHS, m.taps):
            for f in range(toxicity.FILTERS):
                peaks.append(max(sum((words[i + k] if i + k < len(words) else blank) @ tap[k * toxicity.DIM : (k + 1) * toxicity.DIM, f] for k in range(w)) for i in range(len(words))))
        z += sum(max(p + b, 0) * weight for p, b, weight in zip(peaks, m.bias, m.weight))
        assert math.isclose(score, 1 / (1 + math.exp(-(0.2 * z - 0.1))), rel_tol=1e-4)


def test_repeated_and_null_ids_score(spark):
    """Rows that share an id or have none are scored like others, and count as often as they are there."""
    rows = [(7, "a b"), (7, "a b"), (None, "a c"), (8, "a b c")]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == sorted([(7, 3), (7, 3), (None, 3), (8, 4)], key=str)
    assert {r["train_tokens"] for r in got} == {13} and len({r["score"] for r in got if r["doc_id"] == 7}) == 1
