import math
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import xxhash
from placeflow.llm import entry, secrets
from placeflow.llm.secrets import find_secrets, learn_secrets, ordinary_identifiers, spans
from pyspark.sql import functions as F

from . import brute

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base(text):
    """As the rule is stated: match first, then drop what is too short."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def _gaps(text):
    at = 0
    for m in ASSIGN.finditer(text):
        yield at, text[at : m.start()]
        at = m.end()
    yield at, text[at:]


def _runs(text, least):
    for at, gap in _gaps(text):
        for m in re.finditer("[A-Za-z0-9+/_=-]{%d,}" % least, gap):
            if not re.search("AKIA[A-Z0-9]{12}|[0-9a-f]{32}", m[0]) and re.search("[A-Za-z]", m[0]):
                yield at + m.start(), at + m.end(), m[0]


def _score(word, count):
    each = [[] for _ in range(3)]
    log = lambda k, a, b: math.log((count[k][a, b] + 0.5) / (sum(n for (x, _), n in count[k].items() if x == a) + 0.5 * 67))
    cached = {}
    for a, b in zip(word, word[1:]):
        for k in range(3):
            if (k, a, b) not in cached:
                cached[k, a, b] = log(k, a, b) - log(3, a, b)
            each[k].append(cached[k, a, b])
    return max(sum(x) / len(x) for x in each)


def _plain(rows):
    texts = [t or "" for _, t in rows]
    count = defaultdict(Counter)
    for t in texts:
        for start, kind, end in _base(t):
            for part in (ASSIGN.match(t, start)[2] if kind == 0 else t[start:end]).split("."):
                count[kind].update(zip(part, part[1:]))
    held = []
    for t in texts:
        for _, _, w in _runs(t, 8):
            h = xxhash.xxh64_intdigest(w.encode(), 42)
            if (h - (1 << 64) * (h >> 63)) % 4 == 0:
                held.append(w)
            else:
                count[3].update(zip(w, w[1:]))
    threshold = max(0.0, float(np.quantile([_score(w, count) for w in held], 0.99)))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        added = [(a, 3, b) for a, b, w in _runs(t, 16) if _score(w, count) > threshold]
        line = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        base = _base(t)
        n = Counter(k for _, k, _ in base)
        out.append((doc_id, n[0], n[1], n[2], brute.sha(line(base)), line(base + added)))
    return out


def _rows():
    rng = random.Random(8)
    words = ["the", "of", "user_name_of_the_owner", "responsibilities", "Überraschung", "disproportionate"]
    words += ["".join(rng.choice(["inter", "nation", "al", "char", "acter", "is", "ation", "mis", "under", "stand", "ing", "re", "spon", "_sib", "il", "ities"]) for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    b64 = string.ascii_letters + string.digits + "+/"
    rows = [
        (1, None), (2, ""), (3, "token=secret:abcdefghij token = 'short' TOKEN: \"longenough\""), (4, "password=api_key=abcd1234 passwd:\tno apikey  =   x.y.z.w-12"),
        (5, "é😀 AKIAABCDEFGHIJKL AKIAAKIA12 xAKIA" + "Z" * 11 + "AKIA" + "9" * 12), (6, "deadbeef" * 4 + "g" + "0" * 31 + " " + "A" * 40 + "f" * 32), (7, "1234567890123456789012345678901 12345678901234567"),
        (8, "Token=" + "ab.cd" * 2000 + " secret:" * 50), (None, "api_key: QWERTYUIOP"), (9, "😀token=abcdefgh😀"), (9, "😀token=abcdefgh😀"),
    ]
    for i in range(150):
        text = [rng.choice(words) for _ in range(40)]
        if i % 5 == 0:
            text.insert(rng.randrange(40), f"{rng.choice(['token', 'Api_Key', 'passwd'])}{rng.choice(['=', ': ', ' = '])}{made(b64, 30)}")
        if i % 7 == 0:
            text.insert(rng.randrange(40), made("0123456789abcdef", 40))
        if i % 9 == 0:
            text.insert(rng.randrange(40), made(b64, 32))
        rows.append((100 + i, " ".join(text)))
    return rows


def test_secrets_by_brute_force(spark, monkeypatch):
    rows = _rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, spans int, runs string").repartition(4)
    want = _plain(rows)
    monkeypatch.setattr(entry, "_read", lambda *_: docs)
    for block in (256, 3):
        monkeypatch.setattr(secrets, "BLOCK", block)
        got = [tuple(r) for r in entry.op13_secret_scan(spark, "").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    planted = [r for r in want if "model" in r[5]]
    assert len(planted) >= 10 and all((r[0] - 100) % 9 == 0 for r in planted)
    assert find_secrets(docs.limit(0)).count() == 0


def test_positions_of_many_matches(spark):
    text = "".join(f"{'é' * (i % 5)}a{i}" for i in range(3000))
    got = spark.createDataFrame([(text,), ("none",), ("",)], "text string").select(spans(F.col("text"), "a[0-9]+").alias("s")).collect()
    assert [tuple(x) for x in got[0]["s"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("a[0-9]+", text)] and not got[1]["s"] and not got[2]["s"]


def test_model_and_sample(spark, sf):
    """A model may come from elsewhere; a sample is bounded; no Python takes part."""
    docs = spark.createDataFrame(_rows(), "doc_id long, text string")
    assert ordinary_identifiers(docs, 10).count() == 10
    every = [r["h"] for r in ordinary_identifiers(docs).collect()]
    strings = docs.select(F.lit("x").alias("doc_id"), F.explode(F.split("text", " ")).alias("word"))
    few, all_ = ([r["h"] for r in secrets._sampled(strings, 10**6, part, "word").collect()] for part in (0.1, 1.0))
    assert len(every) > 3000 and set(few) == {h for h in all_ if h < -0.4 * 2**64} and 0.02 < len(few) / len(all_) < 0.3
    model = learn_secrets(secrets._searched(docs), ordinary_identifiers(docs))
    other = spark.createDataFrame([(1, "see qX7bR2kPz9LmW4vT8sYc here, not misunderstanding_of_the_owner")], "doc_id long, text string")
    assert [(x["kind"], x["start"], x["end"]) for x in find_secrets(other, model).first()["secrets"]] == [("model", 4, 24)]
    plan = entry.op13_secret_scan(spark, sf)._jdf.queryExecution().toString() + secrets._searched(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan and "Pandas" not in plan


def test_models_learn_from_all_strings(spark):
    """More strings than any sample held before, all but a few of them the same: counts and threshold are those of all."""
    n = 30_000
    found = spark.range(n).select(F.lit(1).alias("doc_id"), F.array().cast(secrets._SPAN).alias("assign"), F.array().cast(secrets._SPAN).alias("access"), F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("ab").alias("found"))).alias("hex"))
    ordinary = spark.range(n).select(F.col("id").alias("h"), F.when(F.col("id") % 100 == 7, "qbqbqbqb").otherwise("abcdabcd").alias("word"))
    model = learn_secrets(found, ordinary)
    kept = {w: n * p // 100 for w, p in (("qbqbqbqb", 1), ("abcdabcd", 99)) if (lambda h: (h - (1 << 64) * (h >> 63)) % 4)(xxhash.xxh64_intdigest(w.encode(), 42))}
    pairs = Counter({("a", "b"): 0})
    for w, k in kept.items():
        for p in zip(w, w[1:]):
            pairs[p] += k
    of = sum(k for (x, _), k in pairs.items() if x == "a")
    want = math.log((n + 0.5) / (n + 0.5 * 67)) - math.log((pairs["a", "b"] + 0.5) / (of + 0.5 * 67))
    assert math.isclose(model.table.first()["ratios"][2][ord("a") * 128 + ord("b")], want, rel_tol=1e-12)
