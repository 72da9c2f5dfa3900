import random
import zlib

from placeflow.llm import conversation_repair
from placeflow.llm.conversation_repair import damage, repair_report, repaired_turns
from pyspark.sql import functions as F

from . import brute

SCHEMA = "conv_id long, turn long, role string, text string, dropped boolean, cost int, heavy string"


def _odd(n):
    rng = random.Random(7)
    texts = ["Hello.", "yes!", "", " \n", "cut off", "Why? ", "end.\t", "Éa.", "…", "x" * 5000, None]
    roles = ["system", "user", "assistant", "tool", "", "User", None]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, 14)):
            rows.append((None if c == 3 else c, None if rng.random() < 0.05 else rng.choice([t, t, t, t + 1, 3]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts), rng.random() < 0.08, 1, "x"))
    rows += [(1000, 0, "user", "a.", True, 1, "x"), (1001, 0, "user", "", False, 1, "x"), (1002, -5, "assistant", "q", False, 1, "x"), (1002, 2**40, "a", "q?", False, 1, "x")]
    rows += [(2000, t, ("user", "assistant")[t % 2 if t != 50 else 0], f"line {t}.", False, 1, "x") for t in range(300)]
    return rows


def _plain(rows):
    return brute.conversations([(c, t, " " if r is None else r, " " if x is None else x, d) for c, t, r, x, d, *_ in rows])


def test_repair_by_brute_force(spark, monkeypatch):
    rows = _odd(120)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = _plain(rows)
    assert len(want) > 90 and len({v[6] for v in want.values()}) > 50
    for cells in (1 << 20, 40):
        monkeypatch.setattr(conversation_repair, "CELLS", cells)
        got = {r["conv_id"]: tuple(r)[1:] for r in repair_report(table, F.col("dropped")).collect()}
        assert got == {c: v[:8] for c, v in want.items()}
    turns = {}
    for r in sorted(repaired_turns(table, F.col("dropped")).collect(), key=lambda r: r["place"]):
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert turns == {c: v[8] for c, v in want.items() if v[8]}
    assert repair_report(table.limit(0)).count() == 0 and repaired_turns(table.limit(0)).count() == 0


def test_texts_in_small_batches(spark, monkeypatch):
    """A conversation over many batches comes out as over one: its texts pass by, its plan stays."""
    rows = _odd(30)
    want = {c: v[:8] for c, v in _plain(rows).items()}
    table = spark.createDataFrame(rows, SCHEMA)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        got = {r["conv_id"]: tuple(r)[1:] for r in repair_report(table, F.col("dropped")).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == want


def test_damage(spark):
    rows = [(c, t, "assistant", f"a. b! c? {t}") for c in range(40) for t in range(6)] + [(None, None, None, None), (None, 1, "user", "x.")]
    got = {}
    for r in damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["dropped"]))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = {1: "", 2: text.translate({ord(x): None for x in ".!?"})}.get(kind, text)
        assert got[c, t] == [("user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
