"""Names with lost letters: chains settle, many ways of losing letters find few candidates, strict mode refuses."""

import random
import re

import duckdb
import pytest
from placeflow.operators import matching
from placeflow.plans import sheet

P, C = "polygon_id int, name string", "name string, area string"


def _match(spark, polygons, names, **more):
    census = [(n, "X") for n in names]
    return {(r["polygon_id"], r["key"]) for r in matching.match(spark.createDataFrame(polygons, P), spark.createDataFrame(census, C), **more).collect()}


def _plain(polygons, names):
    """Settles one polygon after the other until nothing more can be said."""
    fits = {i: {n for n in names if re.fullmatch(p.replace("?", "."), n)} for i, p in polygons}
    out = set()
    while True:
        single = {i: min(f) for i, f in fits.items() if len(f) == 1}
        fresh = {(i, n) for i, n in single.items() if list(single.values()).count(n) == 1}
        if not fresh:
            return out
        out |= fresh
        keys = {n for _, n in fresh}
        fits = {i: f - keys for i, f in fits.items() if i not in {i for i, _ in fresh}}


def test_chain_settles(spark):
    assert _match(spark, [(1, "ABC?"), (2, "AB?D")], ["ABCD", "ABXD"]) == {(1, "ABCD"), (2, "ABXD")}
    names = [f"A{chr(65 + i)}{chr(66 + i)}Z" for i in range(8)]
    chain = [(0, "AAB?")] + [(i, "A??Z") if i == 7 else (i, f"A?{chr(66 + i)}Z") for i in range(1, 8)]
    assert _match(spark, chain, names) == _plain(chain, names)
    # two rivals with one territory each: neither gets it
    assert _match(spark, [(1, "AB?"), (2, "A?C"), (3, "?BC")], ["ABC"]) == set()


def test_random_names(spark):
    rng = random.Random(9)
    names = sorted({"".join(rng.choice("ABC") for _ in range(rng.choice([4, 5, 6]))) for _ in range(150)})
    polygons = []
    for i, n in enumerate(rng.sample(names, 110)):
        lost = [c if rng.random() < 0.75 else "?" for c in n]
        lost[rng.randrange(len(n))] = "?"
        polygons.append((i, "".join(lost)))
    polygons.append((900, "????"))
    got, want = _match(spark, polygons, names), _plain(polygons, names)
    assert got == want and len(want) > 20
    pairs = matching.candidates(matching.polygon_names(spark.createDataFrame(polygons, P)), matching.census_keys(spark.createDataFrame([(n, "X") for n in names], C)))
    assert {(r["polygon_id"], r["key"]) for r in pairs.select("polygon_id", "key").collect()} == {(i, n) for i, p in polygons for n in names if re.fullmatch(p.replace("?", "."), n)}


def test_few_candidates(spark):
    """Hundreds of ways of losing letters: a territory gives a row for each length and place of a piece, not for each way."""
    rng = random.Random(2)
    names = ["".join(rng.choice("ABCDEFGH") for _ in range(12)) for _ in range(400)]
    polygons = []
    for i in range(400):
        lost = list(names[i])
        for k in rng.sample(range(12), 4):
            lost[k] = "?"
        polygons.append((i, "".join(lost)))
    ways = {re.sub("[^?]", ".", p) for _, p in polygons}
    shapes = {(m.start(), len(m[0])) for _, p in polygons for m in [max(re.finditer("[^?]+", p), key=lambda m: len(m[0]))]}
    assert len(ways) > 200 and len(shapes) < 50
    assert _match(spark, polygons, names) == _plain(polygons, names)


def test_strict(spark):
    assert _match(spark, [(1, "AB?"), (2, "XYZ")], ["ABC", "XYZ"], strict=True) == {(1, "ABC"), (2, "XYZ")}
    for polygons, names in (([(1, "AB?")], ["ABC", "ABD"]), ([(1, "ABC")], ["ABC", "XYZ"]), ([(1, "AB?"), (2, "A?C")], ["ABC"])):
        with pytest.raises(matching.MatchError):
            _match(spark, polygons, names, strict=True)
    twins = spark.createDataFrame([("ABC", "NISKA"), ("ABC", "NOVA")], C)
    with pytest.raises(matching.MatchError, match="twins"):
        matching.match(spark.createDataFrame([(1, "ABC (N)")], P), twins, strict=True)


def test_rounds_of_the_sql_are_enough(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW customer AS SELECT * FROM '/root/testdata/sf0.01/customer.parquet'")
    assert con.execute(sheet._match_sql("true") + " SELECT count(*) FROM (FROM e6 EXCEPT FROM e5)").fetchone()[0] == 0
