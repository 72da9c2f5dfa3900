"""Quantiles against percentile() on values that are spread, tied, tiny, negative or missing."""

import math
import random

import pytest
from placeflow.operators import quantiles
from pyspark.sql import functions as F

ASKED = {"low": 0.0, "a": 0.1, "half": 0.5, "b": 0.97, "high": 1.0}


def _rows():
    rng = random.Random(11)
    rows = [("spread", rng.lognormvariate(0, 6)) for _ in range(3000)] + [("tied", float(rng.choice([1, 1, 1, 2]))) for _ in range(900)]
    rows += [("signed", rng.gauss(0, 1)) for _ in range(2001)] + [("close", 1e9 + i * 1e-6) for i in range(2500)] + [("tiny", i * 5e-324) for i in range(-700, 800)]
    rows += [("one", 4.25), ("none", None), ("none", float("nan")), (None, 1.0), (None, 3.0), ("zero", 0.0), ("zero", -0.0), ("zero", 2.0), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 5.0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("few", [quantiles.FEW, 5])
def test_as_percentile(spark, few):
    table = spark.createDataFrame(_rows(), "g string, v double").repartition(5)
    sound = table.where(~F.isnan("v") | F.col("v").isNull())
    want = {r["g"]: tuple(r)[1:] for r in sound.groupBy("g").agg(*(F.percentile("v", q).alias(n) for n, q in ASKED.items())).collect()}
    got = {r["g"]: tuple(r)[1:] for r in quantiles.exact_quantiles(table, "v", ASKED, "g", few=few).collect()}
    assert got.keys() == want.keys() and len(got) == 10
    for g, values in want.items():
        for x, y in zip(got[g], values):
            assert x == y or x is not None and y is not None and math.isclose(x, y, rel_tol=1e-15), (g, got[g], values)


def test_without_keys(spark):
    table = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert tuple(quantiles.exact_quantiles(table, "v", ASKED).first()) == (0.0, 10.0, 50.0, 97.0, 100.0)
    assert tuple(quantiles.exact_quantiles(table.limit(0), "v", ASKED).first()) == (None,) * 5
    assert quantiles.exact_quantiles(table.withColumn("g", F.lit(1)).limit(0), "v", ASKED, "g").count() == 0
