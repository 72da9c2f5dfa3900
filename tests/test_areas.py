"""Areas at scale: how often tables are read, what passes the driver, and components joined in blocks."""

import random
import re

import pyarrow as pa
import pytest
from placeflow.operators import delimitation, flows, fragments
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_parts(spark, seed, n=60):
    rng = random.Random(seed)
    area = {f"u{i}": rng.choice("ab") for i in range(n)}
    pairs = [(f"u{rng.randrange(n)}", f"u{rng.randrange(n)}") for _ in range(n)]
    want = {u: u for u in area}
    for _ in range(n):
        for a, b in pairs:
            if area[a] == area[b]:
                want[a] = want[b] = min(want[a], want[b])
    return area, pairs, want


def test_a_long_area_takes_one_round(spark):
    n = 3000
    assigned = spark.range(n).select(F.format_string("%05d", "id").alias("unit"), F.lit("a").alias("fua"))
    edges = fragments.symmetric(spark.range(n - 1).select(F.format_string("%05d", "id").alias("x"), F.format_string("%05d", F.col("id") + 1).alias("y")), "x", "y")
    got = fragments.area_components(assigned, edges, 1)
    assert got.count() == n and {r["component"] for r in got.select("component").distinct().collect()} == {"00000"}
    assert "Broadcast" not in plan(fragments.cut_off(got))


@pytest.mark.parametrize("block", [3, 1 << 19])
def test_blocks_that_disagree_are_joined(spark, monkeypatch, block):
    monkeypatch.setattr(fragments, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for seed in (1, 2):
            area, pairs, want = random_parts(spark, seed)
            edges = fragments.symmetric(spark.createDataFrame(pairs, "a string, b string"), "a", "b")
            got = fragments.area_components(spark.createDataFrame(list(area.items()), "unit string, fua string"), edges).collect()
            assert len(got) == len(area) and {r["unit"]: r["component"] for r in got} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _chain(spark, n=8):
    """Each unit sends most of its flows to the one before it, so areas grow by one unit a round."""
    rows = [(f"u{i}", f"u{i - 1}", 9.0) for i in range(1, n)] + [(f"u{i - 1}", f"u{i}", 1.0) for i in range(1, n)]
    return spark.createDataFrame(rows, "origin string, dest string, flow double")


def test_cores_are_written_once(spark):
    cores = flows.find_cores(flows.unit_stats(_chain(spark)), 0.5)
    assert "Aggregate" not in plan(cores) and cores.count() > 0


def test_rounds_read_only_flows_between_units_without_area(spark, monkeypatch):
    read = []
    made = delimitation.rounds

    class Noted:
        def __init__(self, spark):
            self.own = made(spark)

        def __enter__(self):
            cut = self.own.__enter__()

            def noted(df):
                out = cut(df)
                if set(out.columns) == {"origin", "dest", "flow", "out_external", "fua"}:
                    read.append(out.count())
                return out

            return noted

        def __exit__(self, *x):
            return self.own.__exit__(*x)

    monkeypatch.setattr(delimitation, "rounds", Noted)
    got = delimitation.build_areas(_chain(spark), spark.createDataFrame([("u0",)], "unit string")).collect()
    assert {r["fua"] for r in got} == {"u0"} and [r["unit"] for r in got if r["is_core"]] == ["u0"]
    assert len(read) >= 7 and read[0] == 13 and all(b <= a - 2 for a, b in zip(read, read[1:6])), read


def test_flows_meet_all_repetitions_at_once(spark):
    od = _chain(spark)
    assigned = spark.createDataFrame([(f"u{i}", "ab"[i // 5] if i < 7 else None) for i in range(8)], "unit string, fua string")
    got = delimitation.null_model(od, assigned, 5)
    assert "Window" not in plan(got) and sorted(r["repetition"] for r in got.collect()) == [1, 2, 3, 4, 5]
    assert delimitation.null_model(od, assigned.where("fua IS NULL"), 5).count() == 0


def test_whole_numbers_are_summed_before_they_are_spelt_out(spark):
    rows = spark.createDataFrame([(1, 2, 3.0), (1, 2, 4.0), (1, None, 1.0), (2, 1, -1.0), (12, 1, 2.0)], "a long, b int, n double")
    got = flows.prepare_od(rows, "a", "b", "n")
    assert got.dtypes == [("origin", "string"), ("dest", "string"), ("flow", "double")]
    assert sorted(tuple(r) for r in got.collect()) == [("1", "2", 7.0), ("12", "1", 2.0)]
    assert re.search(r"hashpartitioning\(origin#\d+L, ", plan(got))


def test_units_are_found_in_one_pass_over_flows(spark):
    od = spark.createDataFrame([("a1", "a2", 1.0), ("a2", "a1", 1.0), ("a2", "a3", 1.0), ("b1", "a1", 1.0), ("a1", "b1", 1.0), (None, "a1", 1.0), ("a1", None, 1.0)], "origin string, dest string, flow double")
    got = delimitation.clean_units(od, "^a")
    assert plan(got).count("LeftSemi") == 2
    assert sorted((r["origin"], r["dest"]) for r in got.collect()) == [("a1", "a2"), ("a2", "a1")]


def test_edges_are_read_once_for_both_ways(spark):
    edges = fragments.symmetric(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("c", None)], "x string, y string"), "x", "y")
    assert edges.columns == ["u", "v"] and sorted(tuple(r) for r in edges.collect()) == [("a", "b"), ("b", "a")]
    assert "Union" not in plan(edges)


def test_blocks_hold_whole_areas(spark, monkeypatch):
    monkeypatch.setattr(fragments, "BLOCK", 4)
    batches = [pa.RecordBatch.from_arrays([[f"{a}{i}" for a, i in rows], [f"{a}{i + 1}" for a, i in rows], [a for a, _ in rows]], ["u", "v", "fu"]) for rows in ([("a", 0), ("a", 1), ("a", 2)], [("a", 3), ("b", 0)], [("b", 1), ("b", 2), ("b", 3)], [("c", 0)])]
    got = [tuple(r.values()) for b in fragments._joined(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == sorted((f"{a}{i}", f"{a}0") for a, n in (("a", 5), ("b", 5), ("c", 2)) for i in range(n))
    # an area without end is broken off
    long = [pa.RecordBatch.from_arrays([[f"{i:03}"], [f"{i + 1:03}"], ["a"]], ["u", "v", "fu"]) for i in range(40)]
    assert max(b.num_rows for b in fragments._joined(iter(long))) <= 4 * fragments.LONGEST + 1
