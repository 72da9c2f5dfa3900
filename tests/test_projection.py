"""The national grid against its published example, and there and back."""

import random

import pytest
from placeflow.functions import grid, projection
from pyspark.sql import functions as F

# published: a point in the grid's datum, its coordinates, and the same point as satellites give it
LAT, LON, EAST, NORTH = 52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600, 651409.903, 313177.270
GPS = (52.657977, 1.716052)


def test_published_point(spark):
    row = spark.createDataFrame([(LAT, LON, EAST, NORTH, *GPS)], "lat double, lon double, e double, n double, glat double, glon double")
    got = row.select(projection.grid_from_datum(F.col("lat"), F.col("lon")).alias("g"), projection.datum_from_grid(F.col("e"), F.col("n")).alias("d"), projection.national_grid(F.col("glat"), F.col("glon")).alias("w")).first()
    assert tuple(got["g"]) == pytest.approx((EAST, NORTH), abs=2e-3)
    assert tuple(got["d"]) == pytest.approx((LAT, LON), abs=2e-8)
    assert tuple(got["w"]) == pytest.approx((EAST, NORTH), abs=1.0)


def test_there_and_back(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(80_000, 650_000), rng.uniform(10_000, 1_200_000)) for _ in range(500)] + [(None, 1.0)]
    table = spark.createDataFrame(rows, "e double, n double").coalesce(1)
    there = table.select("e", "n", projection.from_national_grid(F.col("e"), F.col("n")).alias("p"))
    back = there.select("e", "n", "p", projection.national_grid(F.col("p.lat"), F.col("p.lon")).alias("b")).collect()
    for r in back[:-1]:
        assert abs(r["b"]["east"] - r["e"]) < 1e-3 and abs(r["b"]["north"] - r["n"]) < 1e-3 and 49 < r["p"]["lat"] < 61.5
    assert back[-1]["p"]["lat"] is None


def test_mesh_outside_and_box_text(spark):
    """A strict code refuses what a plain one leaves empty; a box as text begins in its south-west corner."""
    point = spark.createDataFrame([(50.0, 10.0)], "lat double, lon double")
    assert point.select(grid.mesh_code(F.col("lat"), F.col("lon")).alias("m")).first()["m"] is None
    with pytest.raises(Exception, match="outside the mesh: 50.0, 10.0"):
        point.select(grid.mesh_code(F.col("lat"), F.col("lon"), strict=True)).collect()
    box = spark.createDataFrame([("53394611",), (None,), ("12",)], "mesh string").coalesce(1).select(grid.cell_wkt(grid.mesh_box(F.col("mesh"))).alias("w"), grid.mesh_box(F.col("mesh")).alias("b")).collect()
    b = box[0]["b"]
    assert box[0]["w"] == "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in ((b["lon_min"], b["lat_min"]), (b["lon_max"], b["lat_min"]), (b["lon_max"], b["lat_max"]), (b["lon_min"], b["lat_max"]), (b["lon_min"], b["lat_min"]))) + "))"
    assert box[1]["w"] is None and box[2]["w"] is None
