"""Cells and boundaries against published values, and what must hold of the whole grid."""

import math
from collections import Counter

import pytest
from placeflow.functions import h3
from pyspark.sql import functions as F

# published values
CELLS = [
    (37.3615593, -122.0553238, 5, "85283473fffffff"), (37.3615593, -122.0553238, 7, "87283472bffffff"), (37.775938728915946, -122.41795063018799, 5, "85283083fffffff"),
    (37.775938728915946, -122.41795063018799, 7, "872830828ffffff"), (37.775938728915946, -122.41795063018799, 8, "8828308281fffff"), (37.775938728915946, -122.41795063018799, 9, "8928308280fffff"),
    (40.689167, -74.044444, 10, "8a2a1072b59ffff"),
]
CENTRE = (37.34579337536848, -121.97637597255124)
RING = [(37.271355866731895, -121.91508032705622), (37.353926450852256, -121.86222328902491), (37.42834118609435, -121.9235499963016), (37.42012867767778, -122.0377349642703), (37.33755608435298, -122.09042892904395), (37.26319797461824, -122.02910130919)]


def _every(res):
    """All indexes of a grid: each base cell and each run of digits, but for those of pentagons that lead with the missing axis."""
    out = []
    for base in range(122):
        for n in range(7**res):
            digits = [n // 7**k % 7 for k in range(res)]
            if base in h3._grid()["five"] and next((d for d in digits if d), 0) == 1:
                continue
            index = (1 << 59) + (res << 52) + (base << 45) + sum(7 << (45 - 3 * r) for r in range(res + 1, 16))
            out.append(index + sum(d << (45 - 3 * r) for r, d in enumerate(digits, 1)))
    return out


def _whole(spark, res):
    cells = spark.createDataFrame([(c,) for c in _every(res)], "cell long").repartition(8)
    centre = cells.select("cell", h3.h3_boundary(F.col("cell")).alias("ring"), h3.h3_centre(F.col("cell")).alias("m"))
    return h3.with_h3_cell(centre.select("cell", "ring", "m", "m.lat", "m.lng"), "lat", "lng", res, "again").collect()


def _vector(p):
    a, o = math.radians(p["lat"]), math.radians(p["lng"])
    return (math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a))


def _area(centre, ring):
    """Of a spherical polygon, as triangles around its centre."""
    total = 0.0
    for p, q in zip(ring, ring[1:] + ring[:1]):
        cross = [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
        dot = lambda x, y: sum(a * b for a, b in zip(x, y))
        total += 2 * math.atan2(dot(centre, cross), 1 + dot(centre, p) + dot(p, q) + dot(q, centre))
    return total


def test_published_values(spark):
    points = spark.createDataFrame(CELLS, "lat double, lng double, res int, name string")
    for res in {c[2] for c in CELLS}:
        got = h3.with_h3_cell(points.where(F.col("res") == res), "lat", "lng", res, "c").select("name", h3.h3_name(F.col("c")).alias("got")).collect()
        assert got and all(r["name"] == r["got"] for r in got)
    cell = spark.createDataFrame([("85283473fffffff",), (None,)], "name string").select(h3.h3_parse(F.col("name")).alias("c"))
    one, none = cell.select(h3.h3_centre(F.col("c")).alias("m"), h3.h3_boundary(F.col("c")).alias("ring"), h3.h3_boundary_wkt(F.col("c")).alias("wkt")).collect()
    assert tuple(one["m"]) == pytest.approx(CENTRE, abs=1e-9)
    assert len(one["ring"]) == 6 and all(tuple(p) == pytest.approx(want, abs=1e-9) for p, want in zip(one["ring"], RING))
    assert one["wkt"].startswith("POLYGON ((-121.915080 37.271356, -121.862223 37.353926, ") and one["wkt"].endswith(", -121.915080 37.271356))")
    assert none["m"] is None and none["ring"] is None and none["wkt"] is None


def test_odd_points(spark):
    rows = [(None, 1.0), (1.0, None), (91.0, 0.0), (float("nan"), 0.0), (0.0, float("inf")), (90.0, 12.0), (-90.0, 0.0), (10.0, 190.0), (10.0, -170.0)]
    cells = h3.with_h3_cell(spark.createDataFrame(rows, "lat double, lng double").coalesce(1), "lat", "lng", 6)
    got = [r["cell"] for r in cells.collect()]
    assert got[:5] == [None] * 5 and None not in got[5:] and got[7] == got[8]
    assert cells.where("cell IS NOT NULL").count() == 4 and h3.with_h3_cell(cells, "lat", "lng", 6).columns == ["lat", "lng", "cell"]


@pytest.mark.parametrize("res", [0, 1, 2, 3])
def test_whole_grid(spark, res):
    """Every cell holds its own centre; cells cover the globe once; three of them meet at each corner; twelve are pentagons."""
    rows = _whole(spark, res)
    assert len(rows) == 2 + 120 * 7**res and all(r["again"] == r["cell"] for r in rows)
    areas = [_area(_vector(r["m"]), [_vector(p) for p in r["ring"]]) for r in rows]
    assert min(areas) > 0 and sum(areas) == pytest.approx(4 * math.pi, rel=1e-9)
    corners = Counter(tuple(round(x * 1e7) for x in _vector(p)) for r in rows for p in r["ring"])
    assert set(corners.values()) <= ({2, 3} if res % 2 else {3})
    sizes = Counter(len(r["ring"]) for r in rows)
    assert sizes[10 if res % 2 else 5] == 12 and sizes[6] + sum(n for s, n in sizes.items() if s in (7, 8)) == len(rows) - 12
    # corners beyond three cells each are those on edges of the icosahedron, which two cells share
    assert sum(n == 3 for n in corners.values()) == 2 * (len(rows) - 2)


def test_plan_has_no_python(spark, sf):
    from placeflow.plans.cells import h3_boundaries, h3_dna

    for query in (h3_dna, h3_boundaries):
        assert "Python" not in query(spark, sf)._jdf.queryExecution().executedPlan().toString()
