"""Meeting polygons and pixels of polygons against plain versions with exact fractions."""

import random
from fractions import Fraction as Fr

from placeflow.operators import polygons
from pyspark.sql import functions as F

SHAPES = "unit int, rings array<array<struct<x:double,y:double>>>"


def _sides(rings):
    for ring in rings:
        yield from zip(ring, ring[1:] + ring[:1])


def _turn(a, b, c):
    n = (Fr(b[0]) - Fr(a[0])) * (Fr(c[1]) - Fr(a[1])) - (Fr(b[1]) - Fr(a[1])) * (Fr(c[0]) - Fr(a[0]))
    return (n > 0) - (n < 0)


def _meet(a, b, c, d):
    on = lambda p, q, r: _turn(p, q, r) == 0 and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    return _turn(a, b, c) * _turn(a, b, d) < 0 and _turn(c, d, a) * _turn(c, d, b) < 0 or on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b)


def _inside(p, rings):
    odd = False
    for a, b in _sides(rings):
        if (a[1] > p[1]) != (b[1] > p[1]) and Fr(p[0]) < Fr(a[0]) + (Fr(p[1]) - Fr(a[1])) * (Fr(b[0]) - Fr(a[0])) / (Fr(b[1]) - Fr(a[1])):
            odd = not odd
    return odd


def _adjacent(shapes):
    out = set()
    for u, r in shapes:
        for v, s in shapes:
            if u < v and r and s:
                touch = any(_meet(*p, *q) for p in _sides(r) for q in _sides(s))
                if touch or any(_inside(x[0], s) for x in r) or any(_inside(x[0], r) for x in s):
                    out |= {(u, v), (v, u)}
    return out


def _odd():
    rng = random.Random(4)
    shapes = []
    for i in range(90):
        x, y = rng.randrange(60), rng.randrange(60)
        n = rng.choice([3, 4, 5])
        shapes.append((i, [[(float(x + rng.randrange(-4, 5)), float(y + rng.randrange(-4, 5))) for _ in range(n)]]))
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    shapes += [
        (200, [square(100.0, 0.0, 10.0)]), (201, [square(110.0, 2.5, 3.0)]), (202, [square(110.0, 5.5, 1.0)]),  # along part of a side, T-junctions
        (203, [square(120.0, 0.0, 20.0), square(122.0, 2.0, 16.0)]), (204, [square(125.0, 5.0, 2.0)]),  # in a hole: apart
        (205, [square(150.0, 0.0, 20.0)]), (206, [square(155.0, 5.0, 2.0)]),  # inside
        (207, [square(180.0, 0.0, 1.0), square(156.0, 8.0, 1.0)]),  # a second part inside
        (208, [square(110.0, 10.0, 1.0)]), (209, [[*square(190.0, 0.0, 1.0), (190.0, 0.0)]]), (210, []), (211, [[]]), (212, [[(190.5, 0.5)]]),
        (213, [square(-300.0, -300.0, 900.0)]),
    ]
    return shapes


def test_meeting_by_brute_force(spark):
    shapes = _odd()
    want = _adjacent([(u, [r for r in rings if r]) for u, rings in shapes])
    table = spark.createDataFrame(shapes, SHAPES).repartition(4)
    for tile in (None, 3.0, 1000.0):
        got = [tuple(r) for r in polygons.meeting(table, tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert (200, 201) in want and (203, 204) not in want and (205, 206) in want and (205, 207) in want and (200, 208) in want and (209, 212) in want
    assert polygons.meeting(table.limit(0)).count() == 0


def test_meeting_tests_few_pairs(spark):
    """A strip of n boxes: the pairs that share a tile grow with n."""
    made = []
    for n in (100, 400):
        boxes = [(i, [[(2.0 * i, 0.0), (2.0 * i + 2, 0.0), (2.0 * i + 2, 1.0), (2.0 * i, 1.0)]]) for i in range(n)]
        dealt = polygons.tiled(polygons.polygon_edges(spark.createDataFrame(boxes, SHAPES)), 4.0)
        made.append(dealt.alias("p").join(dealt.alias("q"), ["tile_x", "tile_y"]).where("p.unit < q.unit").count())
    assert made[1] < 4.2 * made[0]


def test_pixels_by_brute_force(spark):
    shapes, size, left, top, columns = _odd()[:-1], 1.5, -6.25, 66.25, 50
    cells = [(r, c) for r in range(50) for c in range(columns)]
    table = spark.createDataFrame(shapes, SHAPES).repartition(3)
    got = {(r["row"], r["col"]): r["zone"] for r in polygons.zones_of(table, spark.createDataFrame(cells, "row int, col int"), left, top, size, columns).collect()}
    want = {}
    for r, c in cells:
        p = (left + (c + 0.5) * size, top - (r + 0.5) * size)
        want[r, c] = max((u for u, rings in shapes if _inside(p, [x for x in rings if x])), default=None)
    assert got == want and len(set(want.values())) > 40


def test_coarse_classes_and_exclusions(spark):
    pixels = spark.createDataFrame([(r, c) for r in range(4) for c in range(4)], "row int, col int")
    classes = spark.createDataFrame([(0, 0, 10), (0, 1, 20), (1, 1, 30)], "row int, col int, class int")
    got = {(r["row"], r["col"]): r["class"] for r in polygons.with_coarse_class(pixels, classes, 2).collect()}
    assert got[1, 1] == 10 and got[1, 2] == 20 and got[3, 3] == 30 and got[2, 0] is None and len(got) == 16
    zones = spark.createDataFrame([(1, False, False, 5.0), (2, True, False, 5.0), (3, False, True, 5.0), (4, False, False, 0.0), (5, None, None, 1.0), (6, False, False, None)], "zone int, single_settlement boolean, clipped boolean, pop double")
    assert {r["zone"] for r in polygons.analysable(zones).collect()} == {1, 5}
    shapes = spark.createDataFrame([(1, [[(0.0, 0.0), (1.0, 0.0), (0.0, -5.0)]]), (2, [[(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]])], SHAPES)
    assert {r["unit"]: r["clipped"] for r in polygons.clipped(shapes, -1.0).collect()} == {1: True, 2: False}
    both = polygons.assigned_polygons(shapes, spark.createDataFrame([(1, "A"), (2, None)], "unit int, fua string"))
    assert {r["unit"]: r["fua"] for r in both.select("unit", F.col("fua")).collect()} == {1: "A", 2: None}
