"""Polygons as arrays of rings: which of them meet, and which pixels they hold. Joins on tiles and rows of a grid, no pair of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import rounds


def polygon_edges(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """unit, ring, ax, ay, bx, by of each side; rings are arrays of (x, y) structs, closed or not, holes among them."""
    ring = polygons.select("unit", F.posexplode(rings).alias("ring", "points")).where(F.size("points") > 0)
    closed = F.concat("points", F.slice("points", 1, 1))
    sides = F.zip_with(F.slice(closed, 1, F.size("points")), F.slice(closed, 2, F.size("points")), lambda a, b: F.struct(a["x"].cast("double").alias("ax"), a["y"].cast("double").alias("ay"), b["x"].cast("double").alias("bx"), b["y"].cast("double").alias("by")))
    each = ring.select("unit", "ring", F.posexplode(sides).alias("place", "s")).select("unit", "ring", "place", "s.*")
    # a ring that is closed already repeats its first corner; a point is its own side
    return each.where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")) | (F.col("place") == 0))


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def tiled(edges: DataFrame, size: float) -> DataFrame:
    """edges with tile_x, tile_y: a row for each tile of a grid that a side passes or touches, column by column of the grid."""
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = edges.withColumn("tile_x", F.explode(_cells(left, right, size)))
    slope = F.coalesce(F.try_divide(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")), F.lit(0.0))
    at = lambda x: F.col("ay") + (x - F.col("ax")) * slope
    y0, y1 = at(F.greatest(left, F.col("tile_x") * size)), at(F.least(right, (F.col("tile_x") + 1) * size))
    upright, slack = F.col("ax") == F.col("bx"), size * 1e-9
    low = F.when(upright, F.least("ay", "by")).otherwise(F.greatest(F.least("ay", "by"), F.least(y0, y1) - slack))
    high = F.when(upright, F.greatest("ay", "by")).otherwise(F.least(F.greatest("ay", "by"), F.greatest(y0, y1) + slack))
    return columns.withColumn("tile_y", F.explode(_cells(low, high, size)))


def _turn(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    """-1, 0, 1: on which side of a to b c lies."""
    return F.signum((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def _within(p: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return p[0].between(F.least(a[0], b[0]), F.greatest(a[0], b[0])) & p[1].between(F.least(a[1], b[1]), F.greatest(a[1], b[1]))


def segments_meet(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Whether two closed segments share a point: ends of each on either side of the other, or an end on the other."""
    c1, d1, a1, b1 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    on = (c1 == 0) & _within(c, a, b) | (d1 == 0) & _within(d, a, b) | (a1 == 0) & _within(a, c, d) | (b1 == 0) & _within(b, c, d)
    return (c1 * d1 < 0) & (a1 * b1 < 0) | on


def meeting(polygons: DataFrame, tile: float | None = None) -> DataFrame:
    """u, v both ways: units whose polygons (unit, rings) share a point: a side touches or crosses another's, or one lies inside the other.

    Sides meet in the tiles of a grid that they pass; a pair is tested where both are in one tile. tile is the tiles' size, by default
    twice the mean extent of a side. Polygons whose sides don't meet are tested for containment: the first corner of each ring, in
    those whose box holds it, by the parity of sides to its right; what lies in a hole doesn't count. Coordinates are compared as
    doubles, without tolerance. Units without points meet none.
    """
    with rounds(polygons.sparkSession) as cut:
        edges = cut(polygon_edges(polygons))
        if tile is None:
            mean = edges.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))).alias("m")).first()["m"]
            tile = 2 * mean if mean else 1.0
        dealt = cut(tiled(edges.select("unit", "ax", "ay", "bx", "by").distinct(), tile))
        p, q = dealt.alias("p"), dealt.alias("q")
        ends = lambda t, c: (F.col(f"{t}.{c}x"), F.col(f"{t}.{c}y"))
        same = (F.col("p.tile_x") == F.col("q.tile_x")) & (F.col("p.tile_y") == F.col("q.tile_y")) & (F.col("p.unit") < F.col("q.unit"))
        touch = segments_meet(ends("p", "a"), ends("p", "b"), ends("q", "a"), ends("q", "b"))
        found = cut(p.join(q, same & touch).select(F.col("p.unit").alias("u"), F.col("q.unit").alias("v")).distinct())
        box = edges.groupBy("unit").agg(*(f(g(f"a{c}", f"b{c}")).alias(f"{n}{c}") for c in "xy" for n, f, g in (("low", F.min, F.least), ("high", F.max, F.greatest))))
        wide = box.agg(F.avg(F.greatest(F.col("highx") - F.col("lowx"), F.col("highy") - F.col("lowy"))).alias("m")).first()["m"] or 1.0
        boxes = box.withColumn("tile_x", F.explode(_cells(F.col("lowx"), F.col("highx"), wide))).withColumn("tile_y", F.explode(_cells(F.col("lowy"), F.col("highy"), wide)))
        # one corner stands for a ring, since no side of it meets the other polygon's
        corner = edges.where("place = 0").select(F.col("unit").alias("inner"), F.col("ax").alias("x"), F.col("ay").alias("y"))
        corner = corner.withColumns({"tile_x": F.floor(F.col("x") / wide), "tile_y": F.floor(F.col("y") / wide)})
        held = corner.join(boxes, ["tile_x", "tile_y"]).where("inner <> unit AND x BETWEEN lowx AND highx AND y BETWEEN lowy AND highy").select("inner", "unit", "x", "y").distinct()
        pair = {"u": F.least("inner", "unit"), "v": F.greatest("inner", "unit")}
        apart = held.withColumns(pair).join(found, ["u", "v"], "left_anti").select("inner", "unit", "x", "y")
        right = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
        beyond = F.col("x") < F.col("ax") + (F.col("y") - F.col("ay")) * F.try_divide(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
        odd = apart.join(edges, "unit").where(right & beyond).groupBy("inner", "unit", "x", "y").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
        every = found.union(odd.select(F.least("inner", "unit"), F.greatest("inner", "unit")).distinct())
        return cut(every.union(every.select("v", "u")))


def pixel_runs(polygons: DataFrame, left: float, top: float, size: float) -> DataFrame:
    """unit, row, first, last: runs of pixels whose centres a polygon (unit, rings) holds, by row; rows count downwards from top, columns from left.

    Each side crosses the centre lines of some rows; the crossings of a polygon's row, in order, are the ends of its runs. A centre on
    a side belongs to what lies right of it or below.
    """
    edges = polygon_edges(polygons).where("ay <> by")
    # rows whose centre line lies between the ends, the upper one excluded
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    first = F.floor((top - high) / size - 0.5).cast("long") + 1
    last = F.floor((top - low) / size - 0.5).cast("long")
    crossed = edges.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    y = top - (F.col("row") + 0.5) * size
    x = F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    lines = crossed.select("unit", "row", x.alias("x")).groupBy("unit", "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.col("xs")[i].alias("a"), F.col("xs")[i + 1].alias("b")))
    runs = lines.where(F.size("xs") > 1).select("unit", "row", F.explode(pairs).alias("p"))
    begin = F.ceil((F.col("p.a") - left) / size - 0.5).cast("long")
    end = F.ceil((F.col("p.b") - left) / size - 0.5).cast("long") - 1
    return runs.select("unit", "row", begin.alias("first"), end.alias("last")).where("first <= last")


def zones_of(polygons: DataFrame, pixels: DataFrame, left: float, top: float, size: float, columns: int) -> DataFrame:
    """pixels (row, col) with zone: the unit whose polygon holds the pixel's centre, the largest of several; null outside all of them.

    Runs are laid out as pixels of the raster's columns, so pixels meet them by row and column, without a range join.
    """
    runs = pixel_runs(polygons, left, top, size)
    inside = F.sequence(F.greatest("first", F.lit(0)), F.least("last", F.lit(columns - 1)))
    laid = runs.where(f"first < {columns} AND last >= 0").select("unit", "row", F.explode(inside).alias("col"))
    zone = laid.groupBy("row", "col").agg(F.max("unit").alias("zone"))
    return pixels.join(zone, ["row", "col"], "left")


def with_coarse_class(pixels: DataFrame, classes: DataFrame, times: int) -> DataFrame:
    """pixels (row, col) with the class of the coarser pixel (row, col, class), times as large, that holds their centre."""
    coarse = classes.select(F.col("row").alias("__row"), F.col("col").alias("__col"), "class")
    keyed = pixels.withColumns({"__row": F.floor(F.col("row") / times), "__col": F.floor(F.col("col") / times)})
    return keyed.join(coarse, ["__row", "__col"], "left").drop("__row", "__col")


def clipped(polygons: DataFrame, bottom: float) -> DataFrame:
    """unit, clipped: whether a polygon reaches below the raster's lower edge."""
    return polygon_edges(polygons).groupBy("unit").agg((F.min(F.least("ay", "by")) < bottom).alias("clipped"))


def analysable(zones: DataFrame, single: str = "single_settlement", clip: str = "clipped", pop: str = "pop") -> DataFrame:
    """Zones that an analysis can use: not of a single settlement, not cut off by the raster's edge, with inhabitants. Unknown is no."""
    return zones.where(~F.coalesce(F.col(single), F.lit(False)) & ~F.coalesce(F.col(clip), F.lit(False)) & (F.col(pop) > 0))


def assigned_polygons(polygons: DataFrame, assigned: DataFrame) -> DataFrame:
    """All polygons with the area (fua) of their unit; null where there is none."""
    return polygons.join(assigned.where("fua IS NOT NULL").select("unit", "fua"), "unit", "left")
