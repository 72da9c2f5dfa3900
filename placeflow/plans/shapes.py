"""Queries on polygons and pixels, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import polygons, zones
from ._tables import read, rounded


def _ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rectangles strewn over a strip that grows with them: some overlap, some touch in a corner or along part of a side, some
    lie in others. Every fifth has a hole that leaves a rim of one."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), (F.col("p_partkey") * 37 % 500).alias("x"), F.floor(F.col("p_partkey") / 40).alias("y"), (1 + F.col("p_size") % 7).alias("w"), (1 + F.col("p_partkey") % 5).alias("h"))
    x, y, w, h = (F.col(c) for c in "xywh")
    rim = _ring((x + 1, y + 1), (x + 1, y + h - 1), (x + w - 1, y + h - 1), (x + w - 1, y + 1))
    shell = _ring((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))
    holed = (F.col("unit") % 5 == 3) & (w > 2) & (h > 2)
    return part.select("unit", F.when(holed, F.array(shell, rim)).otherwise(F.array(shell)).alias("rings"))


def meeting_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.meeting(_boxes(spark, sf_dir))


ROWS, COLS = 90, 120


def _diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as diamonds about a raster of 90 rows and 120 columns; some reach over its edges."""
    x, y, r = F.col("s_suppkey") * 31 % COLS, F.col("s_suppkey") * 17 % ROWS, 2.25 + F.col("s_suppkey") % 9
    ring = _ring((x + r, -y), (x, -y + r), (x - r, -y), (x, -y - r))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.array(ring).alias("rings"))


def _raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    cells = orders.select((F.col("o_orderkey") % ROWS).alias("row"), (F.col("o_custkey") % COLS).alias("col"), "o_totalprice")
    return cells.groupBy("row", "col").agg(F.sum(F.floor(F.col("o_totalprice"))).cast("double").alias("pop"))


def zone_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone of each pixel, the largest of several."""
    return polygons.zones_of(_diamonds(spark, sf_dir), _raster(spark, sf_dir), 0.0, 0.0, 1.0, COLS).select("row", "col", "pop", "zone")


def zone_urbanisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inhabitants by class of the coarser raster, of zones that are fit for analysis."""
    coarse = _raster(spark, sf_dir).select(F.floor(F.col("row") / 10).alias("row"), F.floor(F.col("col") / 10).alias("col")).distinct()
    classes = coarse.withColumn("class", 10 + (F.col("row") + F.col("col")) % 3 * 10)
    placed = polygons.zones_of(_diamonds(spark, sf_dir), _raster(spark, sf_dir), 0.0, 0.0, 1.0, COLS).where("zone IS NOT NULL")
    sums = zones.zonal_sums(polygons.with_coarse_class(placed, classes, 10), [20, 30], [30])
    cut = polygons.clipped(_diamonds(spark, sf_dir), -float(ROWS)).withColumnRenamed("unit", "zone")
    known = sums.join(cut, "zone").withColumn("single_settlement", F.col("zone") % 11 == 0)
    return rounded(polygons.analysable(known).drop("single_settlement", "clipped"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}


_BOX = """b AS (SELECT p_partkey AS unit, p_partkey * 37 % 500 AS x0, p_partkey // 40 AS y0, x0 + 1 + p_size % 7 AS x1, y0 + 1 + p_partkey % 5 AS y1, p_partkey % 5 = 3 AND x1 - x0 > 2 AND y1 - y0 > 2 AS holed FROM part)"""
#: A box strictly inside another's hole is apart from it.
_INSIDE = "({a}.holed AND {b}.x0 > {a}.x0 + 1 AND {b}.x1 < {a}.x1 - 1 AND {b}.y0 > {a}.y0 + 1 AND {b}.y1 < {a}.y1 - 1)"
_ZONE = f"""px AS (SELECT o_orderkey % {ROWS} AS row, o_custkey % {COLS} AS col, sum(floor(o_totalprice))::DOUBLE AS pop FROM orders GROUP BY ALL),
d AS (SELECT s_suppkey AS unit, s_suppkey * 31 % {COLS} AS x, s_suppkey * 17 % {ROWS} AS y, 2.25::DOUBLE + s_suppkey % 9 AS r FROM supplier),
z AS (SELECT row, col, any_value(pop) AS pop, max(unit) AS zone FROM px LEFT JOIN d ON abs(col + 0.5::DOUBLE - x) + abs(row + 0.5::DOUBLE - y) < r GROUP BY row, col)"""

SQL = {
    "meeting_boxes": f"WITH {_BOX} SELECT p.unit AS u, q.unit AS v FROM b p JOIN b q ON p.unit <> q.unit AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1 WHERE NOT {_INSIDE.format(a='p', b='q')} AND NOT {_INSIDE.format(a='q', b='p')}",
    "zone_pixels": f"WITH {_ZONE} SELECT row, col, pop, zone FROM z",
    "zone_urbanisation": f"""WITH {_ZONE}, c AS (SELECT *, 10 + (row // 10 + col // 10) % 3 * 10 AS class FROM z WHERE zone IS NOT NULL),
      s AS (SELECT zone, sum(pop) AS pop, sum(CASE WHEN class IN (20, 30) THEN pop ELSE 0.0 END) AS urban_pop, sum(CASE WHEN class = 30 THEN pop ELSE 0.0 END) AS city_pop, count(*) AS pixels FROM c GROUP BY 1)
      SELECT zone, pop, urban_pop, city_pop, pixels, round(urban_pop / pop, 6) AS urban_share, round(city_pop / pop, 6) AS city_share FROM s JOIN d ON zone = unit WHERE pop > 0 AND zone % 11 <> 0 AND NOT y + r > {ROWS} AND zone <> 0""",
}
