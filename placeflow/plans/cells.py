"""Queries on H3 cells and squares of the British national grid, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import h3, projection
from ..operators import diversity
from ._tables import read, rounded
from .places import _GEO, _METRICS, _geo

RESOLUTIONS = (7, 8, 9)


def _places(spark: SparkSession, sf_dir: str, res: int) -> DataFrame:
    return h3.with_h3_cell(_geo(spark, sf_dir), "lat", "lon", res)


def h3_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diversity by H3 cell of resolution 7."""
    return rounded(diversity.cell_diversity(_places(spark, sf_dir, 7), "city", min_support=5))


def h3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by cell at three resolutions, named as usual."""
    points = _geo(spark, sf_dir).select("lat", "lon")
    for r in RESOLUTIONS:
        points = h3.with_h3_cell(points, "lat", "lon", r, f"cell{r}")
    cells = F.array(*(F.struct(F.lit(r).alias("res"), F.col(f"cell{r}").alias("cell")) for r in RESOLUTIONS))
    counts = points.select(F.explode(cells).alias("c")).groupBy("c.res", "c.cell").agg(F.count("*").alias("points"))
    return counts.select("res", h3.h3_name(F.col("cell")).alias("name"), "points").withColumnRenamed("name", "cell")


def h3_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell with events, its centre and its boundary."""
    cells = _places(spark, sf_dir, 7).groupBy("cell").agg(F.count("*").alias("points"))
    shaped = cells.select(h3.h3_name(F.col("cell")).alias("name"), "points", h3.h3_centre(F.col("cell")).alias("centre"), h3.h3_boundary_wkt(F.col("cell")).alias("wkt"))
    return shaped.select(F.col("name").alias("cell"), "points", F.col("centre.lat").alias("lat"), F.col("centre.lng").alias("lon"), "wkt")


def grid_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, strewn over Britain, by squares of ten kilometres of the national grid."""
    lat, lon = 50.1 + F.col("event_id") % 83 * 0.1, -5.3 + F.col("user_id") % 67 * 0.1
    points = read(spark, sf_dir, "events").select(projection.national_grid(lat, lon).alias("p"))
    return points.groupBy(F.floor(F.col("p.east") / 10_000).alias("east"), F.floor(F.col("p.north") / 10_000).alias("north")).agg(F.count("*").alias("points"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (h3_dna, h3_counts, h3_boundaries, grid_squares)}


def _h3_sql(res: int, points: str) -> str:
    """CTEs that end in cells{res}: lat, lon and cell of the points' table, one step of the grids in each."""
    grid, fine = h3._grid(), 1 / h3._scaled(res) / h3.UNIT
    number = lambda x: f"{x!r}::DOUBLE"
    faces = ", ".join(f"({f}, {', '.join(number(c) for v in (face.centre, face.x, face.y) for c in v)})" for f, face in enumerate(grid["faces"]))
    spots = [(f, (i, j, k)) for f in range(20) for i in range(3) for j in range(3) for k in range(3)]
    listed = lambda values: "[" + ", ".join(map(str, values)) + "]"
    out = f"""
p{res} AS (SELECT DISTINCT lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM {points}),
n{res} AS (
  SELECT lat, lon, arg_max(f, dot) AS f, max(dot) AS dot, arg_max(x * x0 + y * x1 + z * x2, dot) AS px, arg_max(x * y0 + y * y1 + z * y2, dot) AS py FROM (
    SELECT *, x * c0 + y * c1 + z * c2 AS dot FROM p{res}, (VALUES {faces}) t(f, c0, c1, c2, x0, x1, x2, y0, y1, y2)) GROUP BY lat, lon),
g{res} AS (SELECT lat, lon, f, ({number(fine.imag)} * px / dot + {number(fine.real)} * py / dot) / (sqrt(3.0::DOUBLE) / 2) AS r, {number(fine.real)} * px / dot - {number(fine.imag)} * py / dot + r / 2 AS a0, a0 - r AS q, -a0 AS s FROM n{res}),
w{res} AS (SELECT *, floor(q + 0.5) AS wq, floor(r + 0.5) AS wr, floor(s + 0.5) AS ws, abs(wq - q) AS dq, abs(wr - r) AS dr, abs(ws - s) AS ds FROM g{res}),
s{res}_{res} AS (
  SELECT lat, lon, f, CASE WHEN dq > dr AND dq > ds THEN -wr - ws ELSE wq END + CASE WHEN dr >= dq AND dr > ds THEN -wq - ws ELSE wr END AS a, CASE WHEN dr >= dq AND dr > ds THEN -wq - ws ELSE wr END AS b, []::INT[] AS digits FROM w{res}),"""
    for r in range(res, 0, -1):
        odd = r % 2
        up = ("(3 * a - b) / 7", "(a + 2 * b) / 7") if odd else ("(2 * a + b) / 7", "(3 * b - a) / 7")
        down = ("2 * ua + ub", "3 * ub - ua") if odd else ("3 * ua - ub", "ua + 2 * ub")
        out += f"""
s{res}_{r - 1} AS (
  SELECT lat, lon, f, ua AS a, ub AS b, list_prepend((4 * (da - low) + 2 * (db - low) - low)::INT, digits) AS digits FROM (
    SELECT *, floor({up[0]} + 0.5) AS ua, floor({up[1]} + 0.5) AS ub, a - ({down[0]}) AS da, b - ({down[1]}) AS db, least(da, db, 0) AS low FROM s{res}_{r})),"""
    fixed = (1 << 59) + (res << 52) + sum(7 << (45 - 3 * r) for r in range(res + 1, h3.FINEST + 1))
    turned = [h3._turned(d, t) if d else 0 for t in range(6) for d in range(7)]
    out += f"""
i{res} AS (SELECT *, least(a, b, 0) AS low, (f * 27 + (a - low) * 9 + (b - low) * 3 - low)::INT AS spot, coalesce(list_filter(digits, lambda d: d > 0)[1], 0) AS lead FROM s{res}_0),
t{res} AS (SELECT *, {listed([grid["base"].get(s, -1) for s in spots])}[spot + 1] AS base, {listed([t for s in spots for t in grid["turns"].get(s, [0] * 7)])}[spot * 7 + lead + 1] AS turn FROM i{res}),
cells{res} AS (SELECT lat, lon, ({fixed}::BIGINT + base::BIGINT * {1 << 45} + {" + ".join(f"{listed(turned)}[turn * 7 + digits[{r}] + 1]::BIGINT * {1 << (45 - 3 * r)}" for r in range(1, res + 1))})::BIGINT AS cell FROM t{res})"""
    return out


def _grid_sql() -> str:
    """Squares of the national grid: to the centre of the Earth, shift, to the other ellipsoid by iteration, and the series of the projection."""
    (a, b), (ga, gb), p = projection.GRID_AXES, projection.GPS_AXES, projection
    n, e2, ge2, zero = (a - b) / (a + b), 1 - (b / a) ** 2, 1 - (gb / ga) ** 2, math.radians(p.ORIGIN[0])
    x = lambda v: f"({v!r}::DOUBLE)"
    rx, ry, rz = (math.radians(s / 3600) for s in p.TURNS)
    up = "".join(f", l{i} AS (SELECT *, atan2(z2 + {x(e2)} * {x(a)} / sqrt(1 - {x(e2)} * sin(u{i - 1}) * sin(u{i - 1})) * sin(u{i - 1}), flat) AS u{i} FROM l{i - 1})" for i in range(1, 9))
    return f"""WITH e AS (SELECT radians(50.1::DOUBLE + event_id % 83 * 0.1::DOUBLE) AS phi, radians(-5.3::DOUBLE + user_id % 67 * 0.1::DOUBLE) AS lam, count(*) AS c FROM events GROUP BY ALL),
g AS (SELECT c, {x(ga)} / sqrt(1 - {x(ge2)} * sin(phi) * sin(phi)) AS nu, nu * cos(phi) * cos(lam) AS x, nu * cos(phi) * sin(lam) AS y, nu * {x(1 - ge2)} * sin(phi) AS z FROM e),
s AS (SELECT c, {x(p.SHIFT[0])} + {x(1 + p.GROWTH)} * x - {x(rz)} * y + {x(ry)} * z AS x2, {x(p.SHIFT[1])} + {x(rz)} * x + {x(1 + p.GROWTH)} * y - {x(rx)} * z AS y2, {x(p.SHIFT[2])} - {x(ry)} * x + {x(rx)} * y + {x(1 + p.GROWTH)} * z AS z2 FROM g),
l0 AS (SELECT c, z2, sqrt(x2 * x2 + y2 * y2) AS flat, atan2(y2, x2) - {x(math.radians(p.ORIGIN[1]))} AS d, atan2(z2, flat * {x(1 - e2)}) AS u0 FROM s){up},
q AS (SELECT c, u8 AS u, d, {x(a * p.SCALE)} / sqrt(1 - {x(e2)} * sin(u) * sin(u)) AS nu, {x(1 / (1 - e2))} * (1 - {x(e2)} * sin(u) * sin(u)) AS ratio, cos(u) AS k, tan(u) * tan(u) AS t FROM l8),
m AS (SELECT c, {x(p.EAST)} + nu * k * (d + d ** 3 * k ** 2 * (ratio - t) / 6 + d ** 5 * k ** 4 * (5 - 18 * t + t * t + 14 * (ratio - 1) - 58 * t * (ratio - 1)) / 120) AS east,
  {x(b * p.SCALE)} * ({x(1 + n + 1.25 * n**2 + 1.25 * n**3)} * (u - {x(zero)}) - {x(3 * n + 3 * n**2 + 21 / 8 * n**3)} * sin(u - {x(zero)}) * cos(u + {x(zero)}) + {x(15 / 8 * (n**2 + n**3))} * sin(2 * (u - {x(zero)})) * cos(2 * (u + {x(zero)})) - {x(35 / 24 * n**3)} * sin(3 * (u - {x(zero)})) * cos(3 * (u + {x(zero)})))
  + {x(p.NORTH)} + nu * sin(u) * k * (d ** 2 / 2 + d ** 4 * k ** 2 * (5 - t + 9 * (ratio - 1)) / 24 + d ** 6 * k ** 4 * (61 - 58 * t + t * t) / 720) AS north FROM q)
SELECT floor(east / 10000)::BIGINT AS east, floor(north / 10000)::BIGINT AS north, sum(c)::BIGINT AS points FROM m GROUP BY 1, 2"""


SQL = {
    "grid_squares": _grid_sql(),
    "h3_dna": f"WITH {_GEO}," + _h3_sql(7, "geo") + ", counts AS (SELECT city, cell, category, count(*)::DOUBLE AS n FROM geo JOIN cells7 USING (lat, lon) GROUP BY ALL), " + _METRICS.format(keys="city, cell", prefix="") + """
      SELECT city, cell, poi_count, cat_richness, round(h, 6) + 0.0 AS cat_shannon, round(h / nullif(ln(cat_richness), 0), 6) AS cat_evenness, round(gs, 6) AS cat_gini_simpson, round(exp(h), 6) AS cat_hill_q1, round(1 / pp, 6) AS cat_hill_q2, round(top, 6) AS top_cat_share, dominant_category,
      CASE WHEN poi_count <= 1 THEN NULL WHEN f1 = 0 THEN 1.0 ELSE round(1 - f1 / poi_count * ((poi_count - 1) * f1 / nullif((poi_count - 1) * f1 + 2 * f2, 0)), 6) END AS sample_coverage FROM cells WHERE poi_count >= 5""",
    "h3_counts": f"WITH {_GEO}," + ",".join(_h3_sql(r, "geo") for r in RESOLUTIONS) + " " + " UNION ALL ".join(f"SELECT {r} AS res, lower(hex(cell)) AS cell, count(*) AS points FROM geo JOIN cells{r} USING (lat, lon) GROUP BY 2" for r in RESOLUTIONS),
}
