"""Grids: Japanese standard mesh codes, boxes of equal area, kilometres and degrees. All of it column arithmetic on doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of a level-3 cell, kilometres of a degree of latitude and of longitude at the equator.
MESH_LAT, MESH_LON, KM_LAT, KM_LON = 30.0 / 3600.0, 45.0 / 3600.0, 110.574, 111.320


def _digits(x: Column, width: int = 1) -> Column:
    return F.lpad(x.cast("long").cast("string"), width, "0")


def mesh_code(lat: Column, lon: Column, level: int = 3, strict: bool = False) -> Column:
    """The code of the level-1, -2 or -3 cell; outside 20-46 N, 122-154 E null, or an error if strict."""
    minutes = lat * 60.0
    row1 = F.floor(minutes / 40.0)
    rest = minutes - row1 * 40.0
    col1 = F.floor(lon)
    east = (lon - col1) * 60.0
    code = F.concat(_digits(row1, 2), _digits(col1 - 100, 2))
    if level >= 2:
        row2, col2 = F.floor(rest / 5.0), F.floor(east / 7.5)
        code = F.concat(code, _digits(row2), _digits(col2))
        if level >= 3:
            rest, east = rest - row2 * 5.0, east - col2 * 7.5
            code = F.concat(code, _digits(F.floor(rest * 60.0 / 30.0)), _digits(F.floor(east * 60.0 / 45.0)))
    inside = lat.between(20.0, 46.0) & lon.between(122.0, 154.0)
    bad = F.raise_error(F.concat(F.lit("outside the mesh: "), lat.cast("string"), F.lit(", "), lon.cast("string"))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(lat.isNull() | lon.isNull(), F.lit(None).cast("string")).when(inside, code).otherwise(bad)


def mesh_box(mesh: Column) -> Column:
    """lat_min, lon_min, lat_max, lon_max of a code of 4, 6 or 8 digits; null for others."""

    def digit(at: int, n: int = 1) -> Column:
        return F.substring(mesh, at, n).try_cast("double")

    size = F.length(mesh)
    lat = digit(1, 2) * 40.0 / 60.0
    lon = digit(3, 2) + 100.0
    lat2, lon2 = lat + digit(5) * 5.0 / 60.0, lon + digit(6) * 7.5 / 60.0
    lat3, lon3 = lat2 + digit(7) * 30.0 / 3600.0, lon2 + digit(8) * 45.0 / 3600.0

    def box(a: Column, o: Column, h: float, w: float) -> Column:
        return F.struct(a.alias("lat_min"), o.alias("lon_min"), (a + h).alias("lat_max"), (o + w).alias("lon_max"))

    return F.when(size == 4, box(lat, lon, 40.0 / 60.0, 1.0)).when(size == 6, box(lat2, lon2, 5.0 / 60.0, 7.5 / 60.0)).when(size == 8, box(lat3, lon3, MESH_LAT, MESH_LON))


def mesh_centre(mesh: Column) -> Column:
    box = mesh_box(mesh)
    return F.struct(((box["lat_min"] + box["lat_max"]) / 2).alias("lat"), ((box["lon_min"] + box["lon_max"]) / 2).alias("lon"))


def cell_size_km(lat: Column) -> Column:
    """Height and width of a level-3 cell at a latitude."""
    return F.struct(F.lit(MESH_LAT * KM_LAT).alias("height_km"), (MESH_LON * KM_LON * F.cos(F.radians(lat))).alias("width_km"))


def half_extents(lat: Column, area_km2: float, width_deg: float) -> Column:
    """Half the height and width, in degrees, of a box of the given area and width around a latitude."""
    width_km = width_deg * KM_LON * F.cos(F.radians(lat))
    return F.struct((F.lit(area_km2) / width_km / KM_LAT / 2).alias("half_lat"), F.lit(width_deg / 2).alias("half_lon"))


def equal_area_box(lat: float, lon: float, area_km2: float, width_deg: float) -> tuple[float, float, float, float]:
    """lat_min, lon_min, lat_max, lon_max of the same box for one centre, to prune a scan with constants."""
    half = area_km2 / (width_deg * KM_LON * math.cos(math.radians(lat))) / KM_LAT / 2
    return lat - half, lon - width_deg / 2, lat + half, lon + width_deg / 2


def shift_degrees(lat: Column, north_km: Column, east_km: Column) -> Column:
    return F.struct((north_km / KM_LAT).alias("d_lat"), (east_km / (KM_LON * F.cos(F.radians(lat)))).alias("d_lon"))


def square_cell(lat: Column, lon: Column, size_deg: float) -> Column:
    """A plain grid cell, for countries without a mesh: row and column of squares of size_deg."""
    return F.concat_ws("_", F.floor(lat / size_deg).cast("string"), F.floor(lon / size_deg).cast("string"))


def cell_wkt(box: Column) -> Column:
    """A box as WKT polygon, counter-clockwise from its south-west corner."""
    corner = [("lon_min", "lat_min"), ("lon_max", "lat_min"), ("lon_max", "lat_max"), ("lon_min", "lat_max"), ("lon_min", "lat_min")]
    points = F.concat_ws(", ", *(F.concat_ws(" ", box[x].cast("string"), box[y].cast("string")) for x, y in corner))
    return F.when(box.isNotNull(), F.concat(F.lit("POLYGON (("), points, F.lit("))")))
