"""The British national grid: transverse Mercator by its series, and the shift between the datum of satellites and that of the grid."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: half axes of both ellipsoids; the grid's scale, true origin and its coordinates; shift (m), scale and turns (seconds) of the datum
GRID_AXES, GPS_AXES = (6377563.396, 6356256.909), (6378137.0, 6356752.314245)
SCALE, ORIGIN, EAST, NORTH = 0.9996012717, (49.0, -2.0), 400000.0, -100000.0
SHIFT, GROWTH, TURNS = (-446.448, 125.157, -542.060), 20.4894e-6, (-0.1502, -0.2470, -0.8421)
STEPS = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _meridian(lat: Column) -> Column:
    """Length of the meridian from the true origin's latitude, on the grid."""
    a, b = GRID_AXES
    n, zero = (a - b) / (a + b), math.radians(ORIGIN[0])
    terms = (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * (lat - zero),
        -(3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(lat - zero) * F.cos(lat + zero),
        15 / 8 * (n**2 + n**3) * F.sin(2 * (lat - zero)) * F.cos(2 * (lat + zero)),
        -35 / 24 * n**3 * F.sin(3 * (lat - zero)) * F.cos(3 * (lat + zero)),
    )
    return b * SCALE * (terms[0] + terms[1] + terms[2] + terms[3])


def _curvature(lat: Column) -> tuple[Column, Column]:
    """Radii across and along the meridian, on the grid."""
    a, b = GRID_AXES
    e2 = 1 - (b / a) ** 2
    flat = 1 - e2 * F.sin(lat) * F.sin(lat)
    return a * SCALE / F.sqrt(flat), a * SCALE * (1 - e2) / (flat * F.sqrt(flat))


def grid_from_datum(lat: Column, lon: Column) -> Column:
    """east, north (metres) of a point in degrees of the grid's own datum."""

    def of(p: Column) -> Column:
        phi, d = p["phi"], p["lam"] - math.radians(ORIGIN[1])
        nu, rho = _curvature(phi)
        ratio, c, t = nu / rho, F.cos(phi), F.tan(phi) * F.tan(phi)
        north = _meridian(phi) + NORTH + nu * F.sin(phi) * c * (d**2 / 2 + d**4 * c**2 * (5 - t + 9 * (ratio - 1)) / 24 + d**6 * c**4 * (61 - 58 * t + t * t) / 720)
        east = EAST + nu * c * (d + d**3 * c**2 * (ratio - t) / 6 + d**5 * c**4 * (5 - 18 * t + t * t + 14 * (ratio - 1) - 58 * t * (ratio - 1)) / 120)
        return F.struct(east.alias("east"), north.alias("north"))

    return _let(F.struct(F.radians(lat).alias("phi"), F.radians(lon).alias("lam")), of)


def datum_from_grid(east: Column, north: Column) -> Column:
    """lat, lon (degrees) in the grid's own datum."""
    radius = GRID_AXES[0] * SCALE
    # the latitude whose meridian has the northing's length
    foot = F.aggregate(F.array(*map(F.lit, range(STEPS))), math.radians(ORIGIN[0]) + (north - NORTH) / radius, lambda phi, _: phi + (north - NORTH - _meridian(phi)) / radius)

    def of(phi: Column) -> Column:
        nu, rho = _curvature(phi)
        ratio, t, d = nu / rho, F.tan(phi) * F.tan(phi), (east - EAST) / nu
        lat = phi - F.tan(phi) * ratio * (d**2 / 2 - d**4 * (5 + 3 * t + (ratio - 1) * (1 - 9 * t)) / 24 + d**6 * (61 + 90 * t + 45 * t * t) / 720)
        lon = (d - d**3 * (ratio + 2 * t) / 6 + d**5 * (5 + 28 * t + 24 * t * t) / 120 - d**7 * (61 + 662 * t + 1320 * t * t + 720 * t * t * t) / 5040) / F.cos(phi)
        return F.struct(F.degrees(lat).alias("lat"), (ORIGIN[1] + F.degrees(lon)).alias("lon"))

    return _let(foot, of)


def _shifted(lat: Column, lon: Column, before: tuple[float, float], after: tuple[float, float], sign: int) -> Column:
    """lat, lon on another ellipsoid, by the shift of the datum forwards (1) or, nearly, backwards (-1); points are on the ground."""
    e2 = 1 - (before[1] / before[0]) ** 2
    phi, lam = F.radians(lat), F.radians(lon)
    nu = before[0] / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    start = F.struct((nu * F.cos(phi) * F.cos(lam)).alias("x"), (nu * F.cos(phi) * F.sin(lam)).alias("y"), (nu * (1 - e2) * F.sin(phi)).alias("z"))
    tx, ty, tz = (sign * s for s in SHIFT)
    rx, ry, rz = (sign * math.radians(s / 3600) for s in TURNS)
    k = 1 + sign * GROWTH

    def turned(p: Column) -> Column:
        x, y, z = p["x"], p["y"], p["z"]
        return F.struct((tx + k * x - rz * y + ry * z).alias("x"), (ty + rz * x + k * y - rx * z).alias("y"), (tz - ry * x + rx * y + k * z).alias("z"))

    def placed(p: Column) -> Column:
        a, b = after
        e2, ep2 = 1 - (b / a) ** 2, (a / b) ** 2 - 1
        flat = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
        theta = F.atan2(p["z"] * a, flat * b)
        up = F.atan2(p["z"] + ep2 * b * F.pow(F.sin(theta), 3), flat - e2 * a * F.pow(F.cos(theta), 3))
        return F.struct(F.degrees(up).alias("lat"), F.degrees(F.atan2(p["y"], p["x"])).alias("lon"))

    return _let(_let(start, turned), placed)


def national_grid(lat: Column, lon: Column) -> Column:
    """east, north (metres) on the national grid of a point in degrees as satellites give it. The shift of the datum is the usual one of
    seven parameters, good to about five metres in Britain."""
    return _let(_shifted(lat, lon, GPS_AXES, GRID_AXES, 1), lambda p: grid_from_datum(p["lat"], p["lon"]))


def from_national_grid(east: Column, north: Column) -> Column:
    """lat, lon (degrees, as satellites give it): the inverse of national_grid, to less than a millimetre."""

    def near(p: Column) -> Column:
        return _shifted(p["lat"], p["lon"], GRID_AXES, GPS_AXES, -1)

    def better(p: Column) -> Callable[[Column], Column]:
        # what the shift forwards makes of the first guess shows how far it is off
        return lambda q: _let(_shifted(q["lat"], q["lon"], GPS_AXES, GRID_AXES, 1), lambda r: F.struct((q["lat"] + p["lat"] - r["lat"]).alias("lat"), (q["lon"] + p["lon"] - r["lon"]).alias("lon")))

    return _let(datum_from_grid(east, north), lambda p: _let(near(p), better(p)))
