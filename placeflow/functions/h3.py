"""H3 cells and their boundaries in columns, from the public description of the grid: an icosahedron's faces, each with
a hexagonal grid in gnomonic projection, and finer grids of a seventh of the cells' area, turned to and fro.

All geometry is derived once from the fixed values below: corners and neighbours of faces, the base cells and how each is turned
against every face that sees it. A point goes to the nearest face, to the nearest cell there, and up through the coarser grids,
which gives its digits. A boundary goes down again: the digits give the centre in the plane of the base cell's home face; what
lies beyond that face's edge is folded onto the next one.
"""

from __future__ import annotations

import cmath
import math
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the grid: latitude and longitude of the faces' centres, and the azimuth of their first axis, in radians
FACES = (
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
    (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
    (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
    (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
    (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
    (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
    (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
    (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
)
# fixed values: the home faces of the base cells that lie on an edge between two faces
EDGE_HOMES = {
    1: 2, 5: 1, 11: 1, 13: 3, 19: 2, 22: 0, 28: 4, 30: 0, 35: 11, 39: 6, 40: 7, 43: 3, 52: 10, 53: 4, 54: 12,
    67: 5, 68: 16, 69: 8, 78: 15, 81: 14, 82: 13, 86: 9, 91: 17, 93: 16, 99: 17, 102: 19, 108: 15, 110: 18, 116: 18, 120: 19,
}
#: Gnomonic length of a step of the coarsest grid, the turn of every second grid, and the finest grid.
UNIT, TURN, FINEST = 0.38196601125010500003, math.atan(math.sqrt(3) / 5), 15
#: Digits of the six directions in steps of 60 degrees from the first axis; the two other axes are digits 2 and 1.
AROUND = (4, 6, 2, 3, 1, 5)
_STEP = {d: cmath.rect(1, math.radians(60 * k)) for k, d in enumerate(AROUND)} | {0: 0j}
_AXES = (_STEP[4], _STEP[2], _STEP[1])


class _Face:
    def __init__(self, lat: float, lng: float, azimuth: float) -> None:
        self.centre = (math.cos(lat) * math.cos(lng), math.cos(lat) * math.sin(lng), math.sin(lat))
        north = (-math.sin(lat) * math.cos(lng), -math.sin(lat) * math.sin(lng), math.cos(lat))
        east = (-math.sin(lng), math.cos(lng), 0.0)
        self.x = tuple(math.cos(azimuth) * n + math.sin(azimuth) * e for n, e in zip(north, east, strict=True))
        self.y = tuple(math.sin(azimuth) * n - math.cos(azimuth) * e for n, e in zip(north, east, strict=True))

    def matrix(self, turn: complex = 1, shift: complex = 0) -> list[list[float]]:
        """What makes a direction of (1, x, y) for plane points that turn * z + shift bring to this face's plane."""
        one, re, im = (complex(z) for z in (shift, turn, turn * 1j))
        column = lambda z, c: [UNIT * (z.real * x + z.imag * y) + c * o for x, y, o in zip(self.x, self.y, self.centre, strict=True)]
        return [list(r) for r in zip(column(one, 1), column(re, 0), column(im, 0), strict=True)]

    def direction(self, z: complex) -> tuple[float, ...]:
        v = [r[0] + r[1] * z.real + r[2] * z.imag for r in self.matrix()]
        size = math.sqrt(sum(a * a for a in v))
        return tuple(a / size for a in v)


def _same(v: tuple[float, ...]) -> tuple[int, ...]:
    return tuple(round(a * 1e6) for a in v)


@cache
def _grid() -> dict:
    """base: (face, ijk) -> base cell; turns: (face, ijk) -> its turns for each leading digit; home, kind and sectors of each base cell."""
    faces = [_Face(*f) for f in FACES]
    corner = {(f, a): _same(face.direction(2 * _AXES[a])) for f, face in enumerate(faces) for a in range(3)}
    beyond: dict[tuple[int, int], tuple[int, complex, complex]] = {}  # (face, corner opposite the edge) -> neighbour, turn, shift
    for f in range(20):
        for a in range(3):
            p, q = ((a + 1) % 3, (a + 2) % 3)
            for g in range(20):
                there = {corner[g, b]: b for b in range(3)}
                if g != f and corner[f, p] in there and corner[f, q] in there:
                    gp, gq = (2 * _AXES[there[corner[f, c]]] for c in (p, q))
                    turn = (gq - gp) / (2 * _AXES[q] - 2 * _AXES[p])
                    beyond[f, a] = (g, turn, gp - turn * 2 * _AXES[p])
    places: dict[tuple[int, tuple[int, int, int]], tuple[tuple[int, ...], int, complex]] = {}
    for f in range(20):
        for ijk in ((i, j, k) for i in range(3) for j in range(3) for k in range(3) if not i * j * k):
            z = sum(n * a for n, a in zip(ijk, _AXES, strict=True))
            on, turn = f, 1 + 0j
            if sum(ijk) > 2:  # over the edge opposite the axis that is not used
                on, turn, shift = beyond[f, ijk.index(0)]
                z = turn * z + shift
            places[f, ijk] = (_same(faces[on].direction(z)), on, turn)
    number = {p: n for n, p in enumerate(sorted({p for p, _, _ in places.values()}, key=lambda p: -p[2]))}
    base = {at: number[p] for at, (p, _, _) in places.items()}
    five = {base[f, (2, 0, 0)] for f in range(20)}
    home: dict[int, tuple[int, tuple[int, int, int]]] = {}
    for (f, ijk), n in sorted(base.items(), reverse=True):
        if sum(ijk) < 2 or ijk == (2, 0, 0) and home.get(n, (99,))[0] != 19 or sum(ijk) == 2 and max(ijk) == 1 and EDGE_HOMES[n] == f:
            home[n] = (f, ijk)
    polar = lambda f: f < 5 or f > 14
    turns = {}
    for (f, ijk), n in base.items():
        _, on, turn = places[f, ijk]
        rotations = [0] * 7
        if n not in five:
            if on != home[n][0]:
                turn *= next(t for (x, _), (g, t, _) in beyond.items() if (x, g) == (on, home[n][0]))
            rotations = [round(math.degrees(cmath.phase(turn)) / 60) % 6] * 7
        elif sum(ijk) == 2:
            if polar(home[n][0]):
                times = f if f < 5 else 19 - f
            else:
                times = 0 if f == home[n][0] or polar(f) and ijk[2] else 1 if polar(f) else 3
            backwards = not polar(home[n][0]) and (polar(f) and ijk[1] == 2 or not polar(f) and f != home[n][0] and any(polar(g) and base[g, (0, 0, 2)] == n for (x, _), (g, _, _) in beyond.items() if x == f))
            for lead in AROUND:
                digit, total = lead, 0
                if digit == 1:
                    digit, total = _turned(digit, -1 if backwards else 1), -1 if backwards else 1
                for _ in range(times):
                    digit, total = _turned(digit, 1), total + 1
                    if digit == 1:
                        digit, total = _turned(digit, 1), total + 1
                rotations[lead] = total % 6
        turns[f, ijk] = rotations
    sectors, spun = {}, {}
    for n, (f, _) in home.items():
        own = [(f, 1 + 0j, 0j)]
        if n not in five:
            own += [beyond[f, a] for a in range(3)]
        else:  # from the home face over its edge on the side of the second axis, and on around the corner
            at, total, moved = own[0]
            for _ in range(4):
                # the edge that holds the corner and lies ahead is opposite the last corner
                here = next(a for a in range(3) if corner[at, a] == corner[f, 0])
                at, turn, shift = beyond[at, (here + 2) % 3]
                total, moved = turn * total, turn * moved + shift
                own.append((at, total, moved))
        sectors[n] = [faces[g].matrix(turn, shift) for g, turn, shift in own]
        spun[n] = [round(math.degrees(cmath.phase(turn)) / 60) % 6 for _, turn, _ in own]
    return {"base": base, "turns": turns, "home": home, "five": five, "sectors": sectors, "spun": spun, "faces": faces}


def _turned(digit: int, times: int) -> int:
    return AROUND[(AROUND.index(digit) + times) % 6]


def _table(values: list, kind: str = "double") -> Column:
    """A constant array, as one text that the optimizer turns into its values once."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{kind}>")


def _at(table: Column, index: Column) -> Column:
    return F.element_at(table, (index + 1).cast("int"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _scaled(r: int) -> complex:
    """A step of grid r in the plane of the coarsest."""
    return cmath.rect(math.sqrt(7) ** -r, TURN * (r % 2))


def _doubles(x: float, a: Column, y: float, b: Column) -> Column:
    return x * a + y * b


def with_h3_cell(points: DataFrame, lat: str, lng: str, res: int, name: str = "cell") -> DataFrame:
    """points with the index (long) of the cell of a grid, 0 to 15, that holds each: null where lat or lng (degrees) is not finite or beyond
    the poles. A column of that name is replaced.

    Each step is a projection of its own, so that nothing is computed twice; the last one is a generator of one value, which keeps
    filters on the cell from being pushed into the steps. Some steps hold an expression that is not compiled (_let), so that those
    between are compiled in pieces: all in one is a method too long for the JVM to optimize, and takes four times as long.
    """
    grid = _grid()
    spots = [(f, (i, j, k)) for f in range(20) for i in range(3) for j in range(3) for k in range(3)]
    bases = _table([grid["base"].get(s, -1) for s in spots], "int")
    turns = _table([t for s in spots for t in grid["turns"].get(s, [0] * 7)], "int")
    turned = _table([_turned(d, t) if d else 0 for t in range(6) for d in range(7)], "int")
    axes = _table([c for face in grid["faces"] for axis in (face.x, face.y) for c in axis])
    fine = 1 / _scaled(res) / UNIT
    own = [F.col(f"`{c}`") for c in points.columns if c != name]

    def step(frame: DataFrame, **new: Column) -> DataFrame:
        return frame.select("*", *(v.alias(f"__h3_{k}") for k, v in new.items()))

    at = lambda k: F.col(f"__h3_{k}")
    sound = F.col(f"`{lat}`").between(-90.0, 90.0) & (F.abs(F.col(f"`{lng}`")) < float("inf"))
    rows = step(points, up=F.radians(F.when(sound, F.col(f"`{lat}`"))), round=F.radians(F.when(sound, F.col(f"`{lng}`"))))
    rows = step(rows, x=F.cos(at("up")) * F.cos(at("round")), y=F.cos(at("up")) * F.sin(at("round")), z=F.sin(at("up")))
    rows = step(rows, dots=F.array(*(sum(at(c) * n for c, n in zip("xyz", face.centre, strict=True)) for face in grid["faces"])))
    rows = step(rows, dot=_let(F.array_max(at("dots")), lambda v: v))
    rows = step(rows, face=F.array_position(at("dots"), at("dot")).cast("int") - 1)
    rows = step(rows, **{c: sum(at(v) * _at(axes, at("face") * 6 + 3 * k + i) for i, v in enumerate("xyz")) / at("dot") for k, c in enumerate(("px", "py"))})
    rows = step(rows, r=_doubles(fine.imag, at("px"), fine.real, at("py")) / (math.sqrt(3) / 2))
    rows = step(rows, s=_let(-(_doubles(fine.real, at("px"), -fine.imag, at("py")) + at("r") / 2), lambda v: v))
    rows = step(rows, q=-at("s") - at("r"))
    rows = step(rows, **{f"w{c}": F.floor(at(c) + 0.5) for c in "qrs"})
    rows = step(rows, **{f"d{c}": F.abs(at(f"w{c}") - at(c)) for c in "qrs"})
    rows = step(rows, b0=F.when((at("dr") >= at("dq")) & (at("dr") > at("ds")), -at("wq") - at("ws")).otherwise(at("wr")), q0=F.when((at("dq") > at("dr")) & (at("dq") > at("ds")), -at("wr") - at("ws")).otherwise(at("wq")))
    rows = step(rows, a0=at("q0") + at("b0"))
    for k, r in enumerate(range(res, 0, -1)):
        a, b = at(f"a{k}"), at(f"b{k}")
        up = (3 * a - b, a + 2 * b) if r % 2 else (2 * a + b, 3 * b - a)
        rows = step(rows, **{f"{c}{k + 1}": F.floor(u / 7 + 0.5) for c, u in zip("ab", up, strict=True)})
        a1, b1 = at(f"a{k + 1}"), at(f"b{k + 1}")
        down = (2 * a1 + b1, 3 * b1 - a1) if r % 2 else (3 * a1 - b1, a1 + 2 * b1)
        rows = step(rows, **{f"e{k}": a - down[0], f"f{k}": b - down[1]})
        rows = step(rows, **{f"low{k}": _let(F.least(at(f"e{k}"), at(f"f{k}"), F.lit(0)), lambda v: v)})
        rows = step(rows, **{f"digit{r}": (4 * at(f"e{k}") + 2 * at(f"f{k}") - 7 * at(f"low{k}")).cast("int")})
    a, b = at(f"a{res}"), at(f"b{res}")
    rows = step(rows, low=F.least(a, b, F.lit(0)))
    rows = step(rows, spot=(at("face") * 27 + (a - at("low")) * 9 + (b - at("low")) * 3 - at("low")).cast("int"), lead=F.coalesce(*(F.nullif(at(f"digit{r}"), F.lit(0)) for r in range(1, res + 1)), F.lit(0)))
    rows = step(rows, turn=_at(turns, at("spot") * 7 + at("lead")) * 7)
    fixed = (1 << 59) + (res << 52) + sum(7 << (45 - 3 * r) for r in range(res + 1, FINEST + 1))
    cell = F.lit(fixed) + _at(bases, at("spot")) * F.lit(1 << 45)
    for r in range(1, res + 1):
        cell = cell + _at(turned, at("turn") + at(f"digit{r}")) * F.lit(1 << (45 - 3 * r)).cast("long")
    return rows.select(*own, F.explode(F.array(cell)).alias(name))


def h3_name(cell: Column) -> Column:
    """An index as hexadecimal digits, the usual way to write it."""
    return F.lower(F.hex(cell))


def h3_parse(name: Column) -> Column:
    return F.conv(name, 16, 10).try_cast("long")


def _read(cell: Column) -> Column:
    """base, res, digits, lead of an index."""
    bits = lambda shift, mask: F.shiftright(cell, shift).bitwiseAND(F.lit(mask)).cast("int")
    res = bits(52, 15)
    digits = F.slice(F.array(*(bits(45 - 3 * r, 7) for r in range(1, FINEST + 1))), 1, res)
    whole = F.struct(bits(45, 127).alias("base"), res.alias("res"), digits.alias("digits"))
    lead = lambda w: F.coalesce(F.try_element_at(F.filter(w["digits"], lambda d: d > 0), F.lit(1)), F.lit(0))
    return _let(whole, lambda w: F.struct(w["base"].alias("base"), w["res"].alias("res"), w["digits"].alias("digits"), lead(w).alias("lead")))


def _centred(h: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, y: the cell's centre in the plane of its base cell's home face."""
    grid = _grid()
    steps = [_STEP[d] * _scaled(r) for r in range(FINEST + 1) for d in range(7)]
    begins = [sum(n * a for n, a in zip(grid["home"][b][1], _AXES, strict=True)) for b in range(122)]
    xs, ys = _table([z.real for z in steps]), _table([z.imag for z in steps])
    start = F.struct(_at(_table([z.real for z in begins]), h["base"]).alias("x"), _at(_table([z.imag for z in begins]), h["base"]).alias("y"))
    at = F.transform(h["digits"], lambda d, i: (i + 1) * 7 + d)
    return _let(F.aggregate(at, start, lambda z, i: F.struct((z["x"] + _at(xs, i)).alias("x"), (z["y"] + _at(ys, i)).alias("y"))), body)


def _wedge(x: Column, y: Column) -> Column:
    """0 to 5: sixths of the plane around a corner, from the home face's edge on the side of the second axis clockwise; 4 is missing on
    the globe, 5 is the home face."""
    turn = F.pmod(150.0 - F.degrees(F.atan2(y, x - 2.0)), F.lit(360.0))
    return F.least(F.floor(turn / 60.0), F.lit(5)).cast("int")


def _sector(five: Column, x: Column, y: Column) -> Column:
    """On a pentagon's plane the sixth; else 0 on the home face, and 1 to 3 beyond its edges opposite each corner."""
    over = F.lit(0)
    for a, axis in enumerate(_AXES, 1):
        over = F.when(-axis.real * x - axis.imag * y > 1 + 1e-12, a).otherwise(over)
    return F.when(five, _wedge(x, y)).otherwise(over)


def _side(h: Column, five: Column, sector: Column) -> Column:
    """The place of a sector's face among those of the base cell; what is on the missing sixth adjoins the side that the cell is on."""
    return F.when(~five, sector).when(sector == 4, F.when(h["lead"] == 3, 4).otherwise(0)).otherwise((sector + 1) % 6)


def _on_globe(h: Column, five: Column, sector: Column, x: Column, y: Column) -> Column:
    """lat, lng of a point in the home face's plane; in the missing sixth, what adjoins the side that the cell is on."""
    matrices = _table([v for b in range(122) for s in range(5) for row in (_grid()["sectors"][b] + [[[0.0] * 3] * 3])[s] for v in row])
    lost = five & (sector == 4)
    turn = F.when(lost, F.when(h["lead"] == 3, 1.0).otherwise(-1.0))
    half = math.sqrt(3) / 2

    def placed(p: Column) -> Column:
        begin = (h["base"] * 5 + _side(h, five, sector)) * 9
        v = F.struct(*((_at(matrices, begin + 3 * i) + _at(matrices, begin + 3 * i + 1) * p["x"] + _at(matrices, begin + 3 * i + 2) * p["y"]).alias(c) for i, c in enumerate("xyz")))
        return _let(v, lambda v: F.struct(F.degrees(F.atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))).alias("lat"), F.degrees(F.atan2(v["y"], v["x"])).alias("lng")))

    moved = F.struct(F.when(lost, 2.0 + (x - 2.0) * 0.5 - turn * half * y).otherwise(x).alias("x"), F.when(lost, turn * half * (x - 2.0) + 0.5 * y).otherwise(y).alias("y"))
    return _let(moved, placed)


def _five(h: Column) -> Column:
    return h["base"].isin(*sorted(_grid()["five"]))


def h3_centre(cell: Column) -> Column:
    """lat, lng (degrees) of a cell's centre."""
    def of(h: Column) -> Column:
        return _let(_five(h), lambda five: _centred(h, lambda z: _let(_sector(five, z["x"], z["y"]), lambda s: _on_globe(h, five, s, z["x"], z["y"]))))

    return F.when(cell.isNotNull(), _let(_read(cell), of))


def h3_boundary(cell: Column) -> Column:
    """lat, lng (degrees) of a cell's corners, counter-clockwise. In every second grid a side that crosses an edge of the icosahedron has
    a corner there too; pentagons have five sides. Null for null."""
    grid = _grid()
    spokes = [cmath.rect(math.sqrt(7) ** -r / math.sqrt(3), math.radians(30 + 60 * k) + TURN * (r % 2)) for r in range(FINEST + 1) for k in range(6)]
    xs, ys = _table([z.real for z in spokes]), _table([z.imag for z in spokes])
    # corners are counted from the first axis of the face that the centre is on
    backs = _table([-t % 6 for b in range(122) for t in (grid["spun"][b] + [0])[:5]], "int")

    def of(h: Column) -> Column:
        return _let(_five(h), lambda five: _centred(h, lambda z: _let(_sector(five, z["x"], z["y"]), lambda s: around(h, five, z, s))))

    def around(h: Column, five: Column, z: Column, centre: Column) -> Column:
        point = lambda k: F.struct((z["x"] + _at(xs, h["res"] * 6 + k % 6)).alias("x"), (z["y"] + _at(ys, h["res"] * 6 + k % 6)).alias("y"))
        whole = five & (h["lead"] == 0)
        first = F.when(whole, 0).otherwise(_at(backs, h["base"] * 5 + _side(h, five, centre)))
        each = F.transform(F.array(*map(F.lit, range(6))), lambda k: _let(point(k + first), lambda p: _let(point(k + first + 1), lambda q: corners(h, five, whole, k, p, q))))
        return F.flatten(each)

    def corners(h: Column, five: Column, whole: Column, k: Column, p: Column, q: Column) -> Column:
        sectors = F.struct(_sector(five, p["x"], p["y"]).alias("p"), _sector(five, q["x"], q["y"]).alias("q"))

        def found(s: Column) -> Column:
            wide = F.greatest(s["p"], s["q"])
            angle = F.radians(150.0 - 60.0 * F.when((wide == 5) & (F.least(s["p"], s["q"]) == 0), 0).otherwise(wide))
            ray = F.struct((-F.sin(angle)).alias("x"), F.cos(angle).alias("y"), (-2.0 * F.sin(angle)).alias("d"))
            edge = F.struct(*(_at(_table([0.0, *(-getattr(a, part) for a in _AXES)]), wide).alias(c) for c, part in (("x", "real"), ("y", "imag"))), F.lit(1.0).alias("d"))
            line = F.when(five, ray).otherwise(edge)

            def crossing(n: Column) -> Column:
                share = (n["d"] - n["x"] * p["x"] - n["y"] * p["y"]) / F.nullif(n["x"] * (q["x"] - p["x"]) + n["y"] * (q["y"] - p["y"]), F.lit(0.0))
                point = lambda t: _on_globe(h, five, s["p"], p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
                return _let(share, lambda t: F.when(t.between(1e-6, 1 - 1e-6), F.array(point(t))).otherwise(F.array().cast("array<struct<lat:double,lng:double>>")))

            own = F.array(_on_globe(h, five, s["p"], p["x"], p["y"]))
            return F.when((h["res"] % 2 == 1) & (s["p"] != s["q"]), F.concat(own, _let(line, crossing))).otherwise(own)

        # of a pentagon's six corners in the plane one is on the missing sixth; it stands for the next one there
        return F.when(whole & (k == 3), F.array().cast("array<struct<lat:double,lng:double>>")).otherwise(_let(sectors, found))

    return F.when(cell.isNotNull(), _let(_read(cell), of))


def h3_boundary_wkt(cell: Column) -> Column:
    """A cell as WKT polygon, degrees to 6 places, longitude first; null for null."""

    def ring(points: Column) -> Column:
        return F.array_join(F.transform(F.concat(points, F.slice(points, 1, 1)), lambda p: F.format_string("%.6f %.6f", p["lng"], p["lat"])), ", ")

    return F.when(cell.isNotNull(), F.concat(F.lit("POLYGON (("), _let(h3_boundary(cell), ring), F.lit("))")))
