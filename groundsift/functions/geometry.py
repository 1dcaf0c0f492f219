"""Geometry as native column expressions.

A ring is ARRAY<STRUCT<x,y>> and is explicitly closed; a part is an array of
rings, outer first; a geometry is an array of parts.  A *piece* is a trapezoid
with horizontal sides: y0, y1 and the x of its left and right side at both.
Everything here stays inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
GEOM = f"array<array<{RING}>>"
PIECE = ("y0", "y1", "xl0", "xl1", "xr0", "xr1")
PIECE_T = "struct<y0:double,y1:double,xl0:double,xl1:double,xr0:double,xr1:double>"

#: spherical Mercator radius and WGS 84 ellipsoid
MERC_R = 6378137.0
WGS_A = 6378137.0
WGS_F = 1 / 298.257223563
WGS_E2 = WGS_F * (2 - WGS_F)
WGS_E = math.sqrt(WGS_E2)


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once; a lambda would otherwise compute it at every use."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def box_geom(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(F.array(box_ring(x0, y0, x1, y1)))


def map_points(geom: Column, fn) -> Column:
    """Apply ``fn(x, y) -> (x, y)`` to every vertex."""

    def one(p):
        x, y = fn(p["x"], p["y"])
        return point(x, y)

    return F.transform(geom, lambda part: F.transform(part, lambda ring: F.transform(ring, one)))


def vertices(geom: Column) -> Column:
    return F.flatten(F.flatten(geom))


# ---- coordinate systems -------------------------------------------------------------------------


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return (F.radians(lon) * MERC_R,
            F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * MERC_R)


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return (F.degrees(x / MERC_R),
            F.degrees(F.lit(2.0) * F.atan(F.exp(y / MERC_R)) - math.pi / 2))


def _q(sin_lat: Column) -> Column:
    es = sin_lat * WGS_E
    return (1 - WGS_E2) * (sin_lat / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * WGS_E))


_QP = (1 - WGS_E2) * (1 / (1 - WGS_E2) - math.log((1 - WGS_E) / (1 + WGS_E)) / (2 * WGS_E))
_RQ = WGS_A * math.sqrt(_QP / 2)


def _laea_frame(lat0: Column):
    s0 = F.sin(F.radians(lat0))
    b0 = F.asin(_q(s0) / _QP)
    m0 = F.cos(F.radians(lat0)) / F.sqrt(1 - WGS_E2 * s0 * s0)
    return b0, WGS_A * m0 / (_RQ * F.cos(b0))


def laea(lon: Column, lat: Column, lon0, lat0) -> tuple[Column, Column]:
    """Ellipsoidal azimuthal equal-area projection centred on (lon0, lat0)."""
    lon0, lat0 = _c(lon0), _c(lat0)
    b0, d = _laea_frame(lat0)
    b = F.asin(_q(F.sin(F.radians(lat))) / _QP)
    dl = F.radians(lon - lon0)
    k = _RQ * F.sqrt(F.lit(2.0) / (1 + F.sin(b0) * F.sin(b) + F.cos(b0) * F.cos(b) * F.cos(dl)))
    return k * d * F.cos(b) * F.sin(dl), k / d * (F.cos(b0) * F.sin(b) - F.sin(b0) * F.cos(b) * F.cos(dl))


def laea_inverse(x: Column, y: Column, lon0, lat0) -> tuple[Column, Column]:
    lon0, lat0 = _c(lon0), _c(lat0)
    b0, d = _laea_frame(lat0)
    rho = F.sqrt((x / d) * (x / d) + (y * d) * (y * d))
    c = F.lit(2.0) * F.asin(rho / (2 * _RQ))
    safe = F.when(rho == 0, F.lit(1.0)).otherwise(rho)
    sin_b = F.cos(c) * F.sin(b0) + F.when(rho == 0, F.lit(0.0)).otherwise(d * y * F.sin(c) * F.cos(b0) / safe)
    b = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin_b)))
    e4, e6 = WGS_E2**2, WGS_E2**3

    def refined(b):
        series = (b + (WGS_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * b)
                  + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * b) + (761 * e6 / 45360) * F.sin(6 * b))
        # the series is good to a millimetre; one Newton step on the authalic relation takes it to rounding
        return let(series, lambda v: let(F.sin(v), lambda sl: v + (_QP * F.sin(b) - _q(sl)) / (
            2 * (1 - WGS_E2) * F.cos(v) / F.pow(1 - WGS_E2 * sl * sl, F.lit(2.0)))))

    lat = let(b, refined)
    lon = F.atan2(x * F.sin(c), d * rho * F.cos(b0) * F.cos(c) - d * d * y * F.sin(b0) * F.sin(c))
    return (F.when(rho == 0, lon0).otherwise(lon0 + F.degrees(lon)),
            F.when(rho == 0, lat0).otherwise(F.degrees(lat)))


# ---- measures -----------------------------------------------------------------------------------


def _edges(ring: Column, fn) -> Column:
    """Sum ``fn(a, b)`` over consecutive vertices."""
    return let(ring, lambda r: F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), F.lit(0.0),
        lambda acc, i: acc + F.coalesce(fn(F.get(r, i - 1), F.get(r, i)), F.lit(0.0))))


def ring_area(ring: Column) -> Column:
    """Signed area, positive when counter-clockwise; coordinates taken from the first vertex."""
    def of(r):
        o = F.get(r, F.lit(0))
        return _edges(r, lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])) / 2

    return let(ring, of)


def part_area(part: Column) -> Column:
    return let(F.transform(part, lambda r: F.abs(ring_area(r))), lambda a: F.aggregate(
        a, F.lit(0.0), lambda acc, v: acc - v) + 2 * F.get(a, F.lit(0)))


def area(geom: Column) -> Column:
    return F.aggregate(geom, F.lit(0.0), lambda acc, part: acc + part_area(part))


def line_length(line: Column) -> Column:
    return _edges(line, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def perimeter(geom: Column) -> Column:
    return F.aggregate(geom, F.lit(0.0), lambda acc, part: acc + F.aggregate(part, F.lit(0.0), lambda a, r: a + line_length(r)))


def _ring_moment(ring: Column, axis: str) -> Column:
    o = F.get(ring, F.lit(0))

    def term(a, b):
        ax, ay, bx, by = a["x"] - o["x"], a["y"] - o["y"], b["x"] - o["x"], b["y"] - o["y"]
        cross = ax * by - bx * ay
        return ((ax + bx) if axis == "x" else (ay + by)) * cross

    return _edges(ring, term) / 6 + ring_area(ring) * o[axis]


def centroid(geom: Column) -> Column:
    """Area centroid; holes are subtracted whatever their orientation."""

    def moment(axis):
        def of_part(part):
            def signed(r):
                m = _ring_moment(r, axis)
                return F.when(ring_area(r) < 0, -m).otherwise(m)
            total = F.aggregate(part, F.lit(0.0), lambda acc, r: acc - signed(r))
            return total + 2 * signed(F.get(part, F.lit(0)))
        return F.aggregate(geom, F.lit(0.0), lambda acc, part: acc + of_part(part))

    return let(area(geom), lambda a: point(moment("x") / a, moment("y") / a))


def bounds(geom: Column) -> Column:
    def of(pts):
        xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))

    return let(vertices(geom), of)


# ---- structure and validity ---------------------------------------------------------------------


def finite_in_range(geom: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """True when every coordinate is a finite number inside the range."""
    return F.forall(vertices(geom), lambda p: F.coalesce(
        p["x"].between(x0, x1) & p["y"].between(y0, y1) & ~F.isnan(p["x"]) & ~F.isnan(p["y"]), F.lit(False)))


def coordinate_count(geom: Column, with_structure: bool = False) -> Column:
    n = F.size(vertices(geom))
    if with_structure:  # rings and parts count against the budget too, and the root of several parts
        n = n + F.size(F.flatten(geom)) + F.size(geom) + F.when(F.size(geom) > 1, 1).otherwise(0)
    return n.cast("bigint")


def ring_structure_ok(geom: Column) -> Column:
    """Non-empty parts, at least four points per ring, first point repeated last."""
    return (F.size(geom) > 0) & F.forall(geom, lambda part: (F.size(part) > 0) & F.forall(
        part, lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1))))


def _orient(a, b, c):
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _on(a, b, p):
    return ((p["x"] >= F.least(a["x"], b["x"])) & (p["x"] <= F.greatest(a["x"], b["x"]))
            & (p["y"] >= F.least(a["y"], b["y"])) & (p["y"] <= F.greatest(a["y"], b["y"])))


def _meet(a, b, c, d) -> Column:
    """Closed segments a-b and c-d share a point."""
    o1, o2, o3, o4 = _orient(a, b, c), _orient(a, b, d), _orient(c, d, a), _orient(c, d, b)
    return (((o1 != o2) & (o3 != o4)) | ((o1 == 0) & _on(a, b, c)) | ((o2 == 0) & _on(a, b, d))
            | ((o3 == 0) & _on(c, d, a)) | ((o4 == 0) & _on(c, d, b)))


def ring_self_intersects(ring: Column) -> Column:
    """Two non-neighbouring sides meet, or a side folds back on the next one."""
    n = F.size(ring) - 1

    def pair(i, j):
        a, b, c, d = F.get(ring, i), F.get(ring, i + 1), F.get(ring, j), F.get(ring, j + 1)
        neighbour = (j == i + 1) | ((i == 0) & (j == n - 1))
        fold = F.when(j == i + 1, (_orient(a, b, d) == 0) & (_on(a, b, d) | _on(c, d, a)))
        fold = fold.otherwise((_orient(c, d, b) == 0) & (_on(c, d, b) | _on(a, b, c)))
        return F.when(neighbour, fold & (n > 2)).otherwise(_meet(a, b, c, d))

    return F.when(n >= 3, F.exists(F.sequence(F.lit(0), n - 2), lambda i: F.exists(
        F.sequence(i + 1, n - 1), lambda j: pair(i, j)))).otherwise(F.lit(True))


def _inside_ring(p, ring):
    def crosses(i):
        a, b = F.get(ring, i), F.get(ring, i + 1)
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (
            p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"])
    return F.size(F.filter(F.sequence(F.lit(0), F.size(ring) - 2), crosses)) % 2 == 1


def invalid_reason(geom: Column) -> Column:
    """NULL for a valid polygon geometry, otherwise the first rule it breaks."""
    rings = F.flatten(geom)
    hole_out = F.exists(geom, lambda part: F.exists(
        F.slice(part, 2, F.greatest(F.size(part), F.lit(1))),
        lambda r: ~F.exists(r, lambda p: _inside_ring(p, F.get(part, F.lit(0))))))
    return (F.when(geom.isNull() | (F.size(geom) == 0), "empty")
            .when(~ring_structure_ok(geom), "ring structure")
            .when(F.exists(rings, lambda r: ring_self_intersects(r)), "self-intersection")
            .when(F.exists(rings, lambda r: ring_area(r) == 0), "zero area")
            .when(hole_out, "hole outside shell"))


# ---- constructions ------------------------------------------------------------------------------


def clip_ring(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Clip a closed ring to a rectangle, side by side; the result is closed or empty."""
    def half(r, inside, cut):
        def step(i):
            a, b = F.get(r, i - 1), F.get(r, i)
            return (F.when(inside(a) & inside(b), F.array(b))
                    .when(inside(a), F.array(cut(a, b)))
                    .when(inside(b), F.array(cut(a, b), b))
                    .otherwise(F.expr("CAST(array() AS array<struct<x:double,y:double>>)")))
        out = F.when(F.size(r) > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), step))) \
            .otherwise(F.expr("CAST(array() AS array<struct<x:double,y:double>>)"))
        # bind the half-clipped ring once; it is read several times below
        return F.get(F.transform(F.array(out), lambda o: F.when(F.size(o) > 0, F.concat(F.slice(o, -1, 1), o)).otherwise(o)), F.lit(0))

    def at_x(v):
        return lambda a, b: point(v, a["y"] + (b["y"] - a["y"]) * (v - a["x"]) / (b["x"] - a["x"]))

    def at_y(v):
        return lambda a, b: point(a["x"] + (b["x"] - a["x"]) * (v - a["y"]) / (b["y"] - a["y"]), v)

    def chain(r, steps):
        if not steps:
            return r
        (inside, cut), rest = steps[0], steps[1:]
        return F.get(F.transform(F.array(half(r, inside, cut)), lambda q: chain(q, rest)), F.lit(0))

    return chain(ring, [(lambda p: p["x"] >= x0, at_x(x0)), (lambda p: p["x"] <= x1, at_x(x1)),
                        (lambda p: p["y"] >= y0, at_y(y0)), (lambda p: p["y"] <= y1, at_y(y1))])


def _grown_ring(ring: Column, counter_clockwise: bool, distance: Column, arc: int, join: str) -> Column:
    """Offset curve of one ring, to the right of its direction, which is outward for shells and into holes."""
    opened = F.filter(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    turned = F.when((ring_area(ring) < 0) == F.lit(counter_clockwise), F.reverse(opened)).otherwise(opened)

    def corners(r):
        n = F.size(r)

        def corner(p, i):
            a, b = F.get(r, (i + n - 1) % n), F.get(r, (i + 1) % n)
            frame = F.struct(F.atan2(a["x"] - p["x"], p["y"] - a["y"]).alias("start"), F.atan2(p["x"] - b["x"], b["y"] - p["y"]).alias("stop"))
            return let(frame, lambda f: let(
                F.struct(f["start"].alias("start"), f["stop"].alias("stop"), F.pmod(f["stop"] - f["start"] + math.pi, F.lit(2 * math.pi)).alias("turn")), lambda g: joined(p, g)))

        def at(p, angle, reach=None):
            d = distance if reach is None else distance * reach
            return point(p["x"] + d * F.cos(angle), p["y"] + d * F.sin(angle))

        def joined(p, g):
            turn = g["turn"] - math.pi  # left turns are convex for the ground on the left
            if join == "mitre":
                convex = F.array(at(p, g["start"] + turn / 2, 1 / F.cos(turn / 2)))
            else:
                steps = F.ceil(turn * (2 * arc / math.pi) - 1e-9).cast("int")
                convex = F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), lambda s: at(p, g["start"] + turn * s / F.greatest(steps, F.lit(1))))
            return F.when(turn >= -1e-12, convex).otherwise(F.array(at(p, g["start"]), p, at(p, g["stop"])))

        return F.flatten(F.transform(r, corner))

    closed = let(let(turned, corners), lambda c: F.concat(c, F.slice(c, 1, 1)))
    return F.when(F.size(opened) > 2, closed).otherwise(F.expr(f"CAST(array() AS {RING})"))


def grown(geom: Column, distance: Column | float, arc: int = 16, join: str = "round") -> Column:
    """Offset curves of a polygon, ``distance`` outward; ``arc`` chords to a quarter circle at convex corners, or one mitre.

    Every side sweeps a rectangle and every convex corner a sector, all with
    the winding of the shell; at a concave corner the curve goes back to the
    vertex, so nothing is swept twice the other way.  The grown polygon is the
    ground around which the curves wind at all: holes that close wind to zero
    nowhere.  Curves may cross themselves and each other; use the winding rule.
    """
    d = _c(distance)
    return F.transform(geom, lambda part: F.transform(part, lambda ring, i: F.when(
        i == 0, _grown_ring(ring, True, d, arc, join)).otherwise(_grown_ring(ring, False, d, arc, join))))


def rotated_square(cx: Column, cy: Column, side: Column, degrees: Column) -> Column:
    a = F.radians(degrees)
    h = side / 2

    def corner(dx, dy):
        return point(cx + dx * h * F.cos(a) - dy * h * F.sin(a), cy + dx * h * F.sin(a) + dy * h * F.cos(a))

    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    return F.array(F.array(ring))


def normal_ring(ring: Column) -> Column:
    """Counter-clockwise, opened, rotated to start at the smallest vertex."""
    ccw = F.when(ring_area(ring) < 0, F.reverse(ring)).otherwise(ring)
    opened = F.slice(ccw, 1, F.greatest(F.size(ring) - 1, F.lit(1)))
    return F.get(F.transform(F.array(opened), lambda o: F.get(F.transform(
        F.array(F.array_position(o, F.array_min(o)).cast("int")),
        lambda k: F.concat(F.slice(o, k, F.size(o)), F.slice(o, 1, k - 1))), F.lit(0))), F.lit(0))


def geometry_hash(geom: Column, prefix: Column | None = None) -> Column:
    """Digest that does not depend on ring start, direction or part order."""
    parts = F.array_sort(F.transform(geom, lambda part: F.to_json(F.concat(
        F.transform(F.slice(part, 1, 1), normal_ring),
        F.array_sort(F.transform(F.slice(part, 2, F.greatest(F.size(part), F.lit(1))), normal_ring))))))
    text = F.array_join(parts, "|")
    return F.sha2(F.concat(prefix, text) if prefix is not None else text, 256)


# ---- pieces -------------------------------------------------------------------------------------


def box_piece(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(y0.alias("y0"), y1.alias("y1"), x0.alias("xl0"), x0.alias("xl1"), x1.alias("xr0"), x1.alias("xr1"))


def piece_area(p=None) -> Column:
    p = p if p is not None else {k: F.col(k) for k in PIECE}
    return ((p["xr0"] - p["xl0"]) + (p["xr1"] - p["xl1"])) / 2 * (p["y1"] - p["y0"])


def piece_overlap(a, b) -> Column:
    """Exact common area of two pieces.

    The width min(right) - max(left) is linear between the heights where two
    sides cross, so the trapezoid rule over those heights is exact.
    """
    ya, yb = F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"])

    def line(p, side):
        slope = (p[f"x{side}1"] - p[f"x{side}0"]) / (p["y1"] - p["y0"])
        return p[f"x{side}0"] - slope * p["y0"], slope

    la, lb, ra, rb = line(a, "l"), line(b, "l"), line(a, "r"), line(b, "r")
    crossings = [F.when(p[1] != q[1], (q[0] - p[0]) / (p[1] - q[1])) for p, q in ((la, lb), (ra, rb), (la, rb), (lb, ra))]
    upright = (la[1] == 0) & (lb[1] == 0) & (ra[1] == 0) & (rb[1] == 0)
    ys = F.array_sort(F.concat(F.array(ya, yb), F.filter(F.array(*crossings), lambda y: (y > ya) & (y < yb))))

    def width(y):
        return F.greatest(F.lit(0.0), F.least(ra[0] + ra[1] * y, rb[0] + rb[1] * y) - F.greatest(la[0] + la[1] * y, lb[0] + lb[1] * y))

    # widths are taken once per height; heights and widths are bound as lambda variables, not recomputed
    nodes = F.transform(ys, lambda y: F.struct(y.alias("y"), width(y).alias("w")))
    first = F.struct(F.lit(0.0).alias("sum"), ya.alias("y"), F.lit(0.0).alias("w"))
    exact = F.aggregate(nodes, first, lambda acc, n: F.struct(
        (acc["sum"] + (acc["w"] + n["w"]) / 2 * (n["y"] - acc["y"])).alias("sum"), n["y"].alias("y"), n["w"].alias("w")))["sum"]
    flat = F.greatest(F.lit(0.0), F.least(a["xr0"], b["xr0"]) - F.greatest(a["xl0"], b["xl0"])) * (yb - ya)
    return F.when(yb <= ya, F.lit(0.0)).when(upright, flat).otherwise(exact)
