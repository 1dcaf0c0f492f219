"""Figures of one pair of geometries, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundsift.functions import geometry as G


def edges(geom: Column) -> Column:
    """All sides of a geometry as STRUCT<a, b>."""
    return F.flatten(F.transform(F.flatten(geom), lambda r: F.transform(
        F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.struct(F.get(r, i - 1).alias("a"), F.get(r, i).alias("b")))))


def foot(p, e) -> Column:
    """Nearest point of side ``e`` to ``p`` with its distance: STRUCT<d, px, py, qx, qy>."""
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - e["a"]["x"]) * dx + (p["y"] - e["a"]["y"]) * dy) / n)))
    qx, qy = e["a"]["x"] + t * dx, e["a"]["y"] + t * dy
    return F.struct(F.hypot(p["x"] - qx, p["y"] - qy).alias("d"), p["x"].alias("px"), p["y"].alias("py"), qx.alias("qx"), qy.alias("qy"))


def reach(p, sides: Column) -> Column:
    """Distance from ``p`` to the nearest side."""
    def one(e):
        dx, dy, px, py = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"], p["x"] - e["a"]["x"], p["y"] - e["a"]["y"]
        n = dx * dx + dy * dy
        return G.let(F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / n))),
                     lambda t: F.hypot(px - t * dx, py - t * dy))
    return F.array_min(F.transform(sides, one))


def nearest(p, sides: Column) -> Column:
    return F.array_min(F.transform(sides, lambda e: foot(p, e)))


def holds_point(geom: Column, p) -> Column:
    """Point inside a geometry, holes respected."""
    return F.exists(geom, lambda part: F.size(F.filter(part, lambda r: G._inside_ring(p, r))) % 2 == 1)


def connect(a: Column, b: Column) -> Column:
    """Shortest segment between two geometries: STRUCT<d, ax, ay, bx, by>; d is 0 when they meet."""
    def of(ea, eb):
        there = F.transform(G.vertices(a), lambda p: nearest(p, eb))
        back = F.transform(F.transform(G.vertices(b), lambda p: nearest(p, ea)), lambda s: F.struct(
            s["d"].alias("d"), s["qx"].alias("px"), s["qy"].alias("py"), s["px"].alias("qx"), s["py"].alias("qy")))
        first_a, first_b = F.get(G.vertices(a), F.lit(0)), F.get(G.vertices(b), F.lit(0))
        crossing = F.exists(ea, lambda e: F.exists(eb, lambda f: G._meet(e["a"], e["b"], f["a"], f["b"])))
        meets = crossing | holds_point(b, first_a) | holds_point(a, first_b)
        return G.let(F.array_min(F.concat(there, back)), lambda s: F.struct(
            F.when(meets, F.lit(0.0)).otherwise(s["d"]).alias("d"), s["px"].alias("ax"), s["py"].alias("ay"), s["qx"].alias("bx"), s["qy"].alias("by")))

    return G.let(edges(a), lambda ea: G.let(edges(b), lambda eb: of(ea, eb)))


def vertex_gap(a: Column, b: Column) -> Column:
    """Largest distance from a vertex of one geometry to the boundary of the other, both ways."""
    def one(p, q):
        return G.let(edges(q), lambda sides: F.array_max(F.transform(G.vertices(p), lambda v: reach(v, sides))))
    return F.greatest(one(a, b), one(b, a))


def densified(geom: Column, step: float) -> Column:
    """Points along every side, at most ``step`` apart."""
    def side(e):
        n = F.greatest(F.lit(1), F.ceil(F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]) / step)).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda i: G.point(
            e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * i / n, e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * i / n))
    return F.flatten(F.transform(edges(geom), side))


def boundary_gap(a: Column, b: Column, step: float = 1.0) -> Column:
    """Hausdorff distance of two boundaries sampled every ``step``."""
    def one(p, q):
        return G.let(edges(q), lambda sides: F.array_max(F.transform(densified(p, step), lambda v: reach(v, sides))))
    return F.greatest(one(a, b), one(b, a))


def segment_in_piece(p, ax, ay, bx, by) -> Column:
    """STRUCT<length, touches> of a segment inside a trapezoid, by clipping the parameter range."""
    dx, dy = bx - ax, by - ay
    sl, sr = (p["xl1"] - p["xl0"]) / (p["y1"] - p["y0"]), (p["xr1"] - p["xr0"]) / (p["y1"] - p["y0"])
    # each side as value(t) = c + t * s >= 0 inside
    planes = [(ay - p["y0"], dy), (p["y1"] - ay, -dy),
              (ax - p["xl0"] - sl * (ay - p["y0"]), dx - sl * dy), (p["xr0"] + sr * (ay - p["y0"]) - ax, sr * dy - dx)]
    lo, hi, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for c, s in planes:
        lo = F.greatest(lo, F.when(s > 0, -c / s).otherwise(F.lit(0.0)))
        hi = F.least(hi, F.when(s < 0, -c / s).otherwise(F.lit(1.0)))
        ok = ok & ((s != 0) | (c >= 0))
    return F.struct(F.when(ok, F.greatest(F.lit(0.0), hi - lo) * F.hypot(dx, dy)).otherwise(F.lit(0.0)).alias("length"), (ok & (lo <= hi)).alias("touches"))
