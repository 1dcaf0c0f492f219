"""Ground left free inside survey windows once observed objects are subtracted.

Window and objects are cut into tiles; one task decomposes one tile, so its
work is bounded by the tile and not by the window.  Crowded tiles are cut
finer, and copies of one geometry collapse before the shuffle.  Free pieces
are stitched across tile borders by an interval join and named by connected
components; every per-gap figure is a sum, minimum or maximum over pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.operators import slabs
from groundsift.operators.components import connected_components
from groundsift.operators.knn import all_sides
from groundsift.operators.tiles import explode_tiles
from groundsift.session import cut, ship_package, spread, unsent

TILE_M = 500.0
#: objects one task takes in a tile before the tile is cut finer
CROWD = 400
#: a tile is never cut more than this many times in half
MAX_LEVEL = 6

FLAT = ("xs", "ys", "sizes")
PIECE_SCHEMA = ("survey_id long, tx long, ty long, lv int, sx int, sy int, bx0 double, by0 double, bx1 double, by1 double, "
                "piece int, comp int, y0 double, y1 double, xl0 double, xl1 double, xr0 double, xr1 double, wide boolean")


def flat_geometry(geom) -> list:
    """Columns xs, ys, sizes: coordinates and ring lengths, cheap to move through Arrow."""
    rings = F.flatten(geom)
    pts = F.flatten(rings)
    return [F.transform(pts, lambda p: p["x"]).alias("xs"), F.transform(pts, lambda p: p["y"]).alias("ys"),
            F.transform(rings, lambda r: F.size(r)).alias("sizes")]


def box_flat() -> list:
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return [F.array(x0, x1, x1, x0, x0).alias("xs"), F.array(y0, y0, y1, y1, y0).alias("ys"), F.array(F.lit(5)).alias("sizes")]


def window_tiles(windows: DataFrame, side: float = TILE_M) -> DataFrame:
    """Tiles of every window with the part of the window they hold; borders lie on the common grid."""
    t = explode_tiles(windows, side, box=("wx0", "wy0", "wx1", "wy1"))
    return (t.select("survey_id", "wx0", "wy0", "wx1", "wy1", F.col("_tx").alias("tx"), F.col("_ty").alias("ty"),
                     F.greatest("wx0", F.col("_tx") * side).alias("tx0"), F.greatest("wy0", F.col("_ty") * side).alias("ty0"),
                     F.least("wx1", (F.col("_tx") + 1) * side).alias("tx1"), F.least("wy1", (F.col("_ty") + 1) * side).alias("ty1"))
            .where("tx0 < tx1 AND ty0 < ty1"))


def _center_is_wide(pieces, x1, y1, x2, y2, horizontals, wall, radius):
    """Which pieces hold a point further than ``radius`` from every side; tests piece centres only."""
    if not pieces:
        return np.zeros(0, bool)
    p = np.array(pieces)
    cy = (p[:, 0] + p[:, 1]) / 2
    cx = (p[:, 2] + p[:, 3] + p[:, 4] + p[:, 5]) / 4
    ax = np.concatenate([x1, horizontals[0]])
    ay = np.concatenate([y1, horizontals[2]])
    bx = np.concatenate([x2, horizontals[1]])
    by = np.concatenate([y2, horizontals[2]])
    far = np.minimum.reduce([cx - wall[0], wall[2] - cx, cy - wall[1], wall[3] - cy]) > radius
    if len(ax):
        far &= slabs.segment_distance(cx[:, None], cy[:, None], ax, ay, bx, by).min(axis=1) > radius
    return far


def edges_of(pdf):
    xs, ys, hs, owners = [], [], [], []
    parts = [[], [], [], []]
    for i, (px, py, sizes) in enumerate(zip(pdf["xs"], pdf["ys"], pdf["sizes"])):
        if px is None or len(px) == 0:
            continue
        e = slabs.ring_edges(px, py, sizes)
        for k in range(4):
            parts[k].append(e[k])
        owners.append(np.full(len(e[0]), i))
        px, py = np.asarray(px, float), np.asarray(py, float)
        flat = np.nonzero(py[:-1] == py[1:])[0]
        ends = set((np.cumsum(np.asarray(sizes, int)) - 1).tolist())
        flat = np.array([j for j in flat.tolist() if j not in ends], int)
        hs.append(np.stack([np.minimum(px[flat], px[flat + 1]), np.maximum(px[flat], px[flat + 1]), py[flat]]))
    if not owners:
        z = np.empty(0)
        return z, z, z, z, np.empty(0, int), np.empty((3, 0))
    return (*[np.concatenate(p) for p in parts], np.concatenate(owners), np.concatenate(hs, axis=1))


def signs_of(pdf):
    """Directions of the sides that ``edges_of`` gives."""
    out = [slabs.ring_signs(ys, sizes) for ys, sizes in zip(pdf["ys"], pdf["sizes"]) if ys is not None and len(ys)]
    return np.concatenate(out) if out else np.empty(0, int)


def _free_in_tile(radius: float, winding: bool):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        survey, tx, ty, lv, sx, sy = key
        head = pdf.iloc[0]
        bx0, by0, bx1, by1 = (float(head[c]) for c in ("bx0", "by0", "bx1", "by1"))
        x1, y1, x2, y2, owner, flat = edges_of(pdf)
        near = (y2 > by0) & (y1 < by1)
        # sides right of the tile cannot bound free ground in it, but parity needs those on the left
        sign = signs_of(pdf)[near] if winding else None
        pieces, links = slabs.free(x1[near], y1[near], x2[near], y2[near], owner[near], bx0, by0, bx1, by1, sign)
        comp = slabs.components(len(pieces), links)
        wall = tuple(float(head[c]) for c in ("wx0", "wy0", "wx1", "wy1"))
        wide = _center_is_wide(pieces, x1, y1, x2, y2, flat, wall, radius)
        rows = [(survey, tx, ty, lv, sx, sy, bx0, by0, bx1, by1, i, c, *p, bool(w))
                for i, (p, c, w) in enumerate(zip(pieces, comp, wide))]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in PIECE_SCHEMA.split(", ")])

    return run


def tile_objects(windows: DataFrame, occupied: DataFrame, halo: float, side: float = TILE_M, copies: bool = True) -> DataFrame:
    """Objects by (survey, tile, sub-tile), each window tile present at least once.

    ``occupied``: survey_id, box columns and flat geometry.  A tile with more
    than ``CROWD`` objects is cut in halves both ways often enough; the list of
    such tiles cannot exceed rows / CROWD and is joined by key, not broadcast.
    Without ``copies`` no geometry comes twice, and none is compared.
    """
    tiles = window_tiles(windows, side)
    objects = explode_tiles(occupied.dropDuplicates(["survey_id", *FLAT]) if copies else occupied, side, halo).select(
        "survey_id", F.col("_tx").alias("tx"), F.col("_ty").alias("ty"), "x0", "y0", "x1", "y1", *FLAT)
    levels = (objects.groupBy("survey_id", "tx", "ty").agg(F.count("*").alias("_n"))
              .select("survey_id", "tx", "ty", F.least(F.lit(MAX_LEVEL), F.greatest(F.lit(0), F.ceil(F.log2(
                  F.col("_n") / F.lit(float(CROWD))) / 2))).cast("int").alias("lv")))
    grid = (tiles.join(levels, ["survey_id", "tx", "ty"], "left").withColumn("lv", F.coalesce("lv", F.lit(0)))
            .withColumn("_m", F.pow(F.lit(2.0), F.col("lv")).cast("int"))
            .withColumn("sx", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
            .withColumn("sy", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
            .withColumn("bx0", F.greatest("tx0", (F.col("tx") + F.col("sx") / F.col("_m")) * side))
            .withColumn("by0", F.greatest("ty0", (F.col("ty") + F.col("sy") / F.col("_m")) * side))
            .withColumn("bx1", F.least("tx1", (F.col("tx") + (F.col("sx") + 1) / F.col("_m")) * side))
            .withColumn("by1", F.least("ty1", (F.col("ty") + (F.col("sy") + 1) / F.col("_m")) * side))
            .where("bx0 < bx1 AND by0 < by1")
            .select("survey_id", "tx", "ty", "lv", "sx", "sy", "bx0", "by0", "bx1", "by1", "wx0", "wy0", "wx1", "wy1"))
    h = F.lit(float(halo))
    objects = objects.withColumnsRenamed({c: f"o_{c}" for c in ("x0", "y0", "x1", "y1")})
    g, o = grid.alias("g"), objects.alias("o")
    near = ((F.col("g.survey_id") == F.col("o.survey_id")) & (F.col("g.tx") == F.col("o.tx")) & (F.col("g.ty") == F.col("o.ty"))
            & (F.col("o_x0") < F.col("bx1") + h) & (F.col("o_x1") > F.col("bx0") - h)
            & (F.col("o_y0") < F.col("by1") + h) & (F.col("o_y1") > F.col("by0") - h))
    return g.join(unsent(o), near, "left").select("g.*", *FLAT)


SUBTILE = ["survey_id", "tx", "ty", "lv", "sx", "sy"]


def free_pieces(windows: DataFrame, occupied: DataFrame, min_width: float = 0.0, side: float = TILE_M, winding: bool = False) -> DataFrame:
    """Free trapezoids with the gap they belong to (column ``gap``).

    ``windows``: survey_id, wx0..wy1; ``occupied``: survey_id, box, flat geometry.
    With ``winding`` the geometries are offset curves, which cover what they wind around.
    """
    radius = min_width / 2
    per_tile = tile_objects(windows, occupied, radius, side, copies=not winding)  # copies of curves wind around the same ground
    raw = cut(spread(per_tile, *SUBTILE).groupBy(*SUBTILE).applyInPandas(_free_in_tile(radius, winding), PIECE_SCHEMA)
              .withColumn("node", F.concat_ws("/", *SUBTILE, "comp")))
    edges = border_links(raw)
    comps = connected_components(raw.select("node"), edges).withColumnRenamed("component", "gap")
    return raw.join(unsent(comps), "node")


def border_links(pieces: DataFrame) -> DataFrame:
    """Pairs of tile components that share a stretch of tile border."""
    def side(which, line, lo, hi, on):
        return pieces.where(on).select("survey_id", F.lit(which[0]).alias("axis"), line.alias("line"),
                                       F.lit(which[1]).alias("face"), lo.alias("lo"), hi.alias("hi"), "node")

    c = F.col
    faces = (side("x-", c("bx1"), c("y0"), c("y1"), (c("xr0") == c("bx1")) & (c("xr1") == c("bx1")))
             .unionByName(side("x+", c("bx0"), c("y0"), c("y1"), (c("xl0") == c("bx0")) & (c("xl1") == c("bx0"))))
             .unionByName(side("y-", c("by1"), c("xl1"), c("xr1"), c("y1") == c("by1")))
             .unionByName(side("y+", c("by0"), c("xl0"), c("xr0"), c("y0") == c("by0"))))
    # borders are cut into short cells so that a long border is not one join key
    cell = 64.0
    faces = faces.withColumn("cell", F.explode(F.sequence(F.floor(c("lo") / cell), F.floor(c("hi") / cell))))
    a = faces.where("face = '-'").select("survey_id", "axis", "line", "cell", "lo", "hi", c("node").alias("a"))
    b = faces.where("face = '+'").select("survey_id", "axis", "line", "cell", c("lo").alias("lo2"), c("hi").alias("hi2"), c("node").alias("b"))
    return (a.join(unsent(b), ["survey_id", "axis", "line", "cell"])
            .where(F.least("hi", "hi2") - F.greatest("lo", "lo2") > slabs.SLIVER).select("a", "b").distinct())


def gap_figures(pieces: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per gap: area, centroid, lowest-left anchor, contact with the window edge, width flag."""
    h = F.col("y1") - F.col("y0")
    a, b = F.col("xr0") - F.col("xl0"), F.col("xr1") - F.col("xl1")
    area = (a + b) / 2 * h
    # moments of a trapezoid between two sides linear in y
    mx = h * ((F.col("xr0") ** 2 + F.col("xr0") * F.col("xr1") + F.col("xr1") ** 2)
              - (F.col("xl0") ** 2 + F.col("xl0") * F.col("xl1") + F.col("xl1") ** 2)) / 6
    my = area * F.col("y0") + h * h * (a + 2 * b) / 6
    w = windows.select("survey_id", "wx0", "wy0", "wx1", "wy1")
    edge = ((F.least("xl0", "xl1") - F.col("wx0") < 0.1) | (F.col("wx1") - F.greatest("xr0", "xr1") < 0.1)
            | (F.col("y0") - F.col("wy0") < 0.1) | (F.col("wy1") - F.col("y1") < 0.1))
    return (pieces.join(w, "survey_id").groupBy("survey_id", "gap")
            .agg(F.sum(area).alias("area"), (F.sum(mx) / F.sum(area)).alias("cx"), (F.sum(my) / F.sum(area)).alias("cy"),
                 F.min(F.struct("y0", "xl0", "xl1", "xr1")).alias("anchor"), F.max(edge).alias("touches_boundary"),
                 F.max("wide").alias("wide"), F.count("*").alias("pieces"),
                 F.min(F.least("xl0", "xl1")).alias("x0"), F.min("y0").alias("y0"),
                 F.max(F.greatest("xr0", "xr1")).alias("x1"), F.max("y1").alias("y1"))
            .withColumn("gap_id", F.concat(F.lit("gap-"), F.substring(F.sha2(F.to_json(F.struct("survey_id", "anchor")), 256), 1, 16))))


def _circle_points(ax, ay, bx, by, r):
    """Meeting points of offset sides and offset end points, pairwise and near enough to meet."""
    n = len(ax)
    ends_x, ends_y = np.concatenate([ax, bx]), np.concatenate([ay, by])
    ends = np.unique(np.stack([ends_x, ends_y], 1), axis=0)
    dx, dy = bx - ax, by - ay
    length = np.hypot(dx, dy)
    nx, ny = -dy / length, dx / length
    # both parallels of every side
    lx0 = np.concatenate([ax + nx * r, ax - nx * r])
    ly0 = np.concatenate([ay + ny * r, ay - ny * r])
    ldx, ldy = np.concatenate([dx, dx]), np.concatenate([dy, dy])
    out = []
    den = ldx[:, None] * ldy[None, :] - ldy[:, None] * ldx[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((lx0[None, :] - lx0[:, None]) * ldy[None, :] - (ly0[None, :] - ly0[:, None]) * ldx[None, :]) / den
        u = ((lx0[None, :] - lx0[:, None]) * ldy[:, None] - (ly0[None, :] - ly0[:, None]) * ldx[:, None]) / den
        ok = (np.abs(den) > 1e-12) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    i, j = np.nonzero(np.triu(ok, 1))
    out.append(np.stack([lx0[i] + t[i, j] * ldx[i], ly0[i] + t[i, j] * ldy[i]], 1))
    # parallel against circle around an end point
    llen = np.concatenate([length, length])
    ux, uy = ldx / llen, ldy / llen
    px, py = ends[:, 0][None, :] - lx0[:, None], ends[:, 1][None, :] - ly0[:, None]
    along, off = px * ux[:, None] + py * uy[:, None], px * uy[:, None] - py * ux[:, None]
    half = np.sqrt(np.maximum(r * r - off * off, 0))
    for sign in (-1, 1):
        s = along + sign * half
        i, j = np.nonzero((np.abs(off) <= r) & (s >= 0) & (s <= llen[:, None]))
        out.append(np.stack([lx0[i] + s[i, j] * ux[i], ly0[i] + s[i, j] * uy[i]], 1))
    # circle against circle
    qx, qy = ends[:, 0], ends[:, 1]
    ddx, ddy = qx[None, :] - qx[:, None], qy[None, :] - qy[:, None]
    d = np.hypot(ddx, ddy)
    i, j = np.nonzero(np.triu((d > 0) & (d <= 2 * r), 1))
    if len(i):
        dd = d[i, j]
        h = np.sqrt(np.maximum(r * r - dd * dd / 4, 0))
        mx, my = (qx[i] + qx[j]) / 2, (qy[i] + qy[j]) / 2
        for sign in (-1, 1):
            out.append(np.stack([mx - sign * h * ddy[i, j] / dd, my + sign * h * ddx[i, j] / dd], 1))
    return np.concatenate(out) if out else np.empty((0, 2))


def _exact_width(radius: float):
    """Decide pieces of still undecided gaps: is some point of them further than radius from every side?"""
    r = radius * (1 + 1e-9) + 1e-9

    def run(key, objects: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"survey_id": pd.Series(dtype="int64"), "gap": pd.Series(dtype="object")})
        if not len(pieces) or not len(objects):
            return empty
        head = objects.iloc[0]
        wx0, wy0, wx1, wy1 = (float(head[c]) for c in ("wx0", "wy0", "wx1", "wy1"))
        x1, y1, x2, y2, _, flat = edges_of(objects)
        ax = np.concatenate([x1, flat[0], [wx0, wx0, wx0, wx1]])
        ay = np.concatenate([y1, flat[2], [wy0, wy0, wy1, wy0]])
        bx = np.concatenate([x2, flat[1], [wx1, wx0, wx1, wx1]])
        by = np.concatenate([y2, flat[2], [wy0, wy1, wy1, wy1]])
        seg = np.unique(np.stack([ax, ay, bx, by], 1), axis=0)
        hits = []
        for gap, group in pieces.groupby("gap"):
            for _, p in group.iterrows():
                gx0, gx1 = min(p.xl0, p.xl1), max(p.xr0, p.xr1)
                s = seg[(np.maximum(seg[:, 0], seg[:, 2]) >= gx0 - 2 * r) & (np.minimum(seg[:, 0], seg[:, 2]) <= gx1 + 2 * r)
                        & (np.maximum(seg[:, 1], seg[:, 3]) >= p.y0 - 2 * r) & (np.minimum(seg[:, 1], seg[:, 3]) <= p.y1 + 2 * r)]
                c = _circle_points(s[:, 0], s[:, 1], s[:, 2], s[:, 3], r)
                c = c[(c[:, 1] >= p.y0) & (c[:, 1] <= p.y1)]
                t = (c[:, 1] - p.y0) / (p.y1 - p.y0)
                c = c[(c[:, 0] >= p.xl0 + t * (p.xl1 - p.xl0)) & (c[:, 0] <= p.xr0 + t * (p.xr1 - p.xr0))]
                if len(c) and (slabs.segment_distance(c[:, :1], c[:, 1:], s[:, 0], s[:, 1], s[:, 2], s[:, 3]).min(axis=1) >= radius).any():
                    hits.append((int(key[0]), gap))
                    break
        return pd.DataFrame(hits, columns=["survey_id", "gap"]) if hits else empty

    return run


def settle_width(pieces: DataFrame, figures: DataFrame, windows: DataFrame, occupied: DataFrame,
                 min_width: float, side: float = TILE_M) -> DataFrame:
    """``figures`` with ``wide`` exact: true when erosion by half of ``min_width`` leaves something.

    Piece centres settle most gaps; only tiles of the rest are looked at again.
    """
    if min_width <= 0:
        return figures.withColumn("wide", F.lit(True))
    radius = min_width / 2
    figures = cut(figures)  # read three times below
    open_gaps = figures.where(~F.col("wide")).select("survey_id", "gap")
    open_pieces = pieces.join(open_gaps, ["survey_id", "gap"], "left_semi").select(*SUBTILE, "gap", *G.PIECE)
    tiles = open_pieces.select(*SUBTILE).distinct()
    objects = tile_objects(windows, occupied, 2 * min_width, side).join(tiles, SUBTILE, "left_semi")
    found = (spread(objects, *SUBTILE).groupBy(*SUBTILE).cogroup(spread(open_pieces, *SUBTILE).groupBy(*SUBTILE))
             .applyInPandas(_exact_width(radius), "survey_id long, gap string").distinct().withColumn("_w", F.lit(True)))
    return (figures.join(found, ["survey_id", "gap"], "left")
            .withColumn("wide", F.col("wide") | F.coalesce("_w", F.lit(False))).drop("_w"))


#: sides that are worked out at once
SIDES = 1 << 15


def _covers(xs: pa.Array, ys: pa.Array, sizes: pa.Array, winding: bool):
    """Rows and trapezoids (n, 6) of the polygons of a batch, a number of sides at a time."""
    sides, first, count = all_sides(xs, ys, sizes)
    row = np.repeat(np.arange(len(count)), count)
    x1, y1, x2, y2 = sides.T
    rises, use = y2 > y1, y1 != y2
    low = np.where(rises, x1, x2), np.minimum(y1, y2), np.where(rises, x2, x1), np.maximum(y1, y2)
    sign = np.where(rises, -1, 1)
    at = 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(first + count, first[at] + SIDES, "right")))
        part = np.flatnonzero(use[first[at] : first[end - 1] + count[end - 1]]) + first[at]
        yield slabs.cover_many(*(v[part] for v in low), row[part], sign[part] if winding else None)
        at = end


def covered_pieces(objects: DataFrame, keys: Sequence[str], winding: bool = False) -> DataFrame:
    """Pieces of single polygons, one object per row in, many pieces out; runs batch by batch.

    With ``winding`` a geometry is a set of offset curves.
    """
    ship_package(objects.sparkSession)

    def decompose(xs: pa.Array, ys: pa.Array, sizes: pa.Array) -> pa.Array:
        rows, pieces = map(np.concatenate, zip((np.zeros(0, int), np.zeros((0, 6))), *_covers(xs, ys, sizes, winding)))
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(xs)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in pieces.T], list(G.PIECE)))

    pieces = F.arrow_udf(decompose, f"array<{G.PIECE_T}>")
    return (objects.select(*keys, F.explode(pieces(*FLAT)).alias("p")).select(*keys, "p.*"))


def covered_area(winding: bool = False):
    """Column function of a flat geometry: the ground it covers, 0 where it is empty; no piece leaves its row."""
    def measure(xs: pa.Array, ys: pa.Array, sizes: pa.Array) -> pa.Array:
        out = np.zeros(len(xs))
        for rows, p in _covers(xs, ys, sizes, winding):
            out += np.bincount(rows, ((p[:, 4] - p[:, 2]) + (p[:, 5] - p[:, 3])) / 2 * (p[:, 1] - p[:, 0]), len(xs))
        return pa.array(out)

    return F.arrow_udf(measure, "double")


def union_area(objects: DataFrame, group: Sequence[str], side: float = TILE_M) -> DataFrame:
    """Area of the union of all objects of a group, tile by tile; copies collapse first."""
    t = explode_tiles(objects.dropDuplicates([*group, *FLAT]), side)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = float(key[-2]) * side, float(key[-1]) * side
        x1, y1, x2, y2, owner, _ = edges_of(pdf)
        near = (y2 > ty) & (y1 < ty + side)
        pieces, _ = slabs.free(x1[near], y1[near], x2[near], y2[near], owner[near], tx, ty, tx + side, ty + side)
        left = sum(((p[4] - p[2]) + (p[5] - p[3])) / 2 * (p[1] - p[0]) for p in pieces)
        return pd.DataFrame([(*key, side * side - left)], columns=[*group, "_tx", "_ty", "area"])

    schema = ", ".join(f"{g} {dict(objects.dtypes)[g]}" for g in group) + ", _tx long, _ty long, area double"
    return (spread(t.select(*group, "_tx", "_ty", *FLAT), *group, "_tx", "_ty").groupBy(*group, "_tx", "_ty").applyInPandas(run, schema)
            .groupBy(*group).agg(F.sum("area").alias("union_area_m2")))


def grown_polygons(shapes: DataFrame, clearance: float, join: str = "round", arc: int = 16) -> DataFrame:
    """``shapes(survey_id, geom)`` as offset curves with their box, for ``free_pieces(..., winding=True)``.

    The sides of a grown polygon go to the tiles they reach; a closing hole, a
    concave corner or parts that grow together need no pass of their own.
    """
    # copies go while they are small, and small files are dealt out before curves are made
    shapes = spread(shapes.select("survey_id", "geom"), "survey_id", "geom").dropDuplicates(["survey_id", "geom"])
    curves = shapes.select("survey_id", G.bounds(F.col("geom")).alias("b"), *flat_geometry(F.col("geom")), shells(F.col("geom")).alias("shells"))
    curves = curves.withColumn("g", grown_curves(clearance, join, arc)(*FLAT, "shells"))
    return curves.select("survey_id", *[(F.col(f"b.{c}") + (clearance if c in ("x1", "y1") else -clearance)).alias(c) for c in ("x0", "y0", "x1", "y1")], *[f"g.{c}" for c in FLAT])


def shells(geom):
    """Which rings of the flat geometry are shells."""
    return F.flatten(F.transform(geom, lambda part: F.transform(part, lambda ring, i: i == 0)))


def grown_curves(distance: float, join: str = "round", arc: int = 16):
    """Column function of a flat geometry and its shells: ``geometry.grown`` of a whole batch, flat again."""
    def grow(xs: pa.Array, ys: pa.Array, sizes: pa.Array, shell: pa.Array) -> pa.Array:
        x, y = (np.asarray(c.flatten(), float) for c in (xs, ys))
        size, rings = np.asarray(sizes.flatten(), int), np.asarray(sizes.value_lengths().fill_null(0), int)
        px, py, per_ring = _curves(x, y, size, np.asarray(shell.flatten(), bool), distance, join, arc)
        ring_ends = np.concatenate([[0], np.cumsum(rings)])
        ends = pa.array(np.concatenate([[0], np.cumsum(per_ring)])[ring_ends], pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(px)), pa.ListArray.from_arrays(ends, pa.array(py)),
                                           pa.ListArray.from_arrays(pa.array(ring_ends, pa.int32()), pa.array(per_ring, pa.int32()))], list(FLAT))

    return F.arrow_udf(grow, "struct<xs:array<double>,ys:array<double>,sizes:array<int>>")


def _curves(x: np.ndarray, y: np.ndarray, size: np.ndarray, shell: np.ndarray, distance: float, join: str, arc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offset curves of closed rings that follow each other; points of each curve, none for rings of fewer than three corners."""
    first = np.cumsum(size) - size
    ring = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(x)) - first[ring]
    on = np.flatnonzero(place < size[ring] - 1)
    dx, dy, ex, ey = x[on] - x[first[ring[on]]], y[on] - y[first[ring[on]]], x[on + 1] - x[first[ring[on]]], y[on + 1] - y[first[ring[on]]]
    back = (np.bincount(ring[on], dx * ey - ex * dy, len(size)) < 0) == shell
    corner = on[(place[on] == 0) | (x[on] != x[on - 1]) | (y[on] != y[on - 1])]
    n = np.bincount(ring[corner], minlength=len(size))
    corner, of = corner[n[ring[corner]] > 2], ring[corner][n[ring[corner]] > 2]
    n = np.where(n > 2, n, 0)
    head = np.cumsum(n) - n
    j = np.arange(len(corner)) - head[of]
    around = lambda k: corner[head[of] + np.where(back[of], n[of] - 1 - k % n[of], k % n[of])]
    p, a, b = around(j), around(j - 1), around(j + 1)
    start, stop = np.arctan2(x[a] - x[p], y[p] - y[a]), np.arctan2(x[p] - x[b], y[b] - y[p])
    turn = np.mod(stop - start + np.pi, 2 * np.pi) - np.pi  # left turns are convex for the ground on the left
    convex = turn >= -1e-12
    steps = np.maximum(np.ceil(turn * (2 * arc / np.pi) - 1e-9), 0) if join == "round" else np.zeros(len(p))
    count = np.where(convex, steps + 1, 3).astype(int)
    at = np.repeat(np.arange(len(p)), count)
    s = np.arange(len(at)) - (np.cumsum(count) - count)[at]
    angle, reach = start[at] + turn[at] * s / np.maximum(steps[at], 1), np.full(len(at), float(distance))
    if join == "mitre":
        angle, reach = start[at] + turn[at] / 2, distance / np.cos(turn[at] / 2)
    hollow = ~convex[at]  # the curve goes back to the vertex
    angle = np.where(hollow, np.where(s == 0, start[at], stop[at]), angle)
    reach = np.where(hollow, np.where(s == 1, 0.0, distance), reach)
    px, py = x[p[at]] + reach * np.cos(angle), y[p[at]] + reach * np.sin(angle)
    many = np.bincount(of[at], minlength=len(size))
    ends = np.cumsum(many)[many > 0]  # closed by the first point
    heads = ends - many[many > 0]
    return np.insert(px, ends, px[heads]), np.insert(py, ends, py[heads]), many + (many > 0)
