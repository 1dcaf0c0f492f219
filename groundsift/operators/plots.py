"""Trial plots: squares on a half-side lattice, three rotations, inside a gap and clear of exclusions.

Feasible squares are found tile by tile, exclusions beside the objects of a tile, and only so many of a
gap as its quota can reach.  Picking is greedy in lattice order, but by rounds: every gap takes its least feasible square at once, then
squares that overlap it leave.  A round is one grouped minimum and one join, so
a gap with millions of feasible squares never gathers in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.operators import freespace as FS
from groundsift.operators import slabs
from groundsift.operators.tiles import explode_tiles
from groundsift.session import cut, spread, unsent

ANGLES = (0, 30, 60)


def square_pieces(cx: Column, cy: Column, side: Column, degrees: Column) -> Column:
    """Trapezoids of a square turned by 0 <= degrees < 90 about its centre."""
    a, h = F.radians(degrees), side / 2
    c, s = h * F.cos(a), h * F.sin(a)
    low = (cx - c + s, cy - s - c)
    right = (cx + c + s, cy + s - c)
    top = (cx + c - s, cy + s + c)
    left = (cx - c - s, cy - s + c)

    def x_on(p, q, y):
        return p[0] + (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1])

    ya, yb = F.least(left[1], right[1]), F.greatest(left[1], right[1])
    right_first = right[1] <= left[1]

    def piece(y0, y1, l0, l1, r0, r1):
        return F.struct(*[v.cast("double").alias(n) for n, v in zip(G.PIECE, (y0, y1, l0, l1, r0, r1))])

    xl_a = F.when(right_first, x_on(low, left, ya)).otherwise(left[0])
    xr_a = F.when(right_first, right[0]).otherwise(x_on(low, right, ya))
    xl_b = F.when(right_first, left[0]).otherwise(x_on(left, top, yb))
    xr_b = F.when(right_first, x_on(right, top, yb)).otherwise(right[0])
    turned = F.array(piece(low[1], ya, low[0], xl_a, low[0], xr_a), piece(ya, yb, xl_a, xl_b, xr_a, xr_b),
                     piece(yb, top[1], xl_b, top[0], xr_b, top[0]))
    flat = F.array(piece(cy - h, cy + h, cx - h, cx - h, cx + h, cx + h))
    return F.when(degrees == 0, flat).otherwise(F.filter(turned, lambda p: p["y1"] > p["y0"]))


def _square_pieces(cx: np.ndarray, cy: np.ndarray, side: float, degrees: int) -> np.ndarray:
    """Trapezoids (squares, n, 6) of squares about many centres, as ``square_pieces`` makes them."""
    h = side / 2
    if degrees == 0:
        return np.stack([cy - h, cy + h, cx - h, cx - h, cx + h, cx + h], 1)[:, None]
    c, s = h * np.cos(np.radians(degrees)), h * np.sin(np.radians(degrees))
    low, right, top, left = (cx - c + s, cy - s - c), (cx + c + s, cy + s - c), (cx + c - s, cy + s + c), (cx - c - s, cy - s + c)
    ya, yb = np.minimum(left[1], right[1]), np.maximum(left[1], right[1])
    x_on = lambda p, q, y: p[0] + (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1])
    first = right[1] <= left[1]
    xl_a, xr_a = np.where(first, x_on(low, left, ya), left[0]), np.where(first, right[0], x_on(low, right, ya))
    xl_b, xr_b = np.where(first, left[0], x_on(left, top, yb)), np.where(first, x_on(right, top, yb), right[0])
    return np.stack([np.stack(p, 1) for p in ((low[1], ya, low[0], xl_a, low[0], xr_a), (ya, yb, xl_a, xl_b, xr_a, xr_b), (yb, top[1], xl_b, top[0], xr_b, top[0]))], 1)


def _piece_overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common areas of pieces (n, 6), pair by pair, by the rule of ``geometry.piece_overlap``."""
    ya, yb = np.maximum(a[:, 0], b[:, 0]), np.minimum(a[:, 1], b[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        lines = []
        for p in (a, b):
            for at in (2, 4):
                slope = (p[:, at + 1] - p[:, at]) / (p[:, 1] - p[:, 0])
                lines.append((p[:, at] - slope * p[:, 0], slope))
        la, ra, lb, rb = lines
        cross = np.stack([(q[0] - p[0]) / (p[1] - q[1]) for p, q in ((la, lb), (ra, rb), (la, rb), (lb, ra))], 1)
    inner = (cross > ya[:, None]) & (cross < yb[:, None])
    ys = np.sort(np.concatenate([ya[:, None], yb[:, None], np.where(inner, cross, ya[:, None])], 1), 1)
    x = lambda line: line[0][:, None] + line[1][:, None] * ys
    width = np.maximum(0, np.minimum(x(ra), x(rb)) - np.maximum(x(la), x(lb)))
    area = ((width[:, 1:] + width[:, :-1]) / 2 * np.diff(ys, axis=1)).sum(1)
    return np.where(yb > ya, area, 0.0)


def _excluded(cx: np.ndarray, cy: np.ndarray, side: float, degrees: int, pieces: np.ndarray, owner: np.ndarray, min_area: float = 0.01) -> np.ndarray:
    """Squares of which an exclusion, given by pieces (n, 6) and their owners, takes more than ``min_area``."""
    out = np.zeros(len(cx), bool)
    a = np.radians(degrees)
    reach = side / 2 * (np.cos(a) + np.sin(a))
    x0, x1 = np.minimum(pieces[:, 2], pieces[:, 3]), np.maximum(pieces[:, 4], pieces[:, 5])
    i, k = np.nonzero((cx[:, None] - reach < x1) & (cx[:, None] + reach > x0) & (cy[:, None] - reach < pieces[:, 1]) & (cy[:, None] + reach > pieces[:, 0]))
    if len(i):
        mine = _square_pieces(cx[i], cy[i], side, degrees)
        area = sum(_piece_overlaps(mine[:, n], pieces[k]) for n in range(mine.shape[1]))
        pair, at = np.unique(np.stack([i, owner[k]], 1), axis=0, return_inverse=True)
        out[pair[np.bincount(at.ravel(), area, len(pair)) > min_area, 0]] = True
    return out


def _lattice(p: pd.DataFrame, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lattice places (piece, row, column, x, y) whose centre lies in a piece."""
    def spans(first, last):
        n = np.maximum(last - first + 1, 0).astype(int)
        at = np.repeat(np.arange(len(n)), n)
        return at, first[at] + (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n))

    c = {name: p[name].to_numpy(float) for name in ("ox", "oy", *G.PIECE)}
    at, rows = spans(np.maximum(0, np.ceil((c["y0"] - c["oy"]) / step)), np.floor((c["y1"] - c["oy"]) / step))
    c = {name: v[at] for name, v in c.items()}
    cy = c["oy"] + rows * step
    u = (cy - c["y0"]) / (c["y1"] - c["y0"])
    lo, hi = c["xl0"] + u * (c["xl1"] - c["xl0"]), c["xr0"] + u * (c["xr1"] - c["xr0"])
    inside = np.nonzero((cy >= c["y0"]) & (cy < c["y1"]))[0]
    i, cols = spans(np.maximum(0, np.ceil((lo - c["ox"]) / step))[inside], np.floor((hi - c["ox"]) / step)[inside])
    i = inside[i]
    cx = c["ox"][i] + cols * step
    keep = (cx >= lo[i]) & (cx < hi[i])
    i, cols, cx = i[keep], cols[keep], cx[keep]
    return at[i], rows[i].astype(int), cols.astype(int), cx, cy[i]


#: squares of a lattice that one square overlaps, itself included: centres less than three steps off both ways, at each angle
BLOCKED = 25 * len(ANGLES)
#: centres of a gap that are looked at first
FIRST = 32


def _free_squares(side: float):
    """Lattice squares of one tile that no observed side cuts, no object holds and no exclusion takes.

    A gap's plots are its least squares that overlap none before.  Those before
    are fewer than its quota and overlap at most ``BLOCKED`` squares each, so of
    one tile no more than the first (quota - 1) * BLOCKED + 1 can be picked:
    centres are looked at in order until a gap has so many squares.
    """
    step, reach = side / 2, side / 2

    def run(key, objects: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        names = [f.split()[0] for f in SQUARES.split(", ")]
        banned, pieces = pieces[pieces["gap"].isna()], pieces[pieces["gap"].notna()]
        if not len(pieces) or not len(objects):
            return pd.DataFrame(columns=names)
        head = objects.iloc[0]
        wall = [float(head[c]) for c in ("wx0", "wy0", "wx1", "wy1")]
        x1, y1, x2, y2, _, flat = FS.edges_of(objects)
        ax, ay = np.concatenate([x1, flat[0]]), np.concatenate([y1, flat[2]])
        bx, by = np.concatenate([x2, flat[1]]), np.concatenate([y2, flat[2]])
        taken, owner = banned[list(G.PIECE)].to_numpy(float), np.unique(banned["id"].to_numpy(str), return_inverse=True)[1]

        def feasible(cx: np.ndarray, cy: np.ndarray) -> list[tuple[np.ndarray, int]]:
            # the inscribed circle must be clear before any rotation is tried
            edge = np.minimum.reduce([cx - wall[0], cy - wall[1], wall[2] - cx, wall[3] - cy])
            clear = edge
            if len(ax):
                clear = np.minimum(clear, slabs.segment_distance(cx[:, None], cy[:, None], ax, ay, bx, by).min(axis=1))
            keep = np.nonzero(clear >= reach - 1e-9)[0]
            cx, cy, edge = cx[keep], cy[keep], edge[keep]
            px, py, qx, qy = ax - cx[:, None], ay - cy[:, None], bx - cx[:, None], by - cy[:, None]
            out = []
            for angle in ANGLES:
                c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
                ok = edge >= reach * (abs(c) + abs(s)) - 1e-9
                if len(ax):  # sides in the square's own frame; one that enters the open square rules it out
                    ok &= ~slabs.enters_square(px * c + py * s, py * c - px * s, qx * c + qy * s, qy * c - qx * s, reach - 1e-9).any(axis=1)
                if len(taken):
                    ok &= ~_excluded(cx, cy, side, angle, taken, owner)
                out.append((keep[ok], angle))
            return out

        at, rows, cols, cx, cy = _lattice(pieces, step)
        gaps, gap = np.unique(pieces["gap"].to_numpy(str), return_inverse=True)
        quota = pieces["quota"].to_numpy(float, na_value=np.nan)
        need = np.full(len(gaps), np.inf)
        need[gap] = np.where(np.isnan(quota), np.inf, (quota - 1) * BLOCKED + 1)
        gap = gap[at]
        order = np.lexsort((cols, rows, gap))
        gap, rows, cols, cx, cy = (v[order] for v in (gap, rows, cols, cx, cy))
        start, stop = np.searchsorted(gap, np.arange(len(gaps))), np.searchsorted(gap, np.arange(len(gaps)), "right")
        most = max(1, slabs.TABLE // max(1, len(ax)))
        have, some, out = np.zeros(len(gaps)), FIRST, []
        while True:
            open_ = np.nonzero((start < stop) & (have < need))[0]
            if not len(open_):
                break
            ends = np.minimum(start + some, stop)
            look = np.concatenate([np.arange(start[g], ends[g]) for g in open_])
            start[open_] = ends[open_]
            for s in range(0, len(look), most):
                part = look[s : s + most]
                for ok, angle in feasible(cx[part], cy[part]):
                    i = part[ok]
                    have += np.bincount(gap[i], minlength=len(gaps))
                    out += [(int(key[0]), gaps[gap[n]], int(rows[n]), int(cols[n]), angle, float(cx[n]), float(cy[n])) for n in i]
            some *= 2
        return pd.DataFrame(out, columns=names)

    return run


SQUARES = "survey_id long, gap string, row long, col long, angle int, cx double, cy double"


def feasible_squares(pieces: DataFrame, gaps: DataFrame, windows: DataFrame, occupied: DataFrame,
                     exclusions: DataFrame, side: float, quotas: DataFrame | None = None) -> DataFrame:
    """Squares wholly inside their gap that no exclusion overlaps by more than 0.01 m².

    ``pieces``: rows of :func:`freespace.free_pieces`; ``gaps``: survey_id, gap and its box;
    ``occupied``: what was subtracted, with flat geometry; ``exclusions``: survey_id, id, piece columns.
    With ``quotas(survey_id, gap, quota)`` squares that no quota can reach are left out.
    """
    step = side / 2
    corner = gaps.select("survey_id", "gap", (F.col("x0") + step).alias("ox"), (F.col("y0") + step).alias("oy"))
    corner = corner.withColumn("quota", F.lit(None).cast("long")) if quotas is None else corner.join(quotas.select("survey_id", "gap", F.col("quota").cast("long")), ["survey_id", "gap"])
    columns = [*FS.SUBTILE, "gap", "id", *G.PIECE, "ox", "oy", "quota"]
    mine = cut(pieces.select(*FS.SUBTILE, "bx0", "by0", "bx1", "by1", "gap", *G.PIECE).join(corner, ["survey_id", "gap"]).withColumn("id", F.lit(None).cast("string")))
    # exclusions go to the tiles that squares about their centres can reach
    boxes = exclusions.withColumns({"x0": F.least("xl0", "xl1"), "x1": F.greatest("xr0", "xr1")}).withColumn("id", F.col("id").cast("string"))
    banned = explode_tiles(boxes, FS.TILE_M, side).withColumnsRenamed({"_tx": "tx", "_ty": "ty"})
    tiles = mine.select(*FS.SUBTILE, "bx0", "by0", "bx1", "by1").distinct()
    banned = (tiles.join(unsent(banned), ["survey_id", "tx", "ty"]).where((F.col("x0") < F.col("bx1") + side) & (F.col("x1") > F.col("bx0") - side) & (F.col("y0") < F.col("by1") + side) & (F.col("y1") > F.col("by0") - side))
              .withColumns({"gap": F.lit(None).cast("string"), "ox": F.lit(0.0), "oy": F.lit(0.0), "quota": F.lit(None).cast("long")}))
    objects = FS.tile_objects(windows, occupied, side).join(unsent(tiles.select(*FS.SUBTILE)), FS.SUBTILE, "left_semi")
    rows = mine.select(*columns).unionByName(banned.select(*columns))
    return spread(objects, *FS.SUBTILE).groupBy(*FS.SUBTILE).cogroup(spread(rows, *FS.SUBTILE).groupBy(*FS.SUBTILE)).applyInPandas(_free_squares(side), SQUARES)


def pick_plots(squares: DataFrame, side: float, quotas: DataFrame) -> DataFrame:
    """Up to its quota of mutually disjoint squares per gap, least (row, col, angle) first.

    ``quotas``: survey_id, gap, quota.  Goes on until no gap has both room in
    its quota and a square left.
    """
    left = cut(squares.join(quotas, ["survey_id", "gap"]))
    chosen: DataFrame | None = None
    order = ["row", "col", "angle"]
    turn = 0
    while True:
        best = (left.where(F.col("quota") > turn).groupBy("survey_id", "gap").agg(F.min(F.struct(*order, "cx", "cy")).alias("b"))
                .select("survey_id", "gap", *[F.col(f"b.{c}").alias(f"b_{c}") for c in [*order, "cx", "cy"]]))
        best = cut(best)
        pick = best.select("survey_id", "gap", F.lit(turn + 1).alias("turn"), F.col("b_cx").alias("cx"), F.col("b_cy").alias("cy"), F.col("b_angle").alias("angle"))
        chosen = pick if chosen is None else chosen.unionByName(pick)
        if best.isEmpty():
            return chosen
        turn += 1
        mine = square_pieces(F.col("cx"), F.col("cy"), F.lit(float(side)), F.col("angle"))
        theirs = square_pieces(F.col("b_cx"), F.col("b_cy"), F.lit(float(side)), F.col("b_angle"))
        hit = F.exists(mine, lambda p: F.exists(theirs, lambda q: G.piece_overlap(p, q) > 1e-9))
        near = (F.abs(F.col("cx") - F.col("b_cx")) < side * 1.5) & (F.abs(F.col("cy") - F.col("b_cy")) < side * 1.5)
        left = cut(left.where(F.col("quota") > turn).join(best, ["survey_id", "gap"]).where(~(near & hit)).select(*left.columns))
