"""Agreement of two outlines of any number of parts: gaps, shared area, parts that belong together.

Gaps are directed both ways: over vertices, and over points no further than a
step apart on every side.  A point's distance to the other outline is bounded
from above by boxes of sides; points are measured in falling order of that
bound, and measuring stops once no bound exceeds the largest distance found.

Parts can only fit where their boxes do, corner by corner, so they meet in a
join on the cell of a corner.  A match is proved when every part of either
side has exactly one fit and both sides have as many parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.operators import freespace as FS
from groundsift.operators.knn import PACK, _feet, all_sides
from groundsift.session import ship_package, spread, unsent

BATCH = 64


def _points(sides: np.ndarray, step: float) -> np.ndarray:
    """Points of each side, no more than ``step`` apart, its ends included."""
    return 1 + np.maximum(1, np.ceil(np.hypot(sides[:, 2] - sides[:, 0], sides[:, 3] - sides[:, 1]) / step - 1e-9)).astype(int)


def densified(sides: np.ndarray, step: float) -> np.ndarray:
    """Points of all sides (n, 4), no more than ``step`` apart, their ends included."""
    n = _points(sides, step) - 1
    side = np.repeat(np.arange(len(sides)), n + 1)
    t = (np.arange(len(side)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)) / n[side]
    return sides[side, :2] + t[:, None] * (sides[side, 2:] - sides[side, :2])


def directed_gap(points: np.ndarray, sides: np.ndarray) -> float:
    """Largest distance from a point (n, 2) to the nearest side (m, 4)."""
    boxes = np.array([[*np.minimum(p[:, :2], p[:, 2:]).min(0), *np.maximum(p[:, :2], p[:, 2:]).max(0)] for p in (sides[i : i + PACK] for i in range(0, len(sides), PACK))])
    far = np.full(len(points), np.inf)
    for b in boxes:  # some side of a box is no further off than its far corner
        far = np.minimum(far, np.hypot(np.maximum(np.abs(points[:, 0] - b[0]), np.abs(points[:, 0] - b[2])), np.maximum(np.abs(points[:, 1] - b[1]), np.abs(points[:, 1] - b[3]))))
    order, found = np.argsort(-far, kind="stable"), 0.0
    for s in range(0, len(order), BATCH):
        at = order[s : s + BATCH]
        if far[at[0]] <= found:
            break
        found = max(found, float(_feet(points[None, at], sides[None])[0].min(2).max()))
    return found


#: points by sides that are measured at once; a pair with more is measured by itself, in order of its bounds
CELLS = 1 << 19


def directed_gaps(points: np.ndarray, p_at: np.ndarray, n: np.ndarray, sides: np.ndarray, s_at: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``directed_gap`` of many pairs, which have ``n`` points from ``p_at`` on and ``m`` sides from ``s_at`` on."""
    out, cells = np.full(len(n), np.nan), n * m
    for i in np.flatnonzero(cells > CELLS):
        out[i] = directed_gap(points[p_at[i] : p_at[i] + n[i]], sides[s_at[i] : s_at[i] + m[i]])
    rest = np.flatnonzero((cells > 0) & (cells <= CELLS))
    total, start = np.cumsum(cells[rest]), 0
    while start < len(rest):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + CELLS, "right")))
        i, start = rest[start:stop], stop
        pair = np.repeat(np.arange(len(i)), n[i])
        point = p_at[i][pair] + np.arange(len(pair)) - (np.cumsum(n[i]) - n[i])[pair]
        width = m[i][pair]
        head = np.cumsum(width) - width
        k = np.repeat(s_at[i][pair] - head, width) + np.arange(width.sum())
        px, py = np.repeat(points[point, 0], width), np.repeat(points[point, 1], width)
        ax, ay = sides[k, 0], sides[k, 1]
        dx, dy = sides[k, 2] - ax, sides[k, 3] - ay
        length = dx * dx + dy * dy
        t = np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(length == 0, 1, length), 0, 1)
        near = np.minimum.reduceat(np.hypot(px - (ax + t * dx), py - (ay + t * dy)), head)
        out[i] = np.maximum.reduceat(near, np.cumsum(n[i]) - n[i])
    return out


def _gaps(step: float):
    def measure(*columns: pa.Array) -> pa.Array:
        (a, a_at, n), (b, b_at, m) = all_sides(*columns[:3]), all_sides(*columns[3:])

        def dense(sides, count):
            many = np.bincount(np.repeat(np.arange(len(count)), count), _points(sides, step), len(count)).astype(int)
            return densified(sides, step), np.cumsum(many) - many, many

        vertex = np.maximum(directed_gaps(a[:, :2], a_at, n, b, b_at, m), directed_gaps(b[:, :2], b_at, m, a, a_at, n))
        boundary = np.maximum(directed_gaps(*dense(a, n), b, b_at, m), directed_gaps(*dense(b, m), a, a_at, n))
        return pa.StructArray.from_arrays([pa.array(vertex), pa.array(boundary)], ["vertex", "boundary"])

    return F.arrow_udf(measure, "struct<vertex:double,boundary:double>")


def _flat(geom, tag: str) -> list:
    points = F.flatten(F.flatten(geom))
    return [F.transform(points, lambda p: p["x"]).alias(f"xs_{tag}"), F.transform(points, lambda p: p["y"]).alias(f"ys_{tag}"), F.transform(F.flatten(geom), lambda r: F.size(r)).alias(f"sizes_{tag}")]


_COLUMNS = [f"{c}_{t}" for t in "ab" for c in ("xs", "ys", "sizes")]


def part_fits(pairs: DataFrame, tolerance: float, area_share: float = 0.01) -> DataFrame:
    """``pairs(id, a, b)`` to ``(id, i, j)``: parts of both that fit within the tolerance, vertex by vertex and in area; places from 1."""
    ship_package(pairs.sparkSession)

    def parts(name, tag):
        p = pairs.select("id", F.posexplode(name).alias("n", "part")).select("id", (F.col("n") + 1).alias("ij"[tag == "b"]), F.array("part").alias(f"g_{tag}"))
        return p.withColumn(f"box_{tag}", G.bounds(F.col(f"g_{tag}")))

    cell = lambda c: F.floor(c / tolerance).cast("bigint")
    around = F.sequence(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint"))
    a = parts("a", "a").withColumn("cx", cell(F.col("box_a.x0"))).withColumn("cy", cell(F.col("box_a.y0")))
    b = parts("b", "b").withColumn("cx", F.explode(F.transform(around, lambda d: cell(F.col("box_b.x0")) + d))).withColumn("cy", F.explode(F.transform(around, lambda d: cell(F.col("box_b.y0")) + d)))
    close = None
    for c in ("x0", "y0", "x1", "y1"):
        near = F.abs(F.col(f"box_a.{c}") - F.col(f"box_b.{c}")) <= tolerance + 1e-6
        close = near if close is None else close & near
    met = a.join(unsent(b), ["id", "cx", "cy"]).where(close & (F.abs(G.area(F.col("g_a")) - G.area(F.col("g_b"))) / G.area(F.col("g_b")) <= area_share))
    met = met.select("id", "i", "j", *_flat(F.col("g_a"), "a"), *_flat(F.col("g_b"), "b")).withColumn("gap", _gaps(1e9)(*_COLUMNS)["vertex"])
    return met.where(F.round("gap", 6) <= tolerance).select("id", "i", "j")


def matched_parts(pairs: DataFrame, tolerance: float) -> DataFrame:
    """``(id, parts_a, parts_b, fits, unique)``."""
    fits = part_fits(pairs, tolerance)
    g = fits.groupBy("id").agg(F.count("*").alias("fits"), F.count_distinct("i").alias("li"), F.count_distinct("j").alias("rj"))
    sizes = pairs.select("id", F.size("a").cast("bigint").alias("parts_a"), F.size("b").cast("bigint").alias("parts_b")).join(unsent(g), "id", "left").fillna(0, ["fits", "li", "rj"])
    proved = (F.col("parts_a") == F.col("parts_b")) & (F.col("fits") == F.col("parts_a")) & (F.col("li") == F.col("parts_a")) & (F.col("rj") == F.col("parts_b"))
    return sizes.select("id", "parts_a", "parts_b", "fits", proved.alias("unique"))


def agreement(pairs: DataFrame, tolerance: float, step: float = 1.0) -> DataFrame:
    """``pairs(id, a, b)`` to gaps, areas, intersection over union, distance of centroids and the verdict."""
    pairs = spread(pairs, "id")
    measured = pairs.select("id", *_flat(F.col("a"), "a"), *_flat(F.col("b"), "b"), G.area(F.col("a")).alias("area_a"), G.area(F.col("b")).alias("area_b"), G.centroid(F.col("a")).alias("ca"), G.centroid(F.col("b")).alias("cb"))
    measured = measured.withColumn("gap", _gaps(step)(*_COLUMNS))
    # sides of both under one parity leave out the common ground, so it takes no join of pieces
    covered, both = FS.covered_area(), [F.concat(f"{c}_a", f"{c}_b") for c in FS.FLAT]
    a, b = (covered(*[f"{c}_{t}" for c in FS.FLAT]) for t in "ab")
    common = F.when((F.size("xs_a") > 0) & (F.size("xs_b") > 0), F.greatest(F.lit(0.0), (a + b - covered(*both)) / 2))
    measured = measured.withColumn("area_m2", common).drop(*_COLUMNS)
    j = measured.join(unsent(matched_parts(pairs, tolerance)), "id")
    shared, delta = F.coalesce("area_m2", F.lit(0.0)), F.abs(F.col("area_a") - F.col("area_b")) / F.col("area_b")
    vertices = (F.round("gap.vertex", 6) <= tolerance) & (delta <= 0.01) & F.col("unique")
    return j.select("id", F.col("gap.vertex").alias("vertex_gap_m"), F.col("gap.boundary").alias("boundary_gap_m"), delta.alias("area_difference"), (shared / (F.col("area_a") + F.col("area_b") - shared)).alias("iou"),
                    F.hypot(F.col("ca.x") - F.col("cb.x"), F.col("ca.y") - F.col("cb.y")).alias("centroid_distance_m"),
                    F.when(vertices & (F.round("gap.boundary", 6) <= tolerance), "consistent_with_reference").when(vertices, "vertices_consistent_boundary_differs").otherwise("reference_disagrees").alias("verdict"))
