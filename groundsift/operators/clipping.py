"""Polygons cut to windows, with holes and as many parts as come out.

Inside a window a polygon is a set of trapezoids between its sides and the
walls; their outlines, cancelled where trapezoids meet and linked to rings, are
the rings of the clipped polygon.  A cut through a hole opens it, a cut across
two arms leaves two parts, and no ring runs along a wall it does not touch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.operators import outlines, slabs
from groundsift.session import ship_package

WINDOW = ("bx0", "by0", "bx1", "by1")


def clipped_pieces(shapes: DataFrame, group: str = "survey_id", key: str = "id") -> DataFrame:
    """``shapes``: group, key, flat geometry and window, to trapezoids of what lies inside (group, key, piece, window)."""
    ship_package(shapes.sparkSession)

    @F.pandas_udf(f"array<{G.PIECE_T}>")
    def inside(xs: pd.Series, ys: pd.Series, sizes: pd.Series, bx0: pd.Series, by0: pd.Series, bx1: pd.Series, by1: pd.Series) -> pd.Series:
        def one(px, py, n, *window):
            if px is None or len(px) == 0 or not (window[0] < window[2] and window[1] < window[3]):
                return []
            x1, y1, x2, y2 = slabs.ring_edges(px, py, n)
            near = (y2 > window[1]) & (y1 < window[3])
            pieces, _ = slabs.free(x1[near], y1[near], x2[near], y2[near], np.zeros(int(near.sum()), int), *window, inside=True)
            return [dict(zip(G.PIECE, p)) for p in pieces]

        return pd.Series([one(*t) for t in zip(xs, ys, sizes, bx0, by0, bx1, by1)])

    made = shapes.select(group, key, *WINDOW, F.explode(inside("xs", "ys", "sizes", *WINDOW)).alias("p"))
    return made.select(group, key, "p.*", *WINDOW)


def clipped_rings(shapes: DataFrame, group: str = "survey_id", key: str = "id") -> DataFrame:
    """Linked sides of the rings of every clipped polygon, shells counter-clockwise; ``outlines`` turns them into vertices and figures."""
    pieces = clipped_pieces(shapes, group, key).select(F.col(group).alias("survey_id"), F.col(key).cast("string").alias("gap"), *G.PIECE, *WINDOW)
    return outlines.link_rings(outlines.boundary_sides(pieces))


def clipped_figures(shapes: DataFrame, group: str = "survey_id", key: str = "id") -> DataFrame:
    """One row per polygon that reaches into its window: area, outline, parts and holes of what lies inside."""
    rings = outlines.ring_figures(clipped_rings(shapes, group, key))
    return rings.groupBy(F.col("survey_id").alias(group), F.col("gap").alias(key)).agg(
        F.sum("area").alias("area_m2"), F.sum("length").alias("length_m"), F.count_if(F.col("area") > 0).alias("parts"), F.count_if(F.col("area") < 0).alias("holes"))
