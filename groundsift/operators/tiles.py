"""Spatial joins as tile equi-joins.

Both sides are exploded to the tiles their boxes touch and joined on
(group, tile x, tile y).  A pair is kept only in the tile that owns the lower
left corner of the common box, so no distinct is needed afterwards.  Adaptive
execution splits a hot tile; nothing is broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.session import unsent

#: default side of a join tile in metres: a few objects of usual size per tile
TILE_M = 250.0
BOX = ("x0", "y0", "x1", "y1")


def tile_of(v: Column, side: float) -> Column:
    return F.floor(v / F.lit(side)).cast("bigint")


def explode_tiles(df: DataFrame, side: float, grow: Column | float = 0.0, box: Sequence[str] = BOX) -> DataFrame:
    """One row per tile touched by the box, grown on all sides by ``grow``."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    g = grow if isinstance(grow, Column) else F.lit(float(grow))
    return (df.withColumn("_tx", F.explode(F.sequence(tile_of(x0 - g, side), tile_of(x1 + g, side))))
              .withColumn("_ty", F.explode(F.sequence(tile_of(y0 - g, side), tile_of(y1 + g, side)))))


def tile_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("survey_id",), side: float = TILE_M,
              touch: bool = False, keep_left: bool = False) -> DataFrame:
    """Pairs whose boxes share area (or at least a point when ``touch``).

    Columns of ``right`` other than ``keys`` come out prefixed ``r_``.  With
    ``keep_left`` rows of ``left`` without a partner are kept by a later left
    join on their own key, which the caller does; here pairs are inner.
    """
    r = right.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    lt = explode_tiles(left, side)
    rt = explode_tiles(r, side, box=tuple(f"r_{c}" for c in BOX))
    on = [*keys, "_tx", "_ty"]
    lx, ly = F.greatest("x0", "r_x0"), F.greatest("y0", "r_y0")
    hx, hy = F.least("x1", "r_x1"), F.least("y1", "r_y1")
    meets = (lx <= hx) & (ly <= hy) if touch else (lx < hx) & (ly < hy)
    owner = (tile_of(lx, side) == F.col("_tx")) & (tile_of(ly, side) == F.col("_ty"))
    return lt.join(unsent(rt), on).where(meets & owner).drop("_tx", "_ty")


def box_overlap() -> Column:
    """Common area of the two boxes of a joined pair."""
    return (F.greatest(F.lit(0.0), F.least("x1", "r_x1") - F.greatest("x0", "r_x0"))
            * F.greatest(F.lit(0.0), F.least("y1", "r_y1") - F.greatest("y0", "r_y0")))


def box_distance() -> Column:
    """Distance between the two boxes of a joined pair, zero when they touch."""
    dx = F.greatest(F.lit(0.0), F.col("r_x0") - F.col("x1"), F.col("x0") - F.col("r_x1"))
    dy = F.greatest(F.lit(0.0), F.col("r_y0") - F.col("y1"), F.col("y0") - F.col("r_y1"))
    return F.sqrt(dx * dx + dy * dy)


def piece_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str],
               group: Sequence[str] = ("survey_id",), side: float = TILE_M, min_area: float = 0.01) -> DataFrame:
    """Overlap area of objects given as pieces: tile join of pieces, then one sum per pair of objects.

    Both inputs carry the piece columns; a box is a single piece.  The sum is
    combined before its shuffle, so objects of many pieces do not gather in one task.
    """
    def boxed(df):
        return (df.withColumn("x0", F.least("xl0", "xl1")).withColumn("x1", F.greatest("xr0", "xr1")))

    pairs = tile_join(boxed(left), boxed(right), group, side)
    a = {k: F.col(k) for k in G.PIECE}
    b = {k: F.col(f"r_{k}") for k in G.PIECE}
    return (pairs.withColumn("_a", G.piece_overlap(a, b)).where(F.col("_a") > 0)
            .groupBy(*group, *left_keys, *[F.col(f"r_{k}") for k in right_keys])
            .agg(F.sum("_a").alias("area_m2")).where(F.col("area_m2") > min_area))


def box_pieces(df: DataFrame) -> DataFrame:
    """Boxes as pieces; keeps every other column."""
    return (df.withColumn("xl0", F.col("x0")).withColumn("xl1", F.col("x0"))
              .withColumn("xr0", F.col("x1")).withColumn("xr1", F.col("x1")))


def distance_join(left: DataFrame, right: DataFrame, within: Column | float, keys: Sequence[str] = ("survey_id",),
                  side: float = TILE_M, distance: Column | None = None) -> DataFrame:
    """Pairs not further apart than ``within``; the left box is grown, the exact distance decides."""
    g = within if isinstance(within, Column) else F.lit(float(within))
    r = right.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    lt = explode_tiles(left, side, g)
    rt = explode_tiles(r, side, box=tuple(f"r_{c}" for c in BOX))
    lx, ly = F.greatest(F.col("x0") - g, F.col("r_x0")), F.greatest(F.col("y0") - g, F.col("r_y0"))
    owner = (tile_of(lx, side) == F.col("_tx")) & (tile_of(ly, side) == F.col("_ty"))
    return (lt.join(unsent(rt), [*keys, "_tx", "_ty"]).where(owner).drop("_tx", "_ty")
              .withColumn("distance_m", box_distance() if distance is None else distance)
              .where(F.col("distance_m") <= g))
