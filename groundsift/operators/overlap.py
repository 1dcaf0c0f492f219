"""Overlap figures on boxes that need more than one pair at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def box_union_area(boxes: DataFrame, keys: Sequence[str], name: str = "union_m2") -> DataFrame:
    """Area of the union of boxes per key, relationally.

    Distinct x values cut the group into slabs; inside a slab y-intervals are
    merged with a running maximum.  Both windows partition by the key (then by
    key and slab), so no group is ever collected.
    """
    b = boxes.select(*keys, "x0", "y0", "x1", "y1").distinct()
    xs = b.select(*keys, F.explode(F.array("x0", "x1")).alias("_x")).distinct()
    slabs = (xs.withColumn("_xn", F.lead("_x").over(Window.partitionBy(*keys).orderBy("_x")))
             .where(F.col("_xn").isNotNull()))
    cells = b.join(slabs, list(keys)).where((F.col("x0") <= F.col("_x")) & (F.col("x1") >= F.col("_xn")))
    w = Window.partitionBy(*keys, "_x").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce(F.max("y1").over(w), F.col("y0"))))
    return (cells.withColumn("_g", gain * (F.col("_xn") - F.col("_x")))
            .groupBy(*keys).agg(F.sum("_g").alias(name)))


def clip_box(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Boxes cut to another box of the same row; rows left without area are dropped."""
    return (df.withColumn("_cx0", F.greatest("x0", x0)).withColumn("_cy0", F.greatest("y0", y0))
            .withColumn("_cx1", F.least("x1", x1)).withColumn("_cy1", F.least("y1", y1))
            .where("_cx0 < _cx1 AND _cy0 < _cy1")
            .withColumns({"x0": F.col("_cx0"), "y0": F.col("_cy0"), "x1": F.col("_cx1"), "y1": F.col("_cy1")})
            .drop("_cx0", "_cy0", "_cx1", "_cy1"))
