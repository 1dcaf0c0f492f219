"""Word boxes of scanned pages: rows, cells, columns, tables.

A page holds a bounded number of words, so a page is the unit of every grouped
step; words of different pages never meet.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundsift.session import ship_package


def normalise_words(words: DataFrame) -> DataFrame:
    """Boxes x, y, w, h in pixels to corners in 0..1; words off the page are dropped with their page."""
    ok = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") + F.col("w") <= F.col("width") + 1) & (F.col("y") + F.col("h") <= F.col("height") + 1)
    out = words.withColumn("usable", ok & F.col("text").isNotNull() & F.length("text").between(1, 200))
    return out.withColumns({"x0": F.col("x") / F.col("width"), "y0": F.col("y") / F.col("height"),
                            "x1": (F.col("x") + F.col("w")) / F.col("width"), "y1": (F.col("y") + F.col("h")) / F.col("height")})


def visual_rows(words: DataFrame, page: Sequence[str]) -> DataFrame:
    """Row number of every word: a row starts where a word lies lower than the row's first word by 0.55 of the median height.

    The comparison runs against the first word of the open row, which no window
    expresses, so a page is scanned in one pass.  Pages are gathered natively and
    only heights and middles go to Python, many pages a batch; rows are numbered from 1 on without gaps.
    """
    ship_package(words.sparkSession)
    rest = [c for c in words.columns if c not in page]
    pages = words.groupBy(*page).agg(F.collect_list(F.struct(*rest)).alias("_w"))
    scan = F.pandas_udf(_scan_pages, "array<int>")
    row = scan(F.transform("_w", lambda w: ((w["y0"] + w["y1"]) / 2).cast("double")), F.transform("_w", lambda w: (w["y1"] - w["y0"]).cast("double")))
    each = pages.withColumn("_row", row).select(*page, F.explode(F.arrays_zip("_w", "_row")).alias("_z"))
    return each.select(*page, *[F.col(f"_z._w.{c}").alias(c) for c in rest], F.col("_z._row").alias("row")).select(*words.columns, "row")


def _scan_pages(middles: pd.Series, heights: pd.Series) -> pd.Series:
    out = []
    for c, h in zip(middles, heights):
        c = np.asarray(c, float)
        order, step = np.argsort(c, kind="stable"), float(np.median(np.asarray(h, float))) * 0.55
        rows, start, n = [], None, 0
        for v in c[order].tolist():
            if start is None or v - start > step:
                start, n = v, n + 1
            rows.append(n)
        numbered = np.empty(len(c), np.int32)
        numbered[order] = rows
        out.append(numbered)
    return pd.Series(out)


def cells(rows: DataFrame, page: Sequence[str], gap: float = 0.018) -> DataFrame:
    """Words of a row merged into cells where the blank between them is small."""
    w = Window.partitionBy(*page, "row").orderBy("x0")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    c = rows.withColumn("_new", F.when(reach.isNull() | (F.col("x0") - reach > gap), 1).otherwise(0)).withColumn("cell", F.sum("_new").over(w))
    return c.groupBy(*page, "row", "cell").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda t: t["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def numeric_cell(text: Column) -> Column:
    """Cells that may hold a coordinate: five digits or more, besides them only marks and letters taken for a zero."""
    return (F.regexp_count(text, F.lit(r"\d")) >= 5) & text.rlike(r"^[-\d\s.,ОOоo]+$")


def anchors(items: DataFrame, page: Sequence[str], x: str = "x0", gap: float = 0.04, least: int = 2) -> DataFrame:
    """Column positions: clusters of x values with their median, in reading order."""
    w = Window.partitionBy(*page).orderBy(x)
    c = items.withColumn("_new", F.when(F.col(x) - F.lag(x).over(w) <= gap, 0).otherwise(1)).withColumn("_k", F.sum("_new").over(w))
    a = c.groupBy(*page, "_k").agg(F.median(x).alias("centre"), F.count("*").alias("n")).where(F.col("n") >= least)
    return a.withColumn("column", F.row_number().over(Window.partitionBy(*page).orderBy("centre"))).select(*page, "column", "centre", "n")


def assign_columns(items: DataFrame, columns: DataFrame, page: Sequence[str], x: str, keys: Sequence[str]) -> DataFrame:
    """Nearest column of every item."""
    j = items.join(columns.select(*page, "column", "centre"), list(page))
    best = j.groupBy(*page, *keys).agg(F.min_by("column", F.struct(F.abs(F.col(x) - F.col("centre")), "column")).alias("column"))
    return items.join(best, [*page, *keys])


def split_tables(rows: DataFrame, page: Sequence[str], y: str = "cy", factor: float = 2.5) -> DataFrame:
    """Table number of every row: a new table after a gap of more than 2.5 times the median spacing."""
    w = Window.partitionBy(*page).orderBy(y)
    g = rows.withColumn("_d", F.col(y) - F.lag(y).over(w))
    mid = g.groupBy(*page).agg(F.coalesce(F.median("_d"), F.lit(0.02)).alias("_m"))
    g = g.join(mid, list(page)).withColumn("_n", F.when(F.col("_d") > F.col("_m") * factor, 1).otherwise(0))
    return g.withColumn("table", F.sum("_n").over(w) + 1).drop("_d", "_m", "_n")
