"""Exact k nearest objects with ties broken by id text, for boxes and for polygons, in one pass.

The first radius is the last: a quadtree of counts (cells of the right side's
centres, halved in number level by level, each summed with its eight
neighbours) tells for every left object the smallest cell size around it that
holds as many objects as are asked for, and so how far the last of them can be.
Both sides are then dealt to tiles of that object's own size and joined by
(group, size, tile); dense and empty ground never share a grid.

Polygon pairs that boxes let through are measured side by side in batches, many
pairs of equal size at once; polygons of many sides are packed into boxes of
``PACK`` sides each, and box pairs are looked into nearest first, until the
next is no nearer than what has been found.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.operators.tiles import BOX, box_distance
from groundsift.session import cut, ship_package, unsent

#: sides in a packed box; products of sides up to which pairs are measured without boxes
PACK, SMALL = 16, 4096
FLAT = ("xs", "ys", "sizes")
CONNECTION = "struct<d:double,ax:double,ay:double,bx:double,by:double>"


def _top(df: DataFrame, left_keys: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy(*left_keys).orderBy("distance_m", "r_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_radius(left: DataFrame, right: DataFrame, k: int, group: str, side: float, solid: bool) -> DataFrame:
    """``left`` with ``_level`` and ``_reach``: at least ``k`` right objects, or all of the group, are not further off.

    ``solid`` objects hold the middle of their box; others may lie half a diagonal away from it.
    """
    middle = [((F.col("x0") + F.col("x1")) / 2).alias("_mx"), ((F.col("y0") + F.col("y1")) / 2).alias("_my")]
    half = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2
    cell = lambda c, s=side: F.floor(F.col(c) / s).cast("bigint")
    right_cells = right.select(group, *middle, half.alias("_h")).groupBy(group, cell("_mx").alias("_cx"), cell("_my").alias("_cy")).agg(F.count("*").alias("_n"), F.max("_h").alias("_h"))
    right_cells = cut(right_cells)
    lt = left.withColumns({"_mx": middle[0], "_my": middle[1]}).withColumns({"_cx": cell("_mx"), "_cy": cell("_my")})
    span = lt.select(group, "_cx", "_cy").unionByName(right_cells.select(group, "_cx", "_cy")).groupBy(group).agg(
        F.greatest(F.max("_cx") - F.min("_cx"), F.max("_cy") - F.min("_cy")).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0))).first()[0]
    levels = F.explode(F.sequence(F.lit(0), F.lit(int(span).bit_length())))  # at the last one, all cells are neighbours
    tree = (right_cells.withColumn("_level", levels).groupBy(group, "_level", F.expr("shiftright(_cx, _level)").alias("_cx"), F.expr("shiftright(_cy, _level)").alias("_cy"))
            .agg(F.sum("_n").alias("_n"), F.max("_h").alias("_h")))
    step = F.sequence(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint"))
    around = (tree.withColumn("_cx", F.explode(F.transform(step, lambda d: F.col("_cx") + d))).withColumn("_cy", F.explode(F.transform(step, lambda d: F.col("_cy") + d)))
              .groupBy(group, "_level", "_cx", "_cy").agg(F.sum("_n").alias("_n"), F.max("_h").alias("_h")))
    need = right_cells.groupBy(group).agg(F.least(F.sum("_n"), F.lit(k)).alias("_need"), F.max("_h").alias("_widest"))
    places = lt.select(group, "_cx", "_cy").distinct().join(need, group).select(
        group, F.col("_cx").alias("_px"), F.col("_cy").alias("_py"), "_need", "_widest", levels.alias("_level"))
    places = places.withColumns({"_cx": F.expr("shiftright(_px, _level)"), "_cy": F.expr("shiftright(_py, _level)")})
    enough = (places.join(unsent(around), [group, "_level", "_cx", "_cy"]).where("_n >= _need")
              .groupBy(group, F.col("_px").alias("_cx"), F.col("_py").alias("_cy")).agg(F.min(F.struct("_level", "_h")).alias("_e")))
    size = F.pow(F.lit(2.0), F.col("_e._level")) * side
    reach = size * (2 * 2**0.5) + (F.lit(0.0) if solid else half + F.col("_e._h"))
    return lt.join(unsent(enough), [group, "_cx", "_cy"]).withColumns({"_reach": reach, "_level": F.col("_e._level")}).drop("_cx", "_cy", "_mx", "_my", "_e")


def near_pairs(left: DataFrame, right: DataFrame, k: int, group: str, left_id: str, side: float, solid: bool, extra: Sequence[str] = ()) -> DataFrame:
    """Pairs whose boxes are within the left object's radius, with the box distance; ``r_`` marks the right side."""
    lt = cut(with_radius(left.select(group, left_id, *BOX, *extra), right, k, group, side, solid))
    used = [r["_level"] for r in lt.select("_level").distinct().collect()]  # a level per halving of the ground at most
    tile = F.pow(F.lit(2.0), F.col("_level")) * (4 * side)
    at = lambda c: F.floor(c / tile).cast("bigint")
    r = right.select(group, F.col("id").alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in (*BOX, *extra)])
    objects = r.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in used]).cast("array<int>")))
    objects = objects.withColumn("_tx", F.explode(F.sequence(at(F.col("r_x0")), at(F.col("r_x1"))))).withColumn("_ty", F.explode(F.sequence(at(F.col("r_y0")), at(F.col("r_y1")))))
    asks = (lt.withColumn("_tx", F.explode(F.sequence(at(F.col("x0") - F.col("_reach")), at(F.col("x1") + F.col("_reach")))))
            .withColumn("_ty", F.explode(F.sequence(at(F.col("y0") - F.col("_reach")), at(F.col("y1") + F.col("_reach"))))))
    lx, ly = F.greatest(F.col("x0") - F.col("_reach"), F.col("r_x0")), F.greatest(F.col("y0") - F.col("_reach"), F.col("r_y0"))
    pairs = asks.join(unsent(objects), [group, "_level", "_tx", "_ty"]).where((at(lx) == F.col("_tx")) & (at(ly) == F.col("_ty")))
    return pairs.withColumn("box_m", box_distance()).where(F.col("box_m") <= F.col("_reach"))


def knn_join(left: DataFrame, right: DataFrame, k: int, group: str = "survey_id", left_id: str = "id", side: float = 100.0) -> DataFrame:
    """For every left box the k nearest right boxes of the same group.

    ``left`` and ``right`` carry the group, an id and the box.  Result columns:
    group, left id, r_id, distance_m, rank.  Groups with fewer than k objects
    give what they have.
    """
    keys = [group, left_id]
    pairs = near_pairs(left, right, k, group, left_id, side, True).withColumnRenamed("box_m", "distance_m")
    return _top(pairs, keys, k).select(*keys, "r_id", "distance_m", F.col("rank").cast("bigint").alias("rank"))


# ---------------------------------------------------------------- polygons

def sides_of(xs, ys, sizes) -> np.ndarray:
    """Sides (n, 4) of the closed rings of a flat geometry."""
    xs, ys = np.asarray(xs, float), np.asarray(ys, float)
    keep = np.ones(max(len(xs) - 1, 0), bool)
    keep[np.cumsum(np.asarray(sizes, int))[:-1] - 1] = False
    i = np.flatnonzero(keep)
    return np.stack([xs[i], ys[i], xs[i + 1], ys[i + 1]], 1)


def _feet(p: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many pairs, each point's (pairs, n, 2) nearest place on each side (pairs, m, 4): distance, x, y."""
    a, d = e[:, None, :, :2], e[:, None, :, 2:] - e[:, None, :, :2]
    v = p[:, :, None, :] - a
    n = (d * d).sum(-1)
    t = np.clip((v * d).sum(-1) / np.where(n == 0, 1, n), 0, 1)
    x, y = a[..., 0] + t * d[..., 0], a[..., 1] + t * d[..., 1]
    return np.hypot(p[:, :, None, 0] - x, p[:, :, None, 1] - y), x, y


def _holds(e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether a point (pairs, n, 2) of any lies inside the sides (pairs, m, 4)."""
    x, y = p[:, :, None, 0], p[:, :, None, 1]
    x1, y1, x2, y2 = (e[:, None, :, i] for i in range(4))
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return (hit.sum(-1) % 2 == 1).any(-1)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sides of both cross, pair by pair."""
    def turn(s, p):
        return np.sign((s[..., 2] - s[..., 0]) * (p[..., 1] - s[..., 1]) - (s[..., 3] - s[..., 1]) * (p[..., 0] - s[..., 0]))

    s, r = a[:, :, None, :], b[:, None, :, :]
    return ((turn(s, r[..., :2]) * turn(s, r[..., 2:]) < 0) & (turn(r, s[..., :2]) * turn(r, s[..., 2:]) < 0)).any((1, 2))


def connections(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shortest connections (pairs, 5) of polygons with sides (pairs, n, 4) and (pairs, m, 4): distance and its two ends."""
    d1, x1, y1 = _feet(a[..., :2], b)
    d2, x2, y2 = _feet(b[..., :2], a)
    rows = np.arange(len(a))
    i, j = d1.reshape(len(a), -1).argmin(1), d2.reshape(len(a), -1).argmin(1)
    one = np.stack([d1.reshape(len(a), -1)[rows, i], *a[rows, i // d1.shape[2], :2].T, x1.reshape(len(a), -1)[rows, i], y1.reshape(len(a), -1)[rows, i]], 1)
    two = np.stack([d2.reshape(len(a), -1)[rows, j], x2.reshape(len(a), -1)[rows, j], y2.reshape(len(a), -1)[rows, j], *b[rows, j // d2.shape[2], :2].T], 1)
    out = np.where((one[:, 0] <= two[:, 0])[:, None], one, two)
    out[_cross(a, b) | _holds(b, a[..., :2]) | _holds(a, b[..., :2]), 0] = 0.0
    return out


def packed_connection(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for one pair of polygons with many sides, (n, 4) and (m, 4)."""
    def boxes(e):
        parts = [e[i : i + PACK] for i in range(0, len(e), PACK)]
        return parts, np.array([[min(p[:, 0].min(), p[:, 2].min()), min(p[:, 1].min(), p[:, 3].min()), max(p[:, 0].max(), p[:, 2].max()), max(p[:, 1].max(), p[:, 3].max())] for p in parts])

    (pa, ba), (pb, bb) = boxes(a), boxes(b)
    rings = lambda e: e[None, np.concatenate([[True], (e[1:, :2] != e[:-1, 2:]).any(1)]), :2]  # noqa: E731  one corner of each ring
    inside = _holds(b[None], rings(a))[0] or _holds(a[None], rings(b))[0]
    dx = np.maximum(0, np.maximum(ba[:, None, 0] - bb[None, :, 2], bb[None, :, 0] - ba[:, None, 2]))
    dy = np.maximum(0, np.maximum(ba[:, None, 1] - bb[None, :, 3], bb[None, :, 1] - ba[:, None, 3]))
    bound = np.hypot(dx, dy).ravel()
    best = np.array([np.inf, 0, 0, 0, 0])
    for k in np.argsort(bound, kind="stable"):
        if bound[k] >= best[0]:
            break
        i, j = divmod(int(k), len(pb))
        found = np.array(_open_connection(pa[i], pb[j]))
        if found[0] < best[0]:
            best = found
    if inside:
        best[0] = 0.0
    return best


def _open_connection(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two runs of sides, which hold no ground."""
    ends = lambda e: np.concatenate([e[:, :2], e[:, 2:]])[None]
    p, q = ends(a), ends(b)
    d1, x1, y1 = (v[0] for v in _feet(p, b[None]))
    d2, x2, y2 = (v[0] for v in _feet(q, a[None]))
    i, j = np.unravel_index(d1.argmin(), d1.shape), np.unravel_index(d2.argmin(), d2.shape)
    best = (d1[i], *p[0, i[0]], x1[i], y1[i]) if d1[i] <= d2[j] else (d2[j], x2[j], y2[j], *q[0, j[0]])
    return np.array((0.0, *best[1:]) if _cross(a[None], b[None])[0] else best)


def all_sides(xs: pa.Array, ys: pa.Array, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sides (n, 4) of the flat geometries of a batch, row after row, where each row's begin and how many it has."""
    def flat_of(column):
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return column.flatten().to_numpy(zero_copy_only=False), lengths, np.cumsum(lengths) - lengths

    (x, points, at), (y, _, _), (size, rings, ring_at) = flat_of(xs), flat_of(ys), flat_of(sizes)
    opens = np.ones(len(x), bool)  # a point that a side starts from
    opens[(at + points - 1)[points > 0]] = False
    total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    row = np.repeat(np.arange(len(rings)), rings)
    last = np.zeros(len(size), bool)  # the last ring ends with the row
    last[(ring_at + rings - 1)[rings > 0]] = True
    opens[(at[row] + total[1:] - total[ring_at[row]] - 1)[~last]] = False
    i = np.flatnonzero(opens)
    count = np.bincount(np.repeat(np.arange(len(points)), points)[i], minlength=len(points))
    return np.stack([x[i], y[i], x[i + 1], y[i + 1]], 1).astype(float), np.cumsum(count) - count, count


def _connect_batch(*columns: pa.Array) -> pa.Array:
    (a, a_at, n), (b, b_at, m) = all_sides(*columns[:3]), all_sides(*columns[3:])
    out = np.full((len(n), 5), np.nan)
    both = np.flatnonzero((n > 0) & (m > 0))
    sizes, group = np.unique(np.stack([n[both], m[both]], 1), axis=0, return_inverse=True)
    order = both[np.argsort(group.ravel(), kind="stable")]
    for (k, q), rows in zip(sizes.tolist(), np.split(order, np.cumsum(np.bincount(group.ravel()))[:-1]) if len(both) else []):
        if k * q > SMALL:
            for i in rows:
                out[i] = packed_connection(a[a_at[i] : a_at[i] + k], b[b_at[i] : b_at[i] + q])
            continue
        step = max(1, (1 << 15) // (k * q))
        for s in range(0, len(rows), step):
            at = rows[s : s + step]
            out[at] = connections(a[a_at[at][:, None] + np.arange(k)], b[b_at[at][:, None] + np.arange(q)])
    return pa.StructArray.from_arrays([pa.array(c, mask=np.isnan(c)) for c in out.T], ["d", "ax", "ay", "bx", "by"])


def connected(pairs: DataFrame, a: Sequence[str] = FLAT, b: Sequence[str] = tuple(f"r_{c}" for c in FLAT)) -> DataFrame:
    """Add ``c``: the shortest connection of the flat geometries of a pair, zero long where they share ground.

    Batches stay in Arrow and all their sides are made at once: no array is made for a row.
    """
    ship_package(pairs.sparkSession)
    return pairs.withColumn("c", F.arrow_udf(_connect_batch, CONNECTION)(*a, *b))


def nearest_polygons(left: DataFrame, right: DataFrame, k: int, group: str = "survey_id", left_id: str = "id", side: float = 100.0) -> DataFrame:
    """For every left polygon the k nearest right polygons of the same group, and the connection to each.

    Both carry the group, an id, the box and the flat geometry.  Result
    columns: group, left id, r_id, distance_m, rank, and ``c``.
    """
    keys = [group, left_id]
    pairs = near_pairs(left, right, k, group, left_id, side, False, FLAT)
    measured = connected(pairs).withColumn("distance_m", F.col("c.d"))
    return _top(measured.select(*keys, "r_id", "distance_m", "c"), keys, k).select(*keys, "r_id", "distance_m", F.col("rank").cast("bigint").alias("rank"), "c")


def flat(shape) -> list:
    """Box and flat geometry of a geometry column."""
    b = G.bounds(shape)
    points = F.flatten(F.flatten(shape))
    return [*[b[c].alias(c) for c in BOX], F.transform(points, lambda p: p["x"]).alias("xs"), F.transform(points, lambda p: p["y"]).alias("ys"), F.transform(F.flatten(shape), lambda r: F.size(r)).alias("sizes")]
