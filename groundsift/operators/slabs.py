"""Slab decomposition of polygons inside one task, with NumPy.

Horizontal cuts at every vertex and every crossing leave slabs in which sides
do not cross.  Inside a slab the union of polygons is a union of x-intervals,
so both covered and free ground come out as trapezoids.  A polygon covers what
its sides enclose an odd number of times; with ``sign``, the direction of each
side, what its curves wind around at all, as offset curves need.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np

#: slivers thinner than this many metres come from rounding along shared slanted sides
SLIVER = 1e-7


def ring_edges(xs, ys, sizes):
    """Edges of closed rings given as flat coordinates and ring lengths; horizontal ones are dropped."""
    xs, ys = np.asarray(xs, float), np.asarray(ys, float)
    n = len(xs)
    last = np.cumsum(np.asarray(sizes, int)) - 1
    keep = np.ones(n, bool)
    keep[last] = False
    i = np.nonzero(keep)[0]
    x1, y1, x2, y2 = xs[i], ys[i], xs[i + 1], ys[i + 1]
    swap = y1 > y2
    x1, x2 = np.where(swap, x2, x1), np.where(swap, x1, x2)
    y1, y2 = np.where(swap, y2, y1), np.where(swap, y1, y2)
    use = y2 > y1
    return x1[use], y1[use], x2[use], y2[use]


def ring_signs(ys, sizes):
    """Direction of the edges that ``ring_edges`` gives: -1 where a ring rises, 1 where it falls."""
    step = np.sign(np.diff(np.asarray(ys, float)))
    inside = np.ones(len(step), bool)
    inside[np.cumsum(np.asarray(sizes, int))[:-1] - 1] = False
    return -step[inside & (step != 0)].astype(int)


#: pairs of sides, or cells of a table of slabs by sides, that are looked at in one step
TABLE = 1 << 20
#: sides whose boxes are further apart than this can't cross, whatever rounding does
NEAR = 1e-6


def _crossing_heights(x1, y1, x2, y2, lo, hi):
    slope = (x2 - x1) / (y2 - y1)
    base = x1 - slope * y1
    left, right = np.minimum(x1, x2) - NEAR, np.maximum(x1, x2) + NEAR
    # a side meets those that begin above it and below its end
    order = np.argsort(y1, kind="stable")
    stop = np.searchsorted(y1[order], y2[order], "left")
    total = np.cumsum(np.maximum(stop - np.arange(1, len(order) + 1), 0))
    at, out = 0, []
    while at < len(order):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + TABLE, "right")))
        i, j = _spans(np.arange(at + 1, end + 1), stop[at:end])
        a, b = order[i + at], order[j]
        met = (left[a] <= right[b]) & (left[b] <= right[a]) & ((slope[a] != 0) | (slope[b] != 0))  # only slanted sides can cross anything
        a, b = a[met], b[met]
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (base[b] - base[a]) / (slope[a] - slope[b])
        ok = np.isfinite(y) & (y > np.maximum(y1[b], y1[a])) & (y < np.minimum(y2[b], y2[a])) & (y > lo) & (y < hi)
        out.append(y[ok])
        at = end
    return np.concatenate(out) if out else np.empty(0)


def slabs(x1, y1, x2, y2, owner, lo, hi, sign=None):
    """Yield (ya, yb, left edge ids, right edge ids) of the union, slab by slab from below; many slabs are worked out at once."""
    inner = np.concatenate([y1, y2, _crossing_heights(x1, y1, x2, y2, lo, hi)])
    cuts = np.unique(np.concatenate([inner[(inner > lo) & (inner < hi)], [lo, hi]]))
    cuts = cuts[np.concatenate([[True], np.diff(cuts) > 1e-9])] if len(cuts) > 1 else cuts
    cuts[-1] = hi
    slope = (x2 - x1) / (y2 - y1)
    step = max(1, TABLE // max(1, len(y1)))
    for s in range(0, len(cuts) - 1, step):
        ends = cuts[s : s + step + 1]
        mid = (ends[:-1] + ends[1:]) / 2
        at, act = np.nonzero((y1 < mid[:, None]) & (y2 > mid[:, None]))
        xm = x1[act] + slope[act] * (mid[at] - y1[act])
        order = np.lexsort((xm, owner[act], at))
        at, act, xm = at[order], act[order], xm[order]
        if sign is None:  # even-odd inside each owner, and so in each slab
            left, right, lm, rm, at = act[0::2], act[1::2], xm[0::2], xm[1::2], at[0::2]
        else:  # an owner's windings in a slab add up to zero, so one sum serves all
            wind = np.cumsum(sign[act])
            opens, closes = wind - sign[act] == 0, wind == 0
            left, right, lm, rm, at = act[opens], act[closes], xm[opens], xm[closes], at[opens]
        left, right, at = _merged(left, right, lm, rm, at)
        bounds = np.searchsorted(at, np.arange(len(mid) + 1)).tolist()
        ends = ends.tolist()
        for k in range(len(mid)):
            yield ends[k], ends[k + 1], left[bounds[k] : bounds[k + 1]], right[bounds[k] : bounds[k + 1]]


def cover(x1, y1, x2, y2, owner, sign=None):
    """Trapezoids of the union of closed polygons."""
    if not len(y1):
        return []
    xs, ys, slope = x1.tolist(), y1.tolist(), ((x2 - x1) / (y2 - y1)).tolist()

    def at(e, y):
        return xs[e] + slope[e] * (y - ys[e])

    done, open_ = [], {}
    for ya, yb, left, right in slabs(x1, y1, x2, y2, owner, float(y1.min()), float(y2.max()), sign):
        now = {}
        for le, re in zip(left.tolist(), right.tolist()):
            piece = open_.pop((le, re), None)
            if piece is None:
                piece = [ya, yb, at(le, ya), at(le, yb), at(re, ya), at(re, yb)]
                done.append(piece)
            else:
                piece[1], piece[3], piece[5] = yb, at(le, yb), at(re, yb)
            now[(le, re)] = piece
        open_ = now
    return [tuple(p) for p in done]


def _places(of, at, values_of, values, side):
    """How many ``values``, sorted by what they are ``of``, stand before each ``at`` in the order of (of, value)."""
    query = np.concatenate([np.ones(len(at), bool), np.zeros(len(values), bool)])
    order = np.lexsort((query if side == "right" else ~query, np.concatenate([at, values]), np.concatenate([of, values_of])))
    seen = np.cumsum(~query[order])
    out = np.empty(len(query), int)
    out[order] = seen
    return out[: len(at)]


def _spans(first, stop):
    """Numbers of the spans and all that lies in them, one after the other."""
    n = np.maximum(stop - first, 0)
    at = np.repeat(np.arange(len(n)), n)
    return at, first[at] + (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n))


def cover_many(x1, y1, x2, y2, poly, sign=None):
    """``cover`` of many polygons at once: the polygon of every trapezoid and the trapezoids (n, 6), polygon by polygon.

    ``poly`` numbers the polygon of every side and does not fall.
    """
    if not len(y1):
        return np.zeros(0, int), np.zeros((0, 6))
    slope = (x2 - x1) / (y2 - y1)
    base = x1 - slope * y1
    # crossings: only sides of one polygon whose heights overlap meet
    order = np.lexsort((y1, poly))
    a, b = _spans(np.arange(1, len(order) + 1), _places(poly, y2, poly[order], y1[order], "left")[order])
    a, b = order[a], order[b]
    met = (np.minimum(x1[a], x2[a]) - NEAR <= np.maximum(x1[b], x2[b])) & (np.minimum(x1[b], x2[b]) <= np.maximum(x1[a], x2[a]) + NEAR)
    a, b = a[met], b[met]
    with np.errstate(divide="ignore", invalid="ignore"):
        y = (base[b] - base[a]) / (slope[a] - slope[b])
    ok = np.isfinite(y) & (y > np.maximum(y1[a], y1[b])) & (y < np.minimum(y2[a], y2[b]))
    cuts, of = np.concatenate([y1, y2, y[ok]]), np.concatenate([poly, poly, poly[a[ok]]])
    order = np.lexsort((cuts, of))
    cuts, of = cuts[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (np.diff(cuts) > 1e-9)
    top = cuts[np.append(of[1:] != of[:-1], True)]
    cuts, of = cuts[new], of[new]
    cuts[np.append(of[1:] != of[:-1], True)] = top
    low = np.flatnonzero(of[1:] == of[:-1])
    ya, yb, of = cuts[low], cuts[low + 1], of[low]
    mid = (ya + yb) / 2
    act, at = _spans(_places(poly, y1, of, mid, "right"), _places(poly, y2, of, mid, "left"))
    xm = x1[act] + slope[act] * (mid[at] - y1[act])
    order = np.lexsort((act, xm, at))
    at, act, xm = at[order], act[order], xm[order]
    if sign is None:
        left, right, lm, rm, at = act[0::2], act[1::2], xm[0::2], xm[1::2], at[0::2]
    else:
        wind = np.cumsum(sign[act])
        opens, closes = wind - sign[act] == 0, wind == 0
        left, right, lm, rm, at = act[opens], act[closes], xm[opens], xm[closes], at[opens]
    left, right, at = _merged(left, right, lm, rm, at)
    # stretches between the same two sides in slabs that follow each other are one trapezoid
    order = np.lexsort((at, right, left))
    start = np.ones(len(order), bool)
    o, p = order[1:], order[:-1]
    start[1:] = (left[o] != left[p]) | (right[o] != right[p]) | (at[o] != at[p] + 1)
    first, last = order[start], order[np.append(start[1:], True)] if len(order) else order
    seen = np.argsort(first)
    first, last = first[seen], last[seen]
    x = lambda e, h: x1[e] + slope[e] * (h - y1[e])
    le, re, y0, y9 = left[first], right[first], ya[at[first]], yb[at[last]]
    return of[at[first]], np.stack([y0, y9, x(le, y0), x(le, y9), x(re, y0), x(re, y9)], 1)


def _merged(left, right, lm, rm, at):
    """Union of the intervals of every slab: the sides that bound it, and its slab."""
    order = np.lexsort((lm, at))
    left, right, lm, rm, at = left[order], right[order], lm[order], rm[order], at[order]
    # ranks by slab and right side, so that their running maximum starts anew in each slab; of equals the first counts
    place = np.arange(len(at))
    by = np.lexsort((-place, rm, at))
    rank = np.empty(len(at), int)
    rank[by] = place
    far = by[np.maximum.accumulate(rank)]
    start = np.ones(len(at), bool)
    start[1:] = (at[1:] != at[:-1]) | (lm[1:] > rm[far[:-1]] + SLIVER)
    first = np.nonzero(start)[0]
    # right side of a merged run: the interval that reaches furthest
    stop = np.append(first[1:], len(at))[: len(first)] - 1
    return left[first], right[far[stop]], at[first]


def free(x1, y1, x2, y2, owner, bx0, by0, bx1, by1, sign=None, inside=False):
    """Free trapezoids of a rectangle, or with ``inside`` covered ones, and the pairs that share a stretch of horizontal side.

    Returns (pieces, links); a piece is (y0, y1, xl0, xl1, xr0, xr1).
    """
    xs, ys, slope = x1.tolist(), y1.tolist(), ((x2 - x1) / (y2 - y1)).tolist() if len(y1) else []
    left_wall, right_wall = -1, -2

    def at(e, y):
        if e == left_wall:
            return bx0
        if e == right_wall:
            return bx1
        return xs[e] + slope[e] * (y - ys[e])

    if not len(y1):
        return ([] if inside else [(by0, by1, bx0, bx0, bx1, bx1)]), []
    # walls act as sides too, so slanted sides are cut where they meet a wall
    wx = np.array([bx0, bx1])
    wy0, wy1 = np.array([by0, by0]), np.array([by1, by1])
    cut = _crossing_heights(np.concatenate([x1, wx]), np.concatenate([y1, wy0]), np.concatenate([x2, wx]),
                            np.concatenate([y2, wy1]), by0, by1)
    pieces, links, below = [], [], []
    extra = np.unique(cut).tolist()
    for ya, yb, left, right in slabs(x1, y1, x2, y2, owner, by0, by1, sign):
        inner = extra[bisect_right(extra, ya + 1e-9) : bisect_left(extra, yb - 1e-9)]
        bounds = [e for pair in zip(left.tolist(), right.tolist()) for e in pair]
        if not inside:
            bounds = [left_wall, *bounds, right_wall]
        for za, zb in zip([ya, *inner], [*inner, yb]):
            here = []
            for le, re in zip(bounds[0::2], bounds[1::2]):
                l0, l1, r0, r1 = at(le, za), at(le, zb), at(re, za), at(re, zb)
                if (l0 + l1) / 2 < bx0:
                    le, l0, l1 = left_wall, bx0, bx0
                if (r0 + r1) / 2 > bx1:
                    re, r0, r1 = right_wall, bx1, bx1
                if max(r0 - l0, r1 - l1) <= SLIVER or (l0 + l1) / 2 >= (r0 + r1) / 2:
                    continue
                here.append((le, re, l0, l1, r0, r1))
            now, j = [], 0
            grown = {(p[0], p[1]): p for p in below}
            for le, re, l0, l1, r0, r1 in here:
                old = grown.get((le, re))
                if old is not None:
                    i = old[2]
                    pieces[i] = (pieces[i][0], zb, pieces[i][2], l1, pieces[i][4], r1)
                    now.append((le, re, i, l1, r1))
                    continue
                i = len(pieces)
                pieces.append((za, zb, l0, l1, r0, r1))
                now.append((le, re, i, l1, r1))
            for (_, _, i, _, _), (_, _, l0, _, r0, _) in zip(now, here):
                while j < len(below) and below[j][4] <= l0 + SLIVER:
                    j += 1
                k = j
                while k < len(below) and below[k][3] < r0 - SLIVER:
                    if below[k][2] != i:
                        links.append((below[k][2], i))
                    k += 1
            below = now
    return pieces, links


def components(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]


def segment_distance(px, py, ax, ay, bx, by):
    """Distance from points (column vector) to segments (row vector)."""
    dx, dy = bx - ax, by - ay
    norm = dx * dx + dy * dy
    t = np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(norm == 0, 1, norm), 0, 1)
    return np.hypot(px - (ax + t * dx), py - (ay + t * dy))


def enters_square(ax, ay, bx, by, h):
    """Which segments have a point inside the open square |x| < h, |y| < h."""
    dx, dy = bx - ax, by - ay
    t0, t1 = np.zeros(ax.shape), np.ones(ax.shape)
    inside = np.ones(ax.shape, bool)
    for a, d in ((ax, dx), (ay, dy)):
        still = d == 0
        inside &= ~still | (np.abs(a) < h)
        safe = np.where(still, 1, d)
        lo, hi = np.minimum((-h - a) / safe, (h - a) / safe), np.maximum((-h - a) / safe, (h - a) / safe)
        t0 = np.where(still, t0, np.maximum(t0, lo))
        t1 = np.where(still, t1, np.minimum(t1, hi))
    return inside & (t0 < t1)
