"""Whitening by the leading components of the covariance, found by contour integration (FEAST).

Components of a vector become whole numbers, ``floor(1024 c) + 100000``.  Spark
adds them up exactly, then the products of the centred vectors; what reaches the
driver is one ``d x d`` matrix, whatever the number of rows.

The spectrum is searched in intervals.  The inertia of ``V - s I``, the signs of
the pivots of a symmetric factorization, tells how many eigenvalues lie above a
shift ``s``; bisection on it finds a lower end that leaves the wanted ones above
it and cuts what is above into intervals of few eigenvalues.  In an interval, the
complex shifted systems ``(z I - V) X = Y`` at the points of a quadrature around
it are solved and added up, which filters ``Y`` down to the interval's
eigenvectors; a Rayleigh-Ritz step in that subspace gives the pairs, and both
repeat until residuals no longer fall.  An interval is done only if it holds as
many pairs as the inertia at its two ends says, so none is missed.

Rows whose vector is null or holds null or non-finite entries are left out; so is
a vector of another length than the most common one (of equally common ones the
longest), whose missing entries count as null.  Entries beyond 2**60 / 1024 count
as that.  Repeated rows count as often as they come; null ids stay.  Directions
without variance (below 1e-12 of the largest) can't be whitened and give no row;
nor does an empty table.  Of a multiple eigenvalue any orthonormal basis may come
out; the largest entry of a component is positive.  A ``deviation`` too large for
a long is null.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsift.llm.common import arrow_map
from groundsift.session import cut

#: eigenvalues an interval holds at most, points of the quadrature, rounds of filter and Rayleigh-Ritz
SLICE, POINTS, ROUNDS = 6, 8, 40
#: variance below this share of the largest is none
NOTHING = 1e-12
SCALE, OFFSET, LIMIT = 1024.0, 100_000, 2.0**60


# ---------------------------------------------------------------- eigenpairs

def inertia(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, from the pivots of its Bunch-Parlett factorization."""
    a = a.copy()
    least = np.finfo(float).eps * max(float(np.abs(a).max(initial=0)), np.finfo(float).tiny)
    above, alpha = 0, (1 + math.sqrt(17)) / 8
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        i = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        r, s = divmod(int(off.argmax()), len(a))
        if max(diagonal[i], off[r, s]) <= least:  # the rest is zero
            break
        if diagonal[i] >= alpha * off[r, s]:  # a pivot of one
            pivot = a[i, i]
            above += bool(pivot > 0)
            rest = np.delete(np.arange(len(a)), i)
            column = a[rest, i]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / pivot)
        else:  # a pivot of two: one eigenvalue of either sign
            above += 1
            rest = np.delete(np.arange(len(a)), [r, s])
            two, columns = a[np.ix_([r, s], [r, s])], a[np.ix_(rest, [r, s])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(two, columns.T)
    return above


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """``(low, high, count)`` from the top down, that together hold the ``wanted`` largest eigenvalues at least."""
    d = len(v)
    size = float(np.abs(v).sum(1).max())
    count = lambda s: inertia(v - s * np.eye(d))
    low, high = -1.01 * size, 1.01 * size
    n = d
    while n > wanted and high - low > 1e-10 * size:
        middle = (low + high) / 2
        m = count(middle)
        if m >= wanted:
            low, n = middle, m
        else:
            high = middle
    out, open_ = [], [(low, 1.01 * size, n, 0)]
    while open_:
        a, b, na, nb = open_.pop()
        if na == nb:
            continue
        if na - nb <= SLICE or b - a <= 1e-9 * size:
            out.append((a, b, na - nb))
            continue
        middle = (a + b) / 2
        m = count(middle)
        open_ += [(a, middle, na, m), (middle, b, m, nb)]
    return sorted(out, reverse=True)


def filtered(v: np.ndarray, low: float, high: float, y: np.ndarray, points: int = POINTS) -> np.ndarray:
    """The quadrature of ``(z I - V)^-1 Y`` around ``[low, high]``; the lower half of the circle is the upper one's conjugate."""
    center, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(points)
    total = np.zeros_like(y)
    for x, w in zip(at, weight):
        turn = np.exp(1j * math.pi / 2 * (1 + x))
        total += w / 2 * (radius * turn * np.linalg.solve((center + radius * turn) * np.eye(len(v)) - v, y.astype(complex))).real
    return total


def interval_pairs(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs in an interval."""
    d = len(v)
    size = float(np.abs(v).sum(1).max())
    rng = np.random.default_rng(7)
    width = min(d, max(2 * count, count + 4))
    y = rng.standard_normal((d, width))
    best = None
    for _ in range(ROUNDS):
        q = np.linalg.qr(filtered(v, low, high, y))[0]
        value, turn = np.linalg.eigh(q.T @ v @ q)
        y = q @ turn
        inside = (value > low) & (value <= high)
        residual = np.abs(v @ y[:, inside] - y[:, inside] * value[inside]).max(initial=0)
        if inside.sum() != count:
            if inside.sum() > count and best is None:  # a guess that strayed in: the filter will move it out
                continue
            if width < d and best is None:
                width = min(d, width + count)
                y = np.hstack([y, rng.standard_normal((d, width - y.shape[1]))])
            continue
        if best is not None and residual >= best[0] / 2:
            break
        best = (residual, value[inside], y[:, inside])
        if residual <= 1e-15 * size:
            break
    if best is None:
        raise ArithmeticError(f"inertia says {count} eigenvalues in ({low}, {high}], the filter finds another number")
    return best[1], best[2]


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their eigenvectors as columns; those without variance are left out."""
    wanted = min(wanted, len(v))
    if not wanted or not np.abs(v).max() > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    found = [interval_pairs(v, *i) for i in intervals(v, wanted)]
    q = np.linalg.qr(np.hstack([y for _, y in found]))[0]  # all intervals together once more
    value, turn = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-value, kind="stable")[:wanted]
    order = order[value[order] > NOTHING * value.max()]
    vectors = q @ turn[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return value[order], vectors * sign


# ---------------------------------------------------------------- sums over rows

def whole(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of a batch as whole numbers."""
    c = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), d)
    return np.clip(c, -LIMIT, LIMIT).astype(np.int64) + OFFSET


def sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sum of each dimension."""
    def add(batches):
        total = [0] * d
        for b in batches:
            x = whole(b["embedding"], d)
            high, low = x >> 32, x & 0xFFFFFFFF  # neither sum can leave a long
            total = [t + (h << 32) + w for t, h, w in zip(total, high.sum(0).tolist(), low.sum(0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(t) for t in total])], names=["i", "part"])

    parts = arrow_map(rows, add, "i int, part string").groupBy("i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    by = {r["i"]: int(r["total"]) for r in parts.collect()}
    return [by[i] for i in range(d)]


def second_moments(rows: DataFrame, name: str, d: int, centred) -> np.ndarray:
    """Sums of products of ``centred(column)``, added up by task, then by entry."""
    def add(batches):
        total = np.zeros((d, d))
        for b in batches:
            y = centred(b[name])
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = arrow_map(rows, add, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for r in parts.collect():
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def deviations(x: np.ndarray, n: int, base: np.ndarray, rest: list[int]) -> list[int | None]:
    """Sum of ``(n x - S)**2`` of each row, where ``S = n base + rest``; null beyond a long."""
    y = x - base
    far = int(np.abs(y).max(initial=0)) * n + max((abs(r) for r in rest), default=0)
    if x.shape[1] * far * far < 1 << 63:
        z = n * y - np.array(rest, np.int64)
        return (z * z).sum(1).tolist()
    exact = [sum((n * a - r) ** 2 for a, r in zip(row, rest)) for row in y.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, components: int = 8) -> DataFrame:
    """``rows(vec_id, embedding)`` to ``(vec_id, component, n, deviation, whitened, explained, identity_error)``."""
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).where(F.col("embedding").isNotNull() & finite)
    length = base.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None or not length["d"]:
        return spark.createDataFrame([], schema)
    d, n = length["d"], length["n"]
    base = base.where(F.size("embedding") == d)
    total = sums(base, d)
    near = [(2 * s + n) // (2 * n) for s in total]  # the mean, rounded
    rest = [s - n * m for s, m in zip(total, near)]
    whole_mean, part_mean = np.array(near, np.int64), np.array([r / n for r in rest])
    v = second_moments(base, "embedding", d, lambda c: (whole(c, d) - whole_mean) - part_mean) / n
    value, vectors = leading(v, components)
    k = len(value)
    if not k:
        return spark.createDataFrame([], schema)
    project = vectors / np.sqrt(value)

    def apply(batches):
        for b in batches:
            if b.num_rows:
                x = whole(b["embedding"], d)
                w = ((x - whole_mean) - part_mean) @ project
                yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(deviations(x, n, whole_mean, rest), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    out = cut(arrow_map(base, apply, "vec_id long, deviation long, w array<double>"))
    mean = np.array(out.select(*[F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in range(k)]).first())
    matrix = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), k) - mean
    error = float(np.abs(second_moments(out, "w", k, matrix) / n - np.eye(k)).max())
    share = F.array(*[F.lit(float(e / np.trace(v))) for e in value])
    return out.select("vec_id", F.posexplode("w").alias("i", "whitened"), "deviation").select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
