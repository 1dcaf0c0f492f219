"""Nearest polygons against exact geometry: dense and empty ground, many sides, holes and parts."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.operators import knn

from test_polygon_rules import wkt


def star(x, y, size, n, seed):
    r = random.Random(seed)
    pts = [(x + size * (0.4 + 0.6 * r.random()) * math.cos(2 * math.pi * i / n), y + size * (0.4 + 0.6 * r.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*pts, pts[0]]


def ring(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def frame(spark, shapes):
    rows = [(g, i, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in shape]) for g, i, shape in shapes]
    df = spark.createDataFrame(rows, f"survey_id long, id string, geom {G.GEOM}").repartition(5)
    return df.select("survey_id", "id", *knn.flat(F.col("geom")))


def test_nearest_polygons(spark, jts):
    r = random.Random(3)
    right = [(1, f"d{i}", [[star(r.gauss(0, 40), r.gauss(0, 40), 6, 7, i)]]) for i in range(60)]  # a crowd
    right += [(1, f"s{i}", [[star(r.uniform(-9e3, 9e3), r.uniform(-9e3, 9e3), 60, 9, i)]]) for i in range(40)]  # empty ground
    right += [(1, "frame", [[ring(2000, 2000, 400, 400), ring(2050, 2050, 300, 300)], [ring(2600, 2000, 5, 5)]]), (1, "long", [[star(-500, 300, 150, 900, 1)]]), (2, "one", [[ring(0, 0, 1, 1)]]), (2, "twin", [[ring(0, 0, 1, 1)]])]
    left = [(1, f"a{i}", [[star(r.gauss(0, 60), r.gauss(0, 60), 5, 6, i)]]) for i in range(25)] + [(1, f"b{i}", [[ring(r.uniform(-2e4, 2e4), r.uniform(-2e4, 2e4), 10, 20)]]) for i in range(25)]
    left += [(1, "inside", [[ring(2190, 2190, 10, 10)]]), (1, "many", [[star(-100, 900, 200, 700, 2)]]), (2, "far", [[ring(5e5, 5e5, 1, 1)]]), (3, "alone", [[ring(0, 0, 1, 1)]])]
    got = {}
    for x in knn.nearest_polygons(frame(spark, left), frame(spark, right), 5).collect():
        got.setdefault(x.id, []).append((x["rank"], x.r_id, x.distance_m, x.c))
    shapes = {i: jts.of(wkt(s)) for _, i, s in left + right}
    for g, i, _ in left:
        want = sorted((shapes[i].distance(shapes[k]), k) for h, k, _ in right if h == g)[:5]
        mine = sorted(got.get(i, []))
        assert [m[2] for m in mine] == pytest.approx([w[0] for w in want], abs=1e-6), i
        assert [m[1] for m in mine] == [w[1] for w in want] or len({round(w[0], 6) for w in want}) < len(want)
        for _, _, d, c in mine:
            assert d == 0 or math.hypot(c.ax - c.bx, c.ay - c.by) == pytest.approx(d, abs=1e-6)
    assert {m[1] for m in got["far"]} == {"one", "twin"} and "alone" not in got
    assert knn.nearest_polygons(frame(spark, left).limit(0), frame(spark, right), 5).count() == 0


def test_sides_of_a_batch_are_made_at_once(monkeypatch):
    """Rows of different sizes, with holes, of many sides, empty and null: as pair by pair, without an array for each row."""
    r = random.Random(12)
    shapes = [[star(r.uniform(0, 50), r.uniform(0, 50), 9, r.choice((3, 5, 5, 80)), i) for _ in range(r.randrange(4))] for i in range(300)]
    rows = [([x for p in s for x, _ in p], [y for p in s for _, y in p], [len(p) for p in s]) for s in shapes]
    half = rows[:150], rows[150:]
    want = []
    for a, b in zip(*half):
        a, b = (knn.sides_of(*g) for g in (a, b))
        want.append(None if not len(a) or not len(b) else knn.packed_connection(a, b) if len(a) * len(b) > knn.SMALL else knn.connections(a[None], b[None])[0])
    kinds = [pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32())]
    columns = [pa.array([*[g[i] for g in side], None], kinds[i]) for side in half for i in range(3)]
    monkeypatch.setattr(knn, "sides_of", None)
    got = knn._connect_batch(*columns).to_pylist()
    assert len(got) == 151 and got.pop()["d"] is None
    assert [g["d"] is None for g in got] == [w is None for w in want] and any(w is None for w in want)
    assert all(list(g.values()) == w.tolist() for g, w in zip(got, want) if w is not None)
    part = knn._connect_batch(*[c.slice(40, 30) for c in columns]).to_pylist()
    assert part == got[40:70] and len(knn._connect_batch(*[c.slice(0, 0) for c in columns])) == 0


def test_packed_sides_equal_all_pairs(jts):
    for seed in range(6):
        a, b = star(0, 0, 100, 150, seed), star(60 + 60 * seed, 20, 100, 170, seed + 50)
        flat = lambda p: knn.sides_of([x for x, _ in p], [y for _, y in p], [len(p)])
        want = jts.polygon(a).distance(jts.polygon(b))
        assert knn.packed_connection(flat(a), flat(b))[0] == pytest.approx(want, abs=1e-9)
        assert knn.connections(flat(a)[None], flat(b)[None])[0, 0] == pytest.approx(want, abs=1e-9)
    outer, hole, inner = ring(0, 0, 100, 100), ring(10, 10, 80, 80), ring(40, 40, 10, 10)
    holed = np.concatenate([knn.sides_of(*zip(*outer), [5]), knn.sides_of(*zip(*hole), [5])])
    assert knn.packed_connection(holed, knn.sides_of(*zip(*inner), [5]))[0] == 30
    assert knn.packed_connection(knn.sides_of(*zip(*outer), [5]), knn.sides_of(*zip(*inner), [5]))[0] == 0


def test_boxes_in_one_pass(spark):
    r = random.Random(8)
    box = lambda s: (r.gauss(0, s), r.gauss(0, s))
    rows = [(1, f"{i:03d}", x, y, x + r.random() * 9, y + r.random() * 9) for i in range(200) for x, y in [box(20 if i % 3 else 5000)]]
    df = spark.createDataFrame(rows, "survey_id long, id string, x0 double, y0 double, x1 double, y1 double")
    got = {(x.id, x["rank"]): (x.r_id, x.distance_m) for x in knn.knn_join(df, df, 4).collect()}
    for _, i, x0, y0, x1, y1 in rows:
        want = sorted((math.hypot(max(0, b[2] - x1, x0 - b[4]), max(0, b[3] - y1, y0 - b[5])), b[1]) for b in rows)[:4]
        assert [got[i, k + 1][0] for k in range(4)] == [w[1] for w in want]


def test_gaps_of_outlines(jts):
    """Directed gaps, with bounds and early stop, against every point and every side."""
    from groundsift.operators import agreement as AG

    for seed in range(5):
        a, b = star(0, 0, 100, 60 + seed, seed), star(3, 2, 100, 75, seed + 9)
        flat = lambda p: knn.sides_of([x for x, _ in p], [y for _, y in p], [len(p)])
        ring = jts.polygon(b).getBoundary()
        for step in (1e9, 1.0):
            points = AG.densified(flat(a), step)
            want = max(ring.distance(jts.of(f"POINT({x!r} {y!r})")) for x, y in points.tolist())
            assert AG.directed_gap(points, flat(b)) == pytest.approx(want, abs=1e-9)
        inner = AG.densified(flat(a), 1.0)
        assert np.hypot(*np.diff(inner, axis=0).T).max() <= 1 + 1e-9 and {tuple(p) for p in flat(a)[:, :2].tolist()} <= {tuple(p) for p in inner.tolist()}


def test_gaps_of_many_pairs_are_measured_at_once(monkeypatch):
    from groundsift.operators import agreement as AG

    rnd = random.Random(11)
    pairs = [[np.array([[rnd.uniform(0, 90) for _ in range(4)] for _ in range(rnd.randint(0, 9))]).reshape(-1, 4) for _ in "ab"] for _ in range(40)]
    alone = [AG.directed_gap(a[:, :2], b) if len(a) and len(b) else np.nan for a, b in pairs]
    count = [np.array([len(p[k]) for p in pairs]) for k in (0, 1)]
    (a, n), (b, m) = ((np.concatenate([p[k] for p in pairs]), count[k]) for k in (0, 1))
    for cells in (30, 1 << 19):
        monkeypatch.setattr(AG, "CELLS", cells)
        assert np.array_equal(AG.directed_gaps(a[:, :2], np.cumsum(n) - n, n, b, np.cumsum(m) - m, m), alone, equal_nan=True)
