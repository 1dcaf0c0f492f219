"""Polygon tier and free space against exact geometry."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.operators import freespace as FS
from groundsift.operators import pairs, slabs
from groundsift.operators.plots import feasible_squares, pick_plots, square_pieces
from groundsift.operators.tiles import box_pieces


def shapes(seed, n, size=1000.0):
    """Random triangles, L-shapes, turned squares and boxes with holes, as lists of closed rings."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        x, y, s = rnd.uniform(-50, size), rnd.uniform(-50, size), rnd.uniform(30, 260)
        if i % 4 == 0:
            out.append([[(x, y), (x + s, y + s / 3), (x + s / 4, y + s), (x, y)]])
        elif i % 4 == 1:
            out.append([[(x, y), (x + s, y), (x + s, y + s / 2), (x + s / 2, y + s / 2), (x + s / 2, y + s), (x, y + s), (x, y)]])
        elif i % 4 == 2:
            a = rnd.uniform(0, math.pi / 2)
            c = [(x + s / 2 * math.cos(a + k * math.pi / 2), y + s / 2 * math.sin(a + k * math.pi / 2)) for k in range(4)]
            out.append([c + c[:1]])
        else:
            h = s / 4
            out.append([[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)], [(x + h, y + h), (x + h, y + 2 * h), (x + 2 * h, y + 2 * h), (x + 2 * h, y + h), (x + h, y + h)]])
    return out


def rows(items, survey=1):
    out = []
    for rings in items:
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        out.append((survey, min(xs), min(ys), max(xs), max(ys), xs, ys, [len(r) for r in rings]))
    return out


SCHEMA = "survey_id long, x0 double, y0 double, x1 double, y1 double, xs array<double>, ys array<double>, sizes array<int>"
WINDOW = "survey_id long, wx0 double, wy0 double, wx1 double, wy1 double"


def free_parts(jts, items, size):
    g = jts.of(f"POLYGON((0 0,{size} 0,{size} {size},0 {size},0 0))")
    for rings in items:
        g = g.difference(jts.polygon(*rings))
    return [p for p in (g.getGeometryN(i) for i in range(g.getNumGeometries())) if p.getArea() > 1e-6]


def test_cover_equals_polygon_area(jts):
    for rings in shapes(3, 24):
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        e = slabs.ring_edges(xs, ys, [len(r) for r in rings])
        got = sum(((p[4] - p[2]) + (p[5] - p[3])) / 2 * (p[1] - p[0]) for p in slabs.cover(*e, np.zeros(len(e[0]), int)))
        assert got == pytest.approx(jts.polygon(*rings).getArea(), rel=1e-9)


def test_sides_meet_only_where_their_heights_do(monkeypatch):
    rnd = random.Random(8)
    x1, y1, x2 = (np.array([rnd.uniform(0, 50) for _ in range(300)]) for _ in range(3))
    y2 = y1 + np.array([rnd.uniform(0.1, 3) for _ in range(300)])
    want = set()
    for i in range(300):
        for j in range(i):
            a, b = (x2[i] - x1[i]) / (y2[i] - y1[i]), (x2[j] - x1[j]) / (y2[j] - y1[j])
            y = ((x1[j] - b * y1[j]) - (x1[i] - a * y1[i])) / (a - b)
            if max(y1[i], y1[j], 5) < y < min(y2[i], y2[j], 45):
                want.add(y)
    pairs_made, spans = [], slabs._spans
    monkeypatch.setattr(slabs, "TABLE", 500)
    monkeypatch.setattr(slabs, "_spans", lambda *a: pairs_made.append(spans(*a)) or pairs_made[-1])
    assert sorted(slabs._crossing_heights(x1, y1, x2, y2, 5, 45)) == pytest.approx(sorted(want))
    assert sum(len(p[0]) for p in pairs_made) < 300 * 300 / 8


@pytest.mark.parametrize("winding", [False, True])
def test_many_polygons_are_cut_at_once(winding):
    rnd, edges, signs = random.Random(3), [], []
    for _ in range(60):
        xs, ys, sizes = [], [], []
        for _ in range(rnd.randint(1, 4)):
            ring = [(rnd.choice([rnd.randint(0, 60), rnd.uniform(0, 60)]), rnd.randint(0, 60)) for _ in range(rnd.randint(3, 12))]
            xs, ys, sizes = xs + [x for x, _ in ring + ring[:1]], ys + [y for _, y in ring + ring[:1]], [*sizes, len(ring) + 1]
        edges.append(slabs.ring_edges(xs, ys, sizes))
        signs.append(slabs.ring_signs(ys, sizes))
    poly = np.repeat(np.arange(60), [len(e[0]) for e in edges])
    of, pieces = slabs.cover_many(*map(np.concatenate, zip(*edges)), poly, np.concatenate(signs) if winding else None)
    for k, (e, s) in enumerate(zip(edges, signs)):
        one = slabs.cover(*e, np.zeros(len(e[0]), int), s if winding else None)
        assert np.array_equal(pieces[of == k], np.array(one).reshape(-1, 6))


def test_slabs_are_sorted_at_once(monkeypatch):
    """A circle of seventy sides: sides are sorted for all its slabs together, not once for each slab."""
    turns = np.linspace(0, 2 * math.pi, 71)
    xs, ys = 50 * np.cos(turns), 50 * np.sin(turns)
    xs[-1], ys[-1] = xs[0], ys[0]
    e, sign, sorts, lexsort = slabs.ring_edges(xs, ys, [71]), slabs.ring_signs(ys, [71]), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(1) or lexsort(keys))
    pieces = slabs.cover(*e, np.zeros(len(e[0]), int), sign)
    assert len(sorts) <= 3
    want = 70 / 2 * 50**2 * math.sin(2 * math.pi / 70)
    assert sum(((p[4] - p[2]) + (p[5] - p[3])) / 2 * (p[1] - p[0]) for p in pieces) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("seed,n,width", [(1, 40, 40.0), (2, 70, 25.0)])
def test_gaps_match_exact_difference(spark, jts, seed, n, width):
    size = 1000.0
    items = shapes(seed, n)
    windows = spark.createDataFrame([(1, 0.0, 0.0, size, size)], WINDOW)
    occ = spark.createDataFrame(rows(items), SCHEMA)
    pieces = FS.free_pieces(windows, occ, width, side=300.0)
    got = FS.settle_width(pieces, FS.gap_figures(pieces, windows), windows, occ, width, side=300.0).collect()
    want = free_parts(jts, items, size)
    assert sorted(round(r["area"], 4) for r in got) == pytest.approx(sorted(round(p.getArea(), 4) for p in want), abs=1e-3)
    by_area = {round(p.getArea(), 2): p for p in want}
    for r in got:
        p = by_area[round(r["area"], 2)]
        assert r["cx"] == pytest.approx(p.getCentroid().getX(), abs=1e-5) and r["cy"] == pytest.approx(p.getCentroid().getY(), abs=1e-5)
        narrower, wider = p.buffer(-width / 2 * 1.01, 64).isEmpty(), p.buffer(-width / 2 * 0.99, 64).isEmpty()
        if narrower == wider:  # not a tie
            assert r["wide"] == (not narrower)
        assert r["touches_boundary"] == (p.distance(jts.of(f"LINEARRING(0 0,{size} 0,{size} {size},0 {size},0 0)")) < 0.1)


def test_crowded_tile_is_cut_finer_and_copies_collapse(spark, jts):
    rnd = random.Random(5)
    items = [[[(x, y), (x + 3, y), (x + 3, y + 3), (x, y + 3), (x, y)]] for x, y in ((rnd.uniform(0, 95), rnd.uniform(0, 95)) for _ in range(900))]
    data = rows(items) + rows(items[:1] * 450)  # one geometry holds a third of all rows
    windows = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0)], WINDOW)
    occ = spark.createDataFrame(data, SCHEMA)
    assert FS.tile_objects(windows, occ, 0.0, 500.0).agg(F.max("lv")).first()[0] >= 1
    pieces = FS.free_pieces(windows, occ, side=500.0)
    got = FS.gap_figures(pieces, windows).collect()
    want = free_parts(jts, items, 100.0)
    assert len(got) == len(want)
    assert sum(r["area"] for r in got) == pytest.approx(sum(p.getArea() for p in want), rel=1e-9)
    total = FS.union_area(occ, ["survey_id"], side=50.0).first()["union_area_m2"]
    assert total == pytest.approx(10000 - sum(p.getArea() for p in free_parts(jts, items, 100.0)), rel=1e-9)


def test_piece_overlap_matches_exact(spark, jts):
    rnd = random.Random(9)

    def piece():
        y0, h = rnd.uniform(0, 20), rnd.uniform(1, 20)
        a, b, c, d = (rnd.uniform(0, 30) for _ in range(4))
        return (y0, y0 + h, min(a, b), min(c, d), max(a, b), max(c, d))

    data = [(i, piece(), piece()) for i in range(60)]
    df = spark.createDataFrame(data, f"i int, a {G.PIECE_T}, b {G.PIECE_T}").select("i", G.piece_overlap(F.col("a"), F.col("b")).alias("v"))
    ring = lambda p: [(p[2], p[0]), (p[4], p[0]), (p[5], p[1]), (p[3], p[1]), (p[2], p[0])]
    for r in df.collect():
        _, a, b = data[r["i"]]
        assert r["v"] == pytest.approx(jts.polygon(ring(a)).intersection(jts.polygon(ring(b))).getArea(), abs=1e-7)


def geom_rows(spark, items):
    data = [(i, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]]) for i, rings in enumerate(items)]
    return spark.createDataFrame(data, f"i int, g {G.GEOM}")


def test_measures_clip_distance_and_validity(spark, jts):
    items = shapes(11, 16, 300.0)
    df = geom_rows(spark, items)
    lit = lambda v: F.lit(float(v))
    clip = G.clip_ring(F.get(F.get(F.col("g"), F.lit(0)), F.lit(0)), lit(50), lit(50), lit(220), lit(220))
    out = df.select("i", G.area(F.col("g")).alias("a"), G.perimeter(F.col("g")).alias("p"), G.centroid(F.col("g")).alias("c"), G.invalid_reason(F.col("g")).alias("bad"), F.abs(G.ring_area(clip)).alias("k")).collect()
    window = jts.of("POLYGON((50 50,220 50,220 220,50 220,50 50))")
    for r in out:
        g = jts.polygon(*items[r["i"]])
        assert r["a"] == pytest.approx(g.getArea(), rel=1e-9) and r["p"] == pytest.approx(g.getLength(), rel=1e-9)
        assert r["c"]["x"] == pytest.approx(g.getCentroid().getX(), abs=1e-6) and r["bad"] is None
        assert (r["k"] or 0.0) == pytest.approx(jts.polygon(items[r["i"]][0]).intersection(window).getArea(), abs=1e-6)
    two = df.alias("l").join(df.alias("r"), F.col("l.i") < F.col("r.i")).select(F.col("l.i").alias("a"), F.col("r.i").alias("b"), pairs.connect(F.col("l.g"), F.col("r.g")).alias("s")).collect()
    for r in two:
        d = jts.polygon(*items[r["a"]]).distance(jts.polygon(*items[r["b"]]))
        assert r["s"]["d"] == pytest.approx(d, abs=1e-7)
        if d > 0:
            assert math.hypot(r["s"]["ax"] - r["s"]["bx"], r["s"]["ay"] - r["s"]["by"]) == pytest.approx(d, abs=1e-7)


def test_invalid_outlines_are_named(spark, jts):
    cases = [
        ([[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]], "self-intersection"),
        ([[(0, 0), (4, 0), (4, 4), (0, 4)]], "ring structure"),
        ([[(0, 0), (4, 0), (0, 0)]], "ring structure"),
        ([[(0, 0), (4, 0), (8, 0), (0, 0)]], "self-intersection"),
        ([[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(9, 9), (9, 10), (10, 10), (9, 9)]], "hole outside shell"),
        ([[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]], None),
    ]
    got = {r["i"]: r["bad"] for r in geom_rows(spark, [c[0] for c in cases]).select("i", G.invalid_reason(F.col("g")).alias("bad")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_laea_keeps_area_and_returns(spark):
    # a small cell of the ellipsoid against its own closed-form area
    lat, lon, d = 44.95, 34.1, 0.001
    q = lambda p: (1 - G.WGS_E2) * (math.sin(p) / (1 - G.WGS_E2 * math.sin(p) ** 2) - math.log((1 - G.WGS_E * math.sin(p)) / (1 + G.WGS_E * math.sin(p))) / (2 * G.WGS_E))
    exact = G.WGS_A**2 / 2 * math.radians(d) * (q(math.radians(lat + d)) - q(math.radians(lat)))
    ring = [(lon, lat), (lon + d, lat), (lon + d, lat + d), (lon, lat + d), (lon, lat)]
    df = geom_rows(spark, [[ring]])
    metric = G.map_points(F.col("g"), lambda x, y: G.laea(x, y, 34.1, 45.0))
    back = G.map_points(metric, lambda x, y: G.laea_inverse(x, y, 34.1, 45.0))
    r = df.select(G.area(metric).alias("a"), F.get(F.get(F.get(back, F.lit(0)), F.lit(0)), F.lit(2)).alias("p")).first()
    assert r["a"] == pytest.approx(exact, rel=1e-6)
    assert r["p"]["x"] == pytest.approx(lon + d, abs=1e-9) and r["p"]["y"] == pytest.approx(lat + d, abs=1e-9)


def test_turned_squares_have_their_area(spark):
    df = spark.range(90).select(F.col("id"), F.explode(square_pieces(F.lit(5.0), F.lit(7.0), F.lit(4.0), F.col("id"))).alias("p"))
    a = df.select("id", G.piece_area(F.col("p")).alias("a")).groupBy("id").agg(F.sum("a").alias("a")).collect()
    assert all(r["a"] == pytest.approx(16.0, rel=1e-9) for r in a) and len(a) == 90


def test_plots_lie_in_their_gap_and_apart(spark, jts):
    size, side = 400.0, 20.0
    items = shapes(21, 14, size)
    windows = spark.createDataFrame([(1, 0.0, 0.0, size, size)], WINDOW)
    occ = spark.createDataFrame(rows(items), SCHEMA)
    excl = spark.createDataFrame([(1, "e", 100.0, 100.0, 260.0, 260.0)], "survey_id long, id string, x0 double, y0 double, x1 double, y1 double")
    pieces = FS.free_pieces(windows, occ, side, side=150.0)
    gaps = FS.gap_figures(pieces, windows)
    squares = feasible_squares(pieces, gaps.select("survey_id", "gap", "x0", "y0", "x1", "y1"), windows, occ, box_pieces(excl).select("survey_id", "id", *G.PIECE), side)
    chosen = pick_plots(squares, side, gaps.select("survey_id", "gap", F.lit(3).alias("quota"))).collect()
    free = free_parts(jts, items, size)
    block = jts.of("POLYGON((100 100,260 100,260 260,100 260,100 100))")

    def outline(r):
        a, h = math.radians(r["angle"]), side / 2
        c = [(r["cx"] + dx * h * math.cos(a) - dy * h * math.sin(a), r["cy"] + dx * h * math.sin(a) + dy * h * math.cos(a)) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        return jts.polygon(c + c[:1])

    shapes_ = [outline(r) for r in chosen]
    assert chosen and max(sum(1 for r in chosen if r["gap"] == g) for g in {r["gap"] for r in chosen}) <= 3
    for i, s in enumerate(shapes_):
        assert max(p.intersection(s).getArea() for p in free) == pytest.approx(side * side, rel=1e-6)
        assert s.intersection(block).getArea() <= 0.01
        assert all(s.intersection(o).getArea() < 1e-6 for o in shapes_[:i])
    # the first plot of every gap is the least feasible square, found by brute force over all squares
    every = squares.collect()
    for r in chosen:
        if r["turn"] == 1:
            least = min((q["row"], q["col"], q["angle"]) for q in every if q["gap"] == r["gap"])
            first = next(q for q in every if q["gap"] == r["gap"] and (q["row"], q["col"], q["angle"]) == least)
            assert (first["cx"], first["cy"], first["angle"]) == (r["cx"], r["cy"], r["angle"])


@pytest.mark.parametrize("quota", [1, 3])
def test_squares_out_of_reach_of_a_quota_are_not_made(spark, quota):
    size, side = 1000.0, 20.0
    windows = spark.createDataFrame([(1, 0.0, 0.0, size, size)], WINDOW)
    occ = spark.createDataFrame(rows(shapes(5, 6, size)), SCHEMA)
    excl = spark.createDataFrame([(1, "e", 0.0, 0.0, 420.0, 90.0), (1, "f", 300.0, 400.0, 610.0, 770.0)], "survey_id long, id string, x0 double, y0 double, x1 double, y1 double")
    pieces = FS.free_pieces(windows, occ, side)
    gaps = FS.gap_figures(pieces, windows)
    quotas = gaps.select("survey_id", "gap", F.lit(quota).alias("quota"))
    args = pieces, gaps.select("survey_id", "gap", "x0", "y0", "x1", "y1"), windows, occ, box_pieces(excl).select("survey_id", "id", *G.PIECE), side
    every, few = feasible_squares(*args), feasible_squares(*args, quotas)
    picked = [sorted(map(tuple, pick_plots(squares, side, quotas).collect())) for squares in (every, few)]
    assert picked[0] == picked[1] and picked[0]
    assert few.count() < every.count() / 4


def test_outlines_rebuild_the_exact_difference(spark, jts):
    from groundsift.operators import outlines as O

    size, items = 1000.0, shapes(4, 45)
    windows = spark.createDataFrame([(1, 0.0, 0.0, size, size)], WINDOW)
    pieces = FS.free_pieces(windows, spark.createDataFrame(rows(items), SCHEMA), side=300.0)
    rings = {}
    for r in O.ring_vertices(O.link_rings(O.boundary_sides(pieces))).collect():
        rings.setdefault((r["gap"], r["ring"]), []).append((r["ord"], r["x"], r["y"]))
    gaps = {}
    for (gap, _), pts in rings.items():
        ring = [(x, y) for _, x, y in sorted(pts)]
        poly = jts.polygon(ring + ring[:1])
        assert poly.isSimple()
        turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))
        gaps.setdefault(gap, []).append((turn, poly))
    want = sorted(free_parts(jts, items, size), key=lambda p: p.getArea())
    got = []
    for parts in gaps.values():
        shell = [p for turn, p in parts if turn > 0]
        assert len(shell) == 1  # one shell, everything else holes
        g = shell[0]
        for turn, p in parts:
            if turn < 0:
                g = g.difference(p)
        got.append(g)
    got.sort(key=lambda p: p.getArea())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a.symDifference(b).getArea() == pytest.approx(0, abs=1e-2)
