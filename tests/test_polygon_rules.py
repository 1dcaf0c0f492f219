"""Validity and growth of polygons against exact geometry."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.operators import freespace as FS
from groundsift.operators import validity as V

GEOM = G.GEOM


def wkt(geom):
    part = lambda p: "(" + ",".join("(" + ",".join(f"{x!r} {y!r}" for x, y in r) + ")" for r in p) + ")"
    return "MULTIPOLYGON(" + ",".join(part(p) for p in geom) + ")"


def frame(spark, geoms):
    rows = [(i, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in g] if g is not None else None) for i, g in enumerate(geoms)]
    return spark.createDataFrame(rows, f"id long, geom {GEOM}").repartition(4)


def exact_reason(spark, geom):
    jvm = spark._jvm
    g = jvm.org.locationtech.jts.io.WKTReader().read(wkt(geom))
    error = jvm.org.locationtech.jts.operation.valid.IsValidOp(g).getValidationError()
    return error and error.getMessage()


NAMES = {None: {None}, "Self-intersection": {"self-intersection", "ring self-intersection"}, "Ring Self-intersection": {"self-intersection", "ring self-intersection"},
         "Hole lies outside shell": {"hole outside shell"}, "Holes are nested": {"nested holes"}, "Nested shells": {"nested shells"}, "Interior is disconnected": {"disconnected interior"},
         "Too few distinct points in geometry component": {"ring structure"}, "Duplicate Rings": {"self-intersection"}}


def test_small_random_polygons(spark):
    """Rings through few lattice points meet, touch, nest and cross in every way there is."""
    r = random.Random(5)

    def ring(size, n):
        pts = [(r.randrange(size), r.randrange(size)) for _ in range(n)]
        return [*pts, pts[0]]

    def box(size):
        x, y = r.randrange(size), r.randrange(size)
        w, h = r.randrange(1, 6), r.randrange(1, 6)
        return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]

    def diamond(size):
        x, y, d = r.randrange(size), r.randrange(size), r.randrange(1, 3)
        return [(x - d, y), (x, y - d), (x + d, y), (x, y + d), (x - d, y)]

    outer = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)]
    geoms = [[[ring(6, r.randrange(3, 7))]] for _ in range(150)]
    geoms += [[[outer, *[r.choice((box, diamond))(8) for _ in range(r.randrange(1, 4))]]] for _ in range(450)]
    geoms += [[[box(8), *([diamond(8)] if r.random() < 0.4 else [])], [r.choice((box, diamond))(8)]] for _ in range(200)]
    geoms += [[[outer, [(2, 2), (7, 2), (7, 7), (2, 7), (2, 2)]], [r.choice((box, diamond))(8)]] for _ in range(100)]
    geoms += [[[outer, [(1, 1), (8, 1), (8, 8), (1, 8), (1, 1)], r.choice((box, diamond))(8)]] for _ in range(60)]
    got = {x.id: x.reason for x in V.reasons(frame(spark, geoms)).collect()}
    seen, told = set(), {}
    for i, g in enumerate(geoms):
        want = exact_reason(spark, g)
        seen.add(want)
        # of several broken rules crossings come first here, but not always there
        assert got[i] in NAMES[want] | (NAMES["Self-intersection"] if want else set()), (g, want, got[i])
        told[want] = told.get(want, set()) | {got[i]}
    assert {None, "Self-intersection", "Hole lies outside shell", "Holes are nested", "Nested shells", "Interior is disconnected"} <= seen
    assert set(V.RULES[2:]) <= set().union(*told.values())


def test_odd_geometries(spark):
    good = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    twice = [(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4), (0, 0)]
    geoms = [None, [], [[]], [[good[:3]]], [[good[:-1]]], [[good]], [[twice]], [[[(0, 0), (math.inf, 0), (4, 4), (0, 0)]]], [[[(0, 0), (math.nan, 0), (4, 4), (0, 0)]]], [[[(1, 1)] * 5]], [[[(0, 0), (2, 0), (1, 0), (0, 0)]]]]
    got = {x.id: x.reason for x in V.reasons(frame(spark, geoms)).collect()}
    assert got == {0: "empty", 1: "empty", 2: "ring structure", 3: "ring structure", 4: "ring structure", 5: None, 6: None, 7: "ring structure", 8: "ring structure", 9: "ring structure", 10: "self-intersection"}
    assert V.reasons(frame(spark, [])).count() == 0


def test_small_geometries_stay_in_their_row(spark, monkeypatch):
    """No side of a small geometry is dealt to cells; row by row and cell by cell, the reasons are the same."""
    r = random.Random(8)
    box = lambda n: (lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)])(r.randrange(n), r.randrange(n), r.randrange(1, 6))
    loop = lambda: (lambda p: [*p, p[0]])([(r.randrange(5), r.randrange(5)) for _ in range(5)])
    geoms = [[[box(1), box(6)], [box(8)]] for _ in range(60)] + [[[box(3), box(5), box(7)]] for _ in range(60)] + [[[loop()]] for _ in range(60)]
    dealt, cells = [], V._cells

    def counted(sides, *rest):
        dealt.append(sides.count())
        return cells(sides, *rest)

    monkeypatch.setattr(V, "_cells", counted)
    rows = {x.id: x.reason for x in V.reasons(frame(spark, geoms)).collect()}
    assert len(dealt) == 2 and sum(dealt) == 0
    monkeypatch.setattr(V, "FEW", 0)
    assert {x.id: x.reason for x in V.reasons(frame(spark, geoms)).collect()} == rows
    assert sum(dealt) > 0 and set(V.RULES[2:4]) <= set(rows.values())


def test_crowded_corner_of_a_long_ring(spark):
    """Ten thousand sides, nearly all of them in one corner of the geometry's grid."""
    n = 10_000
    comb = [(i * 1e-3, (i % 2) * 1e-3 + 1) for i in range(n)]
    ring = [(0.0, 0.0), (1e4, 0.0), (1e4, 1.0), *reversed(comb), (0.0, 0.0)]
    bad = list(ring)
    bad[5000], bad[5003] = bad[5003], bad[5000]
    got = {x.id: x.reason for x in V.reasons(frame(spark, [[[ring]], [[bad]]])).collect()}
    assert got == {0: None, 1: "self-intersection"}


SHAPES = [
    [[[(0, 0), (50, 0), (50, 40), (30, 40), (30, 20), (0, 20), (0, 0)]]],
    [[[(0, 0), (0, 60), (60, 60), (60, 0), (0, 0)], [(20, 20), (40, 20), (40, 40), (20, 40), (20, 20)]]],
    [[[(0, 0), (60, 0), (60, 60), (0, 60), (0, 0)], [(25, 25), (25, 31), (31, 31), (25, 25)]], [[(64, 0), (90, 5), (70, 30), (64, 0)]]],
    [[[(0, 0), (50, 3), (12, 9), (47, 17), (-4, 22), (0, 0)]]],
    [[[(0, 0), (0, 0), (30, 0), (30, 0), (30, 30), (0, 30), (0, 0)]]],
]


@pytest.mark.parametrize("distance", [0.5, 3.0, 10.0])
def test_grown_polygons(spark, jts, distance):
    df = frame(spark, SHAPES).select("id", G.grown(F.col("geom"), distance).alias("g"))
    pieces = FS.covered_pieces(df.select("id", *FS.flat_geometry(F.col("g"))), ["id"], winding=True)
    got = {r.id: r.area for r in pieces.groupBy("id").agg(F.sum(G.piece_area()).alias("area")).collect()}
    for i, g in enumerate(SHAPES):
        exact = jts.of(wkt(g)).buffer(distance, 400).getArea()
        assert got[i] == pytest.approx(exact, rel=0.002) and got[i] <= exact * (1 + 1e-6)
    square = frame(spark, SHAPES[4:]).select("id", G.grown(F.col("geom"), distance, join="mitre").alias("g"))
    flat = FS.covered_pieces(square.select("id", *FS.flat_geometry(F.col("g"))), ["id"], winding=True)
    assert flat.agg(F.sum(G.piece_area())).first()[0] == pytest.approx((30 + 2 * distance) ** 2)


@pytest.mark.parametrize("join", ["round", "mitre"])
def test_curves_of_a_batch_are_those_of_each_row(spark, join):
    from groundsift.session import ship_package

    ship_package(spark)
    shapes = [*SHAPES, [[[(0, 0), (1, 1), (0, 0)]]], [[[(0, 0), (0, 40), (30, 40), (30, 0), (0, 0)], [(5, 5), (9, 5), (9, 9), (5, 9), (5, 5)]]]]
    df = frame(spark, shapes)
    want = {r.id: r for r in df.select("id", *FS.flat_geometry(G.grown(F.col("geom"), 3.0, join=join))).collect()}
    got = {r.id: r.g for r in df.select("id", FS.grown_curves(3.0, join)(*FS.flat_geometry(F.col("geom")), FS.shells(F.col("geom"))).alias("g")).collect()}
    for i, w in want.items():
        assert list(got[i].sizes) == list(w.sizes)
        assert got[i].xs == pytest.approx(w.xs, abs=1e-9) and got[i].ys == pytest.approx(w.ys, abs=1e-9)


def test_ground_left_with_clearance(spark, jts):
    """Free ground of a window and the number of its gaps, when polygons with holes, notches and parts grow by a clearance."""
    shapes = [[[[(x * 1.0 + dx, y + dy) for x, y in r] for r in p] for p in g] for k, g in enumerate(SHAPES) for dx, dy in ((100 + 90 * k, 120), (480 - 60 * k, 470), (505, 230 + 55 * k))]
    window = spark.createDataFrame([(1, 50.0, 60.0, 650.0, 640.0)], "survey_id long, wx0 double, wy0 double, wx1 double, wy1 double")
    occupied = FS.grown_polygons(frame(spark, shapes).select(F.lit(1).cast("long").alias("survey_id"), "geom"), 5.0)
    got = FS.gap_figures(FS.free_pieces(window, occupied, winding=True), window).collect()
    union = jts.of(wkt(shapes[0])).buffer(5.0, 16)
    for g in shapes[1:]:
        union = union.union(jts.of(wkt(g)).buffer(5.0, 16))
    left = jts.polygon([(50, 60), (650, 60), (650, 640), (50, 640), (50, 60)]).difference(union)
    want = sorted(left.getGeometryN(i).getArea() for i in range(left.getNumGeometries()))
    assert sorted(r.area for r in got) == pytest.approx(want, rel=2e-4)


def test_clipped_polygons(spark, jts):
    """Windows through spiky polygons with a hole: area, outline, parts and holes of what lies inside."""
    from groundsift.operators import clipping as CL

    r = random.Random(12)
    rows, want = [], {}
    for i in range(24):
        n = r.randrange(7, 14)
        radius = [100 * (0.45 + 0.55 * r.random()) for _ in range(n)]
        shell = [(round(radius[k] * math.cos(2 * math.pi * k / n), 3), round(radius[k] * math.sin(2 * math.pi * k / n), 3)) for k in range(n)]
        hole = [(-20.0, -11.0), (5.0, 17.0), (18.0, -9.0), (-20.0, -11.0)]
        geom = [[[*shell, shell[0]], hole]]
        x, y = round(r.uniform(-90, 30), 2), round(r.uniform(-90, 30), 2)
        window = (x, y, x + round(r.uniform(20, 120), 2), y + round(r.uniform(20, 120), 2))
        rows.append((1, f"g{i}", [[[{"x": a, "y": b} for a, b in q] for q in p] for p in geom], *window))
        a, b, c, d = window
        cut = jts.of(wkt(geom)).intersection(jts.polygon([(a, b), (c, b), (c, d), (a, d), (a, b)]))
        parts = [cut.getGeometryN(k) for k in range(cut.getNumGeometries())]
        if cut.getArea() > 0:
            want[f"g{i}"] = (cut.getArea(), len(parts), sum(p.getNumInteriorRing() for p in parts))
    df = spark.createDataFrame(rows, f"survey_id long, id string, geom {GEOM}, bx0 double, by0 double, bx1 double, by1 double")
    got = {x.id: x for x in CL.clipped_figures(df.select("survey_id", "id", *FS.flat_geometry(F.col("geom")), *CL.WINDOW)).collect()}
    assert set(got) == set(want) and {w[1] for w in want.values()} > {1} and {w[2] for w in want.values()} == {0, 1}
    for k, (area, parts, holes) in want.items():
        assert (got[k].parts, got[k].holes) == (parts, holes) and got[k].area_m2 == pytest.approx(area, abs=1e-3), k


def test_pieces_are_cut_once_and_sides_are_numbered(spark):
    """Outlines read their pieces six times; what makes them runs once a row, and a side's name is a number."""
    from groundsift.operators import outlines

    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    box = spark.createDataFrame([(1, "g", 0.0, 10.0, 0.0, 0.0, 10.0, 10.0, -5.0, 15.0)], "survey_id long, gap string, y0 double, y1 double, xl0 double, xl1 double, xr0 double, xr1 double, bx0 double, bx1 double")
    linked = outlines.link_rings(outlines.boundary_sides(box.mapInPandas(count, box.schema)))
    assert dict(linked.dtypes)["ring"] == "bigint"
    assert [(r["area"], r["length"], r["sides"]) for r in outlines.ring_figures(linked).collect()] == [(100.0, 40.0, 4)]
    assert runs.value == 1
