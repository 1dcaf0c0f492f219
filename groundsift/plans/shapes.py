"""G-series, access evidence and agreement of two outlines."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.operators import agreement as AG
from groundsift.operators import clipping as CL
from groundsift.operators import freespace as FS
from groundsift.operators import pairs
from groundsift.operators import validity as V
from groundsift.operators.knn import connected, knn_join, nearest_polygons
from groundsift.operators.plots import square_pieces
from groundsift.operators.tiles import TILE_M, box_pieces, distance_join, explode_tiles, piece_join, tile_join
from groundsift.plans.feeds import box_of
from groundsift.plans.joins import _NOTCHED, BOX, candidates, notched, road_parcels
from groundsift.registry import query
from groundsift.session import spread, unsent


def cx0():
    return F.col("x0")


def cy0():
    return F.col("y0")


def cx1():
    return F.col("x1")


def cy1():
    return F.col("y1")


def cxm():
    return (F.col("x0") + F.col("x1")) / 2


def cym():
    return (F.col("y0") + F.col("y1")) / 2


def l_shape():
    """Box without its upper right quarter."""
    ring = F.array(G.point(cx0(), cy0()), G.point(cx1(), cy0()), G.point(cx1(), cym()), G.point(cxm(), cym()), G.point(cxm(), cy1()), G.point(cx0(), cy1()), G.point(cx0(), cy0()))
    return F.array(F.array(ring))


def framed():
    """Box with a square hole in its middle and a second part beside it."""
    hole = F.array(G.point(cx0() + 10, cy0() + 10), G.point(cx0() + 10, cy0() + 20), G.point(cx0() + 20, cy0() + 20), G.point(cx0() + 20, cy0() + 10), G.point(cx0() + 10, cy0() + 10))
    return F.array(F.array(G.box_ring(cx0(), cy0(), cx1(), cy1()), hole), F.array(G.box_ring(cx1() + 5, cy0(), cx1() + 15, cy0() + 10)))


def lon_lat():
    return F.lit(33.5) + (F.col("p_partkey") % 1000) / 1000.0, F.lit(44.5) + (F.col("p_partkey") % 700) / 1000.0


@query("g01_projections", """
SELECT p_partkey, round(6378137.0 * radians(33.5 + (p_partkey % 1000) / 1000.0), 3) AS mx, round(6378137.0 * ln(tan(radians(44.5 + (p_partkey % 700) / 1000.0) / 2 + pi() / 4)), 3) AS my, true AS mercator_back, true AS laea_back FROM part""")
def projections(t):
    lon, lat = lon_lat()
    mx, my = G.mercator(lon, lat)
    blon, blat = G.mercator_inverse(mx, my)
    lx, ly = G.laea(lon, lat, 34.0, 45.0)
    clon, clat = G.laea_inverse(lx, ly, 34.0, 45.0)
    near = lambda a, b: F.abs(a - b) < 1e-9
    return t("part").select("p_partkey", F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"), (near(lon, blon) & near(lat, blat)).alias("mercator_back"),
                            ((F.abs(lon - clon) < 1e-8) & (F.abs(lat - clat) < 1e-8)).alias("laea_back"))


@query("g02_window_centre", "SELECT survey_id, (wx0 + wx1) / 2 AS cx, (wy0 + wy1) / 2 AS cy FROM surveys")
def window_centre(t):
    return t("surveys").select("survey_id", ((F.col("wx0") + F.col("wx1")) / 2).alias("cx"), ((F.col("wy0") + F.col("wy1")) / 2).alias("cy"))


@query("g03_parts", "SELECT id, CAST(p AS INTEGER) AS part, CASE p WHEN 0 THEN 2 ELSE 1 END AS rings, round(CASE p WHEN 0 THEN (x1 - x0) * (y1 - y0) - 100 ELSE 100 END, 2) AS area_m2 FROM parcels, range(2) r(p)")
def parts(t):
    p = t("parcels").select("id", F.posexplode(framed()).alias("part", "g"))
    return p.select("id", "part", F.size("g").alias("rings"), F.round(G.part_area(F.col("g")), 2).alias("area_m2"))


@query("g04_area_and_length", "SELECT id, round((x1 - x0) * (y1 - y0) * 0.75, 2) AS area_m2, round(2 * (x1 - x0 + y1 - y0), 2) AS perimeter_m FROM parcels")
def area_and_length(t):
    return t("parcels").select("id", F.round(G.area(l_shape()), 2).alias("area_m2"), F.round(G.perimeter(l_shape()), 2).alias("perimeter_m"))


@query("g05_centroid", "SELECT id, round(x0 + (x1 - x0) * 5.0 / 12, 4) AS cx, round(y0 + (y1 - y0) * 5.0 / 12, 4) AS cy FROM parcels")
def centroids(t):
    c = t("parcels").select("id", G.centroid(l_shape()).alias("c"))
    return c.select("id", F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"))


@query("g05_interior_point", "SELECT id, true AS inside FROM parcels")
def interior_point(t):
    """Middle of the largest piece: always strictly inside."""
    shapes = spread(t("parcels").select("id", *BOX), "id").select("id", *FS.flat_geometry(l_shape()))
    pieces = FS.covered_pieces(shapes, ["id"])
    mid = F.struct(G.piece_area().alias("a"), ((F.col("xl0") + F.col("xl1") + F.col("xr0") + F.col("xr1")) / 4).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    best = pieces.select("id", mid.alias("m"))
    g = best.groupBy("id").agg(F.max("m").alias("m"))
    back = g.join(unsent(t("parcels").select("id", *BOX)), "id").withColumn("shape", l_shape())
    return back.select("id", pairs.holds_point(F.col("shape"), F.col("m")).alias("inside"))


@query("g06_polygon_overlap", """
WITH l AS (SELECT survey_id, id, x0, y0, x1, (y0 + y1) / 2 AS y1 FROM parcels UNION ALL SELECT survey_id, id, x0, (y0 + y1) / 2, (x0 + x1) / 2, y1 FROM parcels)
SELECT l.survey_id, l.id, z.id AS zone_id, round(sum((least(l.x1, z.x1) - greatest(l.x0, z.x0)) * (least(l.y1, z.y1) - greatest(l.y0, z.y0))), 2) AS area_m2
FROM l JOIN zones z ON l.survey_id = z.survey_id AND l.x0 < z.x1 AND z.x0 < l.x1 AND l.y0 < z.y1 AND z.y0 < l.y1 GROUP BY l.survey_id, l.id, z.id""")
def polygon_overlap(t):
    """Polygon tier: L-shapes are cut to pieces, then joined like everything else."""
    shapes = FS.covered_pieces(spread(t("parcels").select("survey_id", "id", *BOX), "id").select("survey_id", "id", *FS.flat_geometry(l_shape())), ["survey_id", "id"])
    hits = piece_join(shapes, box_pieces(t("zones")).select("survey_id", "id", *G.PIECE), ["id"], ["id"])
    return hits.select("survey_id", "id", F.col("r_id").alias("zone_id"), F.round("area_m2", 2).alias("area_m2"))


@query("g06_rotated_overlap")
def rotated_overlap(t):
    """Squares turned by 30 degrees against zones."""
    sq = t("buildings").select("survey_id", "id", F.explode(square_pieces(cxm(), cym(), F.lit(40.0), F.lit(30))).alias("q")).select("survey_id", "id", "q.*")
    return (piece_join(sq, box_pieces(t("zones")).select("survey_id", "id", *G.PIECE), ["id"], ["id"])
            .select("survey_id", "id", F.col("r_id").alias("zone_id"), F.round("area_m2", 3).alias("area_m2")))


@query("g07_covers", """
WITH l AS (SELECT survey_id, id, x0, y0, x1, y1 FROM parcels)
SELECT l.survey_id, l.id, z.id AS zone_id FROM l JOIN zones z ON l.survey_id = z.survey_id AND z.x0 <= l.x0 AND z.y0 <= l.y0 AND z.x1 >= l.x1 AND z.y1 >= l.y1""")
def covers(t):
    """A zone covers an L-shape when the common area is all of it."""
    shapes = FS.covered_pieces(spread(t("parcels").select("survey_id", "id", *BOX), "id").select("survey_id", "id", *FS.flat_geometry(l_shape())), ["survey_id", "id"])
    own = t("parcels").select("id", G.area(l_shape()).alias("own"))
    hits = piece_join(shapes, box_pieces(t("zones")).select("survey_id", "id", *G.PIECE), ["id"], ["id"])
    return hits.join(own, "id").where(F.col("area_m2") >= F.col("own") * (1 - 1e-9)).select("survey_id", "id", F.col("r_id").alias("zone_id"))


@query("g08_polygon_distance", """
WITH b AS (SELECT b.survey_id, b.id, p.id AS parcel_id, least(
  sqrt(power(greatest(0, b.x0 - p.x1, p.x0 - b.x1), 2) + power(greatest(0, b.y0 - (p.y0 + p.y1) / 2, p.y0 - b.y1), 2)),
  sqrt(power(greatest(0, b.x0 - (p.x0 + p.x1) / 2, p.x0 - b.x1), 2) + power(greatest(0, b.y0 - p.y1, (p.y0 + p.y1) / 2 - b.y1), 2))) AS d,
  sqrt(power(greatest(0, b.x0 - p.x1, p.x0 - b.x1), 2) + power(greatest(0, b.y0 - p.y1, p.y0 - b.y1), 2)) AS bd
  FROM buildings b JOIN parcels p ON b.survey_id = p.survey_id)
SELECT survey_id, id, parcel_id, round(d, 3) AS distance_m FROM b WHERE d <= 15""")
def polygon_distance(t):
    """Distance to L-shapes; boxes only preselect."""
    b = t("buildings").select("survey_id", "id", *BOX, *FS.box_flat())
    near = connected(distance_join(b, notched(t("parcels")), 15.0).drop("distance_m")).where("c.d <= 15")
    return near.select("survey_id", "id", F.col("r_id").alias("parcel_id"), F.round("c.d", 3).alias("distance_m"))


@query("g18_polygon_connections", f"""
WITH d AS (SELECT a.id, b.id AS parcel_id, {_NOTCHED} AS d FROM parcels a JOIN parcels b ON a.survey_id = b.survey_id AND a.id <> b.id AND b.p_type = 'PROMO'),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, parcel_id) AS n FROM d)
SELECT id, parcel_id, round(d, 3) AS length_m, true AS starts_on_own, true AS ends_on_other FROM r WHERE n = 1""")
def polygon_connections(t):
    """Every notched parcel and the nearest offered one other than itself: the segment between them starts and ends on their outlines."""
    other = notched(t("parcels").where("p_type = 'PROMO'"))
    two = nearest_polygons(notched(t("parcels")), other, 2).where("id <> r_id")
    first = two.withColumn("n", F.row_number().over(Window.partitionBy("survey_id", "id").orderBy("rank"))).where("n = 1")
    shape = t("parcels").select("id", l_shape().alias("g"))
    j = first.join(shape, "id").join(shape.select(F.col("id").alias("r_id"), F.col("g").alias("h")), "r_id")
    lies = lambda g, x, y: pairs.reach(G.point(F.col(x), F.col(y)), pairs.edges(F.col(g))) < 1e-6
    apart = F.col("distance_m") > 0
    return j.select("id", F.col("r_id").alias("parcel_id"), F.round("distance_m", 3).alias("length_m"), (~apart | lies("g", "c.ax", "c.ay")).alias("starts_on_own"), (~apart | lies("h", "c.bx", "c.by")).alias("ends_on_other"))


def holed():
    """Box with a square hole of 10 m."""
    return F.slice(framed(), 1, 1)


_SECTOR = "8 * sin(pi() / 32)"  # of a quarter circle of radius 1, in 16 chords


@query("g09_buffer_area", f"""
SELECT id, round((x1 - x0) * (y1 - y0) * 0.75 + 5 * 2 * (x1 - x0 + y1 - y0) + 25 * (5 * {_SECTOR} - 1), 2) AS notched_5m,
  round((x1 - x0) * (y1 - y0) + 8 * (x1 - x0 + y1 - y0) + 16 * 4 * {_SECTOR} - 4, 2) AS holed_4m,
  round((x1 - x0) * (y1 - y0) + 12 * (x1 - x0 + y1 - y0) + 36 * 4 * {_SECTOR}, 2) AS holed_6m,
  round((x1 - x0) * (y1 - y0) - 36 + 4 * (x1 - x0 + y1 - y0) + 100 + 2 * 40 + 4 * 8 * {_SECTOR}, 2) AS parts_2m FROM parcels""")
def buffer_area(t):
    """Polygons grown with round corners: a concave corner, a hole that shrinks, one that closes, two parts."""
    parcels = spread(t("parcels").select("id", *BOX), "id")
    areas = {}
    for name, shape, c in (("notched_5m", l_shape(), 5.0), ("holed_4m", holed(), 4.0), ("holed_6m", holed(), 6.0), ("parts_2m", framed(), 2.0)):
        grown = FS.grown_curves(c)(*FS.flat_geometry(shape), FS.shells(shape))
        areas[name] = F.round(FS.covered_area(winding=True)(*[grown[k] for k in FS.FLAT]), 2)
    return parcels.select("id", *[a.alias(name) for name, a in areas.items()])


_KINDS = ("CASE p_size % 16 WHEN 1 THEN 'self-intersection' WHEN 2 THEN 'ring structure' WHEN 3 THEN 'hole outside shell' WHEN 4 THEN 'ring structure' WHEN 5 THEN 'self-intersection' "
          "WHEN 6 THEN 'nested holes' WHEN 7 THEN 'self-intersection' WHEN 8 THEN 'disconnected interior' WHEN 9 THEN 'self-intersection' WHEN 10 THEN 'nested shells' WHEN 11 THEN 'ring self-intersection' END")


def sound_and_broken_shapes():
    """Sixteen shapes on a box: those that break a rule and, for most, a neighbour that just keeps it."""
    def at(dx, dy):  # from the lower left corner
        return G.point(cx0() + dx, cy0() + dy)

    def square(x, y, side):
        return F.array(at(x, y), at(x + side, y), at(x + side, y + side), at(x, y + side), at(x, y))

    box, far = G.box_ring(cx0(), cy0(), cx1(), cy1()), G.point(cx1(), cy1())
    touching = F.array(at(0, 10), at(10, 5), at(10, 15), at(0, 10))
    across = F.array(at(0, 20), at(20, 0), at(20, 20), at(0, 20))
    shapes = {
        1: F.array(F.array(F.array(at(0, 0), far, G.point(cx1(), cy0()), G.point(cx0(), cy1()), at(0, 0)))),
        2: F.array(F.array(F.slice(box, 1, 4))),
        3: F.array(F.array(box, G.box_ring(cx1() + 50, cy0(), cx1() + 60, cy0() + 10))),
        4: F.array(F.array(F.array(at(0, 0), at(20, 0), at(0, 0)))),
        5: F.array(F.array(box, square(-5, 10, 15))),  # hole over the shell
        6: F.array(F.array(box, square(10, 10, 40), square(20, 20, 10))),
        7: F.array(F.array(box), F.array(G.box_ring(cx1() - 10, cy0() + 10, cx1() + 20, cy1() + 10))),  # overlapping parts
        8: F.array(F.array(box, across)),  # a hole that cuts a corner off
        9: F.array(F.array(box), F.array(G.box_ring(cx1(), cy0(), cx1() + 20, cy1()))),  # parts along one side
        10: F.array(F.array(box), F.array(square(10, 10, 20))),
        11: F.array(F.array(F.array(at(0, 0), at(40, 0), at(20, 20), at(40, 40), at(0, 40), at(20, 20), at(0, 0)))),  # one ring, twice through a point
        12: F.array(F.array(box, touching)),  # a hole on the shell at one point
        13: F.array(F.array(box), F.array(G.box_ring(cx1(), cy1(), cx1() + 20, cy1() + 20))),  # parts at one corner
        14: F.array(F.array(box, square(10, 10, 40)), F.array(square(20, 20, 20))),  # a part in a hole
        15: F.array(F.array(box, square(10, 10, 10), square(20, 20, 10))),  # holes at one corner
    }
    kind, out = F.col("p_size") % 16, F.when(F.lit(False), framed())
    for k, shape in shapes.items():
        out = out.when(kind == k, shape)
    return out.otherwise(framed())


@query("g11_validity", f"SELECT id, {_KINDS} AS reason FROM parcels")
def validity(t):
    return V.reasons(spread(t("parcels").select("id", "p_size", *BOX), "id").select("id", sound_and_broken_shapes().alias("geom")))


@query("g11_long_rings", """
SELECT survey_id, count(*) AS corners, CASE WHEN survey_id % 2 = 1 THEN 'self-intersection' END AS reason FROM lots GROUP BY survey_id HAVING count(*) >= 8""")
def long_rings(t):
    """One ring a window through as many points as it has lots; every other one has two corners swapped."""
    n = t("lots").groupBy("survey_id").agg(F.count("*").alias("corners")).where("corners >= 8")
    turn = lambda i: 2 * math.pi * i / F.col("corners")
    place = lambda i: F.when((F.col("survey_id") % 2 == 1) & (i == 1), F.lit(2)).when((F.col("survey_id") % 2 == 1) & (i == 2), F.lit(1)).otherwise(i % F.col("corners"))
    ring = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("corners")), lambda i: G.point(1000 * F.cos(turn(place(i))), 1000 * F.sin(turn(place(i)))))
    made = n.withColumn("geom", F.array(F.array(ring)))
    return V.reasons(made, "survey_id").join(n, "survey_id").select("survey_id", "corners", "reason")


@query("g12_coordinate_range", "SELECT id, NOT (p_size % 3 = 1 OR p_size % 3 = 2) AS usable FROM parcels")
def coordinate_range(t):
    y = F.when(F.col("p_size") % 3 == 1, F.lit(float("nan"))).when(F.col("p_size") % 3 == 2, F.lit(95.0)).otherwise(F.lit(45.0))
    ring = F.array(G.point(F.lit(33.0), F.lit(44.0)), G.point(F.lit(34.0), F.lit(44.0)), G.point(F.lit(34.0), y), G.point(F.lit(33.0), F.lit(44.0)))
    return t("parcels").select("id", G.finite_in_range(F.array(F.array(ring)), -180.0, -85.0, 180.0, 85.0).alias("usable"))


@query("g13_coordinate_budget", "SELECT survey_id, count(*) * 21 AS coordinates, count(*) * 21 <= 200000 AS within_budget FROM parcels GROUP BY survey_id")
def coordinate_budget(t):
    """Points, rings, parts and the root of several parts count against one budget per answer."""
    n = F.sum(G.coordinate_count(framed(), True))
    return t("parcels").groupBy("survey_id").agg(n.alias("coordinates"), (n <= 200_000).alias("within_budget"))


@query("g14_geometry_identity", "SELECT id, k % 3 <> 1 AS same_ring, k % 3 = 0 AS same_parts FROM parcels")
def geometry_identity(t):
    """Another start, another direction or another order of parts is the same geometry; a corner moved by a micrometre, or a part left out, is not."""
    k = F.col("k") % 3
    corner = F.when(k == 1, cx1() + 1e-6).otherwise(cx1())
    forth = F.array(G.point(corner, cy1()), G.point(cx0(), cy1()), G.point(cx0(), cy0()), G.point(cx1(), cy0()), G.point(corner, cy1()))
    turned = F.array(F.array(F.when(k == 0, F.reverse(forth)).otherwise(forth)))
    parts = F.when(k == 0, F.reverse(framed())).when(k == 1, F.slice(framed(), 1, 1)).otherwise(G.map_points(framed(), lambda x, y: (x, y + 1e-6)))
    return t("parcels").select("id", (G.geometry_hash(box_of(None)) == G.geometry_hash(turned)).alias("same_ring"), (G.geometry_hash(framed()) == G.geometry_hash(parts)).alias("same_parts"))


@query("g15_boundary_touch", """
SELECT p.id, least(x0 - wx0, y0 - wy0, wx1 - x1, wy1 - y1) < 0.1 AS touches FROM parcels p JOIN surveys s ON p.survey_id = s.survey_id""")
def boundary_touch(t):
    j = t("parcels").join(t("surveys"), "survey_id")
    return j.select("id", (F.least(cx0() - F.col("wx0"), cy0() - F.col("wy0"), F.col("wx1") - cx1(), F.col("wy1") - cy1()) < 0.1).alias("touches"))


def forked():
    """Box with a notch from above, half as wide and half as high, and a square hole of 10 m in its lower left."""
    left, right = cx0() + (cx1() - cx0()) / 4, cx1() - (cx1() - cx0()) / 4
    ring = F.array(G.point(cx0(), cy0()), G.point(cx1(), cy0()), G.point(cx1(), cy1()), G.point(right, cy1()), G.point(right, cym()), G.point(left, cym()), G.point(left, cy1()), G.point(cx0(), cy1()), G.point(cx0(), cy0()))
    return F.array(F.array(ring, F.get(F.get(framed(), F.lit(0)), F.lit(1))))


@query("g16_clip_to_window", """
WITH p AS (SELECT survey_id, id, k % 5 AS kind, x1 - x0 AS w, y1 - y0 AS h FROM parcels)
SELECT survey_id, id, round(CASE kind WHEN 0 THEN w * h * 0.75 - 100 WHEN 1 THEN w * (h - 15) - w * h / 4 - 50 WHEN 2 THEN w / 2 * (h / 2 - 10) ELSE w * h * 0.75 - 15 * h - 50 END, 2) AS area_m2,
  CAST(CASE kind WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS parts, CAST(CASE kind WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS holes FROM p WHERE kind < 4""")
def clip_to_window(t):
    """Forked parcels in windows that hold them whole, cut through their hole from below or from the left, cut their arms apart, or miss them."""
    kind = F.col("k") % 5
    p = spread(t("parcels").select("survey_id", "id", "k", *BOX), "id").select("survey_id", "id", *FS.flat_geometry(forked()), F.when(kind == 3, cx0() + 15).otherwise(cx0() - 5).alias("bx0"),
                            F.when(kind == 1, cy0() + 15).when(kind == 2, cym() + 10).when(kind == 4, cy1() + 1).otherwise(cy0() - 5).alias("by0"), (cx1() + 5).alias("bx1"), (cy1() + 5).alias("by1"))
    return CL.clipped_figures(p).select("survey_id", "id", F.round("area_m2", 2).alias("area_m2"), "parts", "holes")


@query("g17_rotated_squares", "SELECT id, CAST(900.0 AS DOUBLE) AS area_m2, round(30 * (abs(cos(radians(p_size % 90))) + abs(sin(radians(p_size % 90)))), 3) AS width_m FROM parcels")
def rotated_squares(t):
    g = t("parcels").select("id", G.rotated_square(cxm(), cym(), F.lit(30.0), F.col("p_size") % 90).alias("g"))
    b = G.bounds(F.col("g"))
    return g.select("id", F.round(G.area(F.col("g")), 3).alias("area_m2"), F.round(b["x1"] - b["x0"], 3).alias("width_m"))


@query("g21_zero_quarters", "SELECT id, quarter_num LIKE '%:0000' AS zero_quarter FROM context WHERE mode = 'quarters'")
def zero_quarters(t):
    return t("context").where("mode = 'quarters'").select("id", F.substring_index("quarter_num", ":", -1).rlike("^0+$").alias("zero_quarter"))


@query("g22_control_window", """
SELECT p_brand, survey_id, min(x0) - 25 AS x0, min(y0) - 25 AS y0, max(x1) + 25 AS x1, max(y1) + 25 AS y1, (max(x1) - min(x0) + 50) * (max(y1) - min(y0) + 50) <= 1000000 AS accepted FROM parcels GROUP BY p_brand, survey_id""")
def control_window(t):
    """Box around a set of features, padded by 25 m; at most 1 km²."""
    g = t("parcels").groupBy("p_brand", "survey_id").agg((F.min("x0") - 25).alias("x0"), (F.min("y0") - 25).alias("y0"), (F.max("x1") + 25).alias("x1"), (F.max("y1") + 25).alias("y1"))
    return g.withColumn("accepted", (cx1() - cx0()) * (cy1() - cy0()) <= 1_000_000)


# ---- access -------------------------------------------------------------------------------------


def access_segments(t):
    """Candidate, its nearest road parcel and the shortest segment between the two boxes."""
    c, roads = candidates(t), road_parcels(t)
    k = knn_join(c, roads, 1, side=250.0).select("survey_id", "id", F.col("r_id").alias("road_id"), "distance_m")
    j = (k.join(c.select("survey_id", "id", *BOX), ["survey_id", "id"])
         .join(roads.select(F.col("id").alias("road_id"), *[F.col(b).alias(f"q_{b}") for b in BOX]), "road_id"))
    x_shared = F.greatest("x0", "q_x0") <= F.least("x1", "q_x1")
    y_shared = F.greatest("y0", "q_y0") <= F.least("y1", "q_y1")
    ax = F.when(x_shared, F.greatest("x0", "q_x0")).when(cx1() < F.col("q_x0"), cx1()).otherwise(cx0())
    bx = F.when(x_shared, F.greatest("x0", "q_x0")).when(cx1() < F.col("q_x0"), F.col("q_x0")).otherwise(F.col("q_x1"))
    ay = F.when(y_shared, F.greatest("y0", "q_y0")).when(cy1() < F.col("q_y0"), cy1()).otherwise(cy0())
    by = F.when(y_shared, F.greatest("y0", "q_y0")).when(cy1() < F.col("q_y0"), F.col("q_y0")).otherwise(F.col("q_y1"))
    return j.select("survey_id", "id", "road_id", "distance_m", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))


_SEG = """d AS (SELECT a.survey_id, a.id, b.id AS road_id, a.x0, a.y0, a.x1, a.y1, b.x0 AS q0, b.y0 AS r0, b.x1 AS q1, b.y1 AS r1, row_number() OVER (PARTITION BY a.survey_id, a.id ORDER BY
    sqrt(power(greatest(0, b.x0 - a.x1, a.x0 - b.x1), 2) + power(greatest(0, b.y0 - a.y1, a.y0 - b.y1), 2)), b.id) AS rk
    FROM offers a JOIN parcels b ON a.survey_id = b.survey_id WHERE lower(b.p_name) LIKE '%red%' OR lower(b.p_name) LIKE '%hot%'),
 seg AS (SELECT survey_id, id, road_id, CASE WHEN greatest(x0, q0) <= least(x1, q1) THEN greatest(x0, q0) WHEN x1 < q0 THEN x1 ELSE x0 END AS ax, CASE WHEN greatest(x0, q0) <= least(x1, q1) THEN greatest(x0, q0) WHEN x1 < q0 THEN q0 ELSE q1 END AS bx,
   CASE WHEN greatest(y0, r0) <= least(y1, r1) THEN greatest(y0, r0) WHEN y1 < r0 THEN y1 ELSE y0 END AS ay, CASE WHEN greatest(y0, r0) <= least(y1, r1) THEN greatest(y0, r0) WHEN y1 < r0 THEN r0 ELSE r1 END AS by_ FROM d WHERE rk = 1)"""


@query("g18_shortest_segments", f"WITH {_SEG} SELECT id, road_id, ax, ay, bx, by_ AS by, round(sqrt(power(bx - ax, 2) + power(by_ - ay, 2)), 2) AS length_m FROM seg")
def shortest_segments(t):
    s = access_segments(t)
    return s.select("id", "road_id", "ax", "ay", "bx", "by", F.round(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), 2).alias("length_m"))


def obstacles(t):
    """Segments against parcels (the target road left out) and buildings, with the length inside each."""
    s = access_segments(t).withColumns({"x0": F.least("ax", "bx"), "y0": F.least("ay", "by"), "x1": F.greatest("ax", "bx"), "y1": F.greatest("ay", "by")})
    objs = (t("parcels").select("survey_id", F.lit("parcels").alias("mode"), "id", *BOX)
            .unionByName(t("buildings").select("survey_id", F.lit("buildings").alias("mode"), "id", *BOX)))
    j = tile_join(s, objs, touch=True, side=TILE_M).where(F.col("r_id") != F.col("road_id"))
    piece = {"y0": F.col("r_y0"), "y1": F.col("r_y1"), "xl0": F.col("r_x0"), "xl1": F.col("r_x0"), "xr0": F.col("r_x1"), "xr1": F.col("r_x1")}
    hit = pairs.segment_in_piece(piece, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return j.withColumn("h", hit).where("h.touches").select("survey_id", "id", "road_id", F.col("r_mode").alias("mode"), F.col("r_id").alias("feature_id"), F.col("h.length").alias("length_m"))


@query("j33_g19_access_obstacles", f"""WITH {_SEG},
o AS (SELECT survey_id, 'parcels' AS mode, id, x0, y0, x1, y1 FROM parcels UNION ALL SELECT survey_id, 'buildings', id, x0, y0, x1, y1 FROM buildings),
t AS (SELECT s.id, s.road_id, o.mode, o.id AS feature_id, s.ax, s.ay, s.bx, s.by_,
  greatest(0, CASE WHEN bx > ax THEN (o.x0 - ax) / (bx - ax) WHEN bx < ax THEN (o.x1 - ax) / (bx - ax) ELSE 0 END, CASE WHEN by_ > ay THEN (o.y0 - ay) / (by_ - ay) WHEN by_ < ay THEN (o.y1 - ay) / (by_ - ay) ELSE 0 END) AS t0,
  least(1, CASE WHEN bx > ax THEN (o.x1 - ax) / (bx - ax) WHEN bx < ax THEN (o.x0 - ax) / (bx - ax) ELSE 1 END, CASE WHEN by_ > ay THEN (o.y1 - ay) / (by_ - ay) WHEN by_ < ay THEN (o.y0 - ay) / (by_ - ay) ELSE 1 END) AS t1
  FROM seg s JOIN o ON s.survey_id = o.survey_id AND (bx <> ax OR ax BETWEEN o.x0 AND o.x1) AND (by_ <> ay OR ay BETWEEN o.y0 AND o.y1) WHERE o.id <> s.road_id)
SELECT id, mode, feature_id, CASE WHEN (t1 - t0) * sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) > 0 THEN 'intersection' ELSE 'touch' END AS contact, round((t1 - t0) * sqrt(power(bx - ax, 2) + power(by_ - ay, 2)), 4) AS length_m FROM t WHERE t0 <= t1""")
def access_obstacles(t):
    return obstacles(t).select("id", "mode", "feature_id", F.when(F.col("length_m") > 0, "intersection").otherwise("touch").alias("contact"), F.round("length_m", 4).alias("length_m"))


@query("a36_access_state", f"""WITH {_SEG},
o AS (SELECT survey_id, id, x0, y0, x1, y1 FROM parcels UNION ALL SELECT survey_id, id, x0, y0, x1, y1 FROM buildings),
t AS (SELECT s.survey_id, s.id,
  greatest(0, CASE WHEN bx > ax THEN (o.x0 - ax) / (bx - ax) WHEN bx < ax THEN (o.x1 - ax) / (bx - ax) ELSE 0 END, CASE WHEN by_ > ay THEN (o.y0 - ay) / (by_ - ay) WHEN by_ < ay THEN (o.y1 - ay) / (by_ - ay) ELSE 0 END) AS t0,
  least(1, CASE WHEN bx > ax THEN (o.x1 - ax) / (bx - ax) WHEN bx < ax THEN (o.x0 - ax) / (bx - ax) ELSE 1 END, CASE WHEN by_ > ay THEN (o.y1 - ay) / (by_ - ay) WHEN by_ < ay THEN (o.y0 - ay) / (by_ - ay) ELSE 1 END) AS t1
  FROM seg s JOIN o ON s.survey_id = o.survey_id AND (bx <> ax OR ax BETWEEN o.x0 AND o.x1) AND (by_ <> ay OR ay BETWEEN o.y0 AND o.y1) WHERE o.id <> s.road_id AND (ax <> bx OR ay <> by_)),
n AS (SELECT survey_id, id, count(*) AS c FROM t WHERE t0 < t1 GROUP BY survey_id, id)
SELECT c.survey_id, c.id, CASE WHEN s.id IS NULL THEN 'unknown_no_observed_road' WHEN ax = bx AND ay = by_ THEN 'zero_distance' WHEN n.c > 0 THEN 'observed_intersections' ELSE 'no_observed_intersections' END AS state,
  coalesce(n.c, 0) AS intersections, false AS legal_access_confirmed FROM offers c LEFT JOIN seg s ON c.survey_id = s.survey_id AND c.id = s.id LEFT JOIN n ON c.survey_id = n.survey_id AND c.id = n.id""")
def access_state(t):
    """No road known, no distance, something in the way, or nothing observed in the way."""
    met = obstacles(t).where("length_m > 0").groupBy("survey_id", "id").agg(F.count("*").alias("intersections"))
    seg = access_segments(t).select("survey_id", "id", "road_id", "distance_m")
    j = candidates(t).select("survey_id", "id").join(seg, ["survey_id", "id"], "left").join(met, ["survey_id", "id"], "left").fillna(0, ["intersections"])
    state = (F.when(F.col("road_id").isNull(), "unknown_no_observed_road").when(F.col("distance_m") == 0, "zero_distance")
             .when(F.col("intersections") > 0, "observed_intersections").otherwise("no_observed_intersections"))
    return j.select("survey_id", "id", state.alias("state"), "intersections", F.lit(False).alias("legal_access_confirmed"))


# ---- agreement of two outlines ------------------------------------------------------------------


def agreement_pairs(t):
    """Holed outlines of two parts against a reference, shifted by p_size / 10 m.

    k says how else the reference differs: 1 has one part only, 2 lists its parts the other way round, 3 has two strips where the outline has one.
    """
    s, kind = F.col("p_size") / 10.0, F.col("k") % 4

    def strip(shift, low):
        return F.array(G.box_ring(cx1() + 5 + shift, cy0() + low, cx1() + 15 + shift, cy0() + low + 2))

    moved = G.map_points(framed(), lambda x, y: (x + s, y))
    main, second = F.get(moved, F.lit(0)), F.get(moved, F.lit(1))
    a = F.when(kind == 3, F.array(F.get(framed(), F.lit(0)), strip(F.lit(0.0), 0))).otherwise(framed())
    b = F.when(kind == 1, F.array(main)).when(kind == 2, F.array(second, main)).when(kind == 3, F.array(main, strip(s, 0), strip(s, 2.5))).otherwise(moved)
    return spread(t("parcels").select("id", "k", "p_size", *BOX), "id").select("id", a.alias("a"), b.alias("b"))


_AGREE = """v AS (SELECT id, k % 4 AS kind, p_size / 10.0 AS s, x1 - x0 AS w, y1 - y0 AS h FROM parcels),
q AS (SELECT id, 'a' AS side, w * h AS m, w / 2 AS cx, h / 2 AS cy FROM v UNION ALL SELECT id, 'a', -100, 15, 15 FROM v UNION ALL SELECT id, 'a', 100, w + 10, 5 FROM v WHERE kind <> 3 UNION ALL SELECT id, 'a', 20, w + 10, 1 FROM v WHERE kind = 3
  UNION ALL SELECT id, 'b', w * h, w / 2 + s, h / 2 FROM v UNION ALL SELECT id, 'b', -100, 15 + s, 15 FROM v UNION ALL SELECT id, 'b', 100, w + 10 + s, 5 FROM v WHERE kind IN (0, 2)
  UNION ALL SELECT id, 'b', 20, w + 10 + s, 1 FROM v WHERE kind = 3 UNION ALL SELECT id, 'b', 20, w + 10 + s, 3.5 FROM v WHERE kind = 3),
c AS (SELECT id, side, sum(m) AS area, sum(m * cx) / sum(m) AS cx, sum(m * cy) / sum(m) AS cy FROM q GROUP BY id, side),
g AS (SELECT v.*, a.area AS area_a, b.area AS area_b, sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) AS far, (w - s) * h - 200 + (10 - s) * 10 + CASE kind WHEN 1 THEN 0 WHEN 3 THEN (10 - s) * 2 ELSE (10 - s) * 10 END AS common,
  CASE kind WHEN 1 THEN 15 - s WHEN 3 THEN sqrt(s * s + 6.25) ELSE s END AS gap FROM v JOIN c a ON v.id = a.id AND a.side = 'a' JOIN c b ON v.id = b.id AND b.side = 'b')"""


@query("g20_a39_agreement", f"""
WITH {_AGREE} SELECT id, round(gap, 4) AS vertex_gap_m, round(gap, 4) AS boundary_gap_m, CAST(round(abs(area_a - area_b) / area_b * 100, 6) AS DOUBLE) AS area_difference_percent, CAST(round(common / (area_a + area_b - common), 6) AS DOUBLE) AS iou,
  CAST(round(far, 4) AS DOUBLE) AS centroid_distance_m, CASE WHEN s <= 3 AND kind IN (0, 2) THEN 'consistent_with_reference' ELSE 'reference_disagrees' END AS verdict FROM g""")
def agreement(t, tolerance: float = 3.0):
    g = AG.agreement(agreement_pairs(t), tolerance)
    return g.select("id", F.round("vertex_gap_m", 4).alias("vertex_gap_m"), F.round("boundary_gap_m", 4).alias("boundary_gap_m"), F.round(F.col("area_difference") * 100, 6).alias("area_difference_percent"),
                    F.round("iou", 6).alias("iou"), F.round("centroid_distance_m", 4).alias("centroid_distance_m"), "verdict")


@query("j40_part_matching", """
WITH v AS (SELECT id, k % 4 AS kind, p_size / 10.0 AS s FROM parcels)
SELECT id, CAST(2 AS BIGINT) AS parts_a, CAST(CASE kind WHEN 1 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS BIGINT) AS parts_b,
  CAST(CASE WHEN s > 3 THEN 0 WHEN kind = 1 THEN 1 WHEN kind = 3 AND s <= 1.65 THEN 3 ELSE 2 END AS BIGINT) AS fits, s <= 3 AND kind IN (0, 2) AS "unique" FROM v""")
def part_matching(t, tolerance: float = 3.0):
    """Parts of two outlines paired within 3 m and one percent of area; each must be the other's only fit."""
    return AG.matched_parts(agreement_pairs(t), tolerance)
