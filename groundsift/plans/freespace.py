"""A01 and what follows from it: gaps, their filters, overlays, ranks and trial plots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.operators import freespace as FS
from groundsift.operators.components import connected_components
from groundsift.operators.plots import feasible_squares, pick_plots
from groundsift.operators.tiles import box_pieces, piece_join, tile_join
from groundsift.plans.joins import BOX, candidates, overlay_layers
from groundsift.registry import query
from groundsift.session import cut, scratch_folder
from groundsift.sources import sinks

MIN_AREA, MAX_AREA, MIN_WIDTH = 1000.0, 20000.0, 50.0


def occupied(t, *names):
    """Observed objects that take ground away, with flat geometry."""
    out = None
    for name in names or ("parcels", "buildings"):
        df = t(name).select("survey_id", *BOX, *FS.box_flat())
        out = df if out is None else out.unionByName(df)
    return out


def gap_table(t, min_width=MIN_WIDTH):
    """Pieces and one settled row per gap."""
    return settled_gaps(t("surveys"), occupied(t), min_width)


def settled_gaps(w, occ, min_width):
    pieces = FS.free_pieces(w, occ, min_width)
    figures = FS.settle_width(pieces, FS.gap_figures(pieces, w), w, occ, min_width)
    return pieces, figures


# lattice of 20 m cells, runs of free cells per row, runs joined into gaps by least label
_CELLS = """
occ AS (SELECT survey_id, x0, y0, x1, y1 FROM parcels UNION ALL SELECT survey_id, x0, y0, x1, y1 FROM buildings),
blk AS (SELECT DISTINCT survey_id, i, j FROM (SELECT *, unnest(generate_series(j0, j1 - 1)) AS j FROM (SELECT *, unnest(generate_series(i0, i1 - 1)) AS i FROM (
   SELECT o.survey_id, CAST((greatest(o.x0, s.wx0) - s.wx0) / 20 AS BIGINT) AS i0, CAST((least(o.x1, s.wx1) - s.wx0) / 20 AS BIGINT) AS i1,
          CAST((greatest(o.y0, s.wy0) - s.wy0) / 20 AS BIGINT) AS j0, CAST((least(o.y1, s.wy1) - s.wy0) / 20 AS BIGINT) AS j1
   FROM occ o JOIN surveys s ON o.survey_id = s.survey_id)))),
fre AS (SELECT survey_id, i, unnest(generate_series(CAST(0 AS BIGINT), 99)) AS j FROM (SELECT survey_id, unnest(generate_series(CAST(0 AS BIGINT), 99)) AS i FROM surveys) EXCEPT SELECT survey_id, i, j FROM blk),
runs AS (SELECT survey_id, j, min(i) AS i0, max(i) AS i1 FROM (SELECT *, i - row_number() OVER (PARTITION BY survey_id, j ORDER BY i) AS g FROM fre) GROUP BY survey_id, j, g),
nodes AS (SELECT survey_id * 1000000 + j * 1000 + i0 AS node, survey_id, j, i0, i1 FROM runs),
edges AS (SELECT a.node AS a, b.node AS b FROM nodes a JOIN nodes b ON a.survey_id = b.survey_id AND (b.j = a.j + 1 OR b.j = a.j - 1) AND a.i0 <= b.i1 AND b.i0 <= a.i1),
cc(node, label) USING KEY (node) AS (SELECT node, node FROM nodes UNION
   SELECT e.b, min(f.label) FROM cc f JOIN edges e ON e.a = f.node JOIN recurring.cc r ON r.node = e.b WHERE f.label < r.label GROUP BY e.b),
lab AS (SELECT n.*, c.label FROM nodes n JOIN cc c ON n.node = c.node),
pat AS (SELECT 1 AS p, 9 AS need, di, dj FROM (SELECT unnest(range(3)) AS di), (SELECT unnest(range(3)) AS dj)
  UNION ALL SELECT 2, 12, di, dj FROM (SELECT unnest(range(4)) AS di), (SELECT unnest(range(4)) AS dj) WHERE NOT (di IN (0, 3) AND dj IN (0, 3))),
blocks AS (SELECT f.survey_id, f.i - di + 1 AS i, f.j - dj AS j FROM fre f, pat GROUP BY f.survey_id, p, need, f.i - di + 1, f.j - dj HAVING count(*) = need),
wide AS (SELECT DISTINCT l.label FROM blocks b JOIN lab l ON l.survey_id = b.survey_id AND l.j = b.j AND b.i BETWEEN l.i0 AND l.i1),
gap AS (SELECT l.survey_id, l.label, CAST(sum(i1 - i0 + 1) * 400 AS DOUBLE) AS area, sum((i1 - i0 + 1) * (i0 + i1 + 1) / 2.0) / sum(i1 - i0 + 1) * 20 + s.wx0 AS cx,
   sum((i1 - i0 + 1) * (j + 0.5)) / sum(i1 - i0 + 1) * 20 + s.wy0 AS cy, bool_or(i0 = 0 OR i1 = 99 OR j = 0 OR j = 99) AS touches,
   s.wx0 + 20 * (l.label % 1000) AS ax, s.wy0 + 20 * (floor(l.label / 1000) % 1000) AS ay, l.label IN (SELECT label FROM wide) AS is_wide
  FROM lab l JOIN surveys s ON l.survey_id = s.survey_id GROUP BY l.survey_id, l.label, s.wx0, s.wy0)
"""


@query("a01_free_space_gaps", f"""WITH RECURSIVE {_CELLS}
SELECT survey_id, CAST(ax AS DOUBLE) AS anchor_x, CAST(ay AS DOUBLE) AS anchor_y, round(area, 2) AS area_m2, touches AS touches_boundary, round(cx, 3) AS cx, round(cy, 3) AS cy FROM gap""")
def free_space(t):
    w = t("surveys")
    f = FS.gap_figures(FS.free_pieces(w, occupied(t)), w)
    return f.select("survey_id", F.col("anchor.xl0").alias("anchor_x"), F.col("anchor.y0").alias("anchor_y"), F.round("area", 2).alias("area_m2"),
                    "touches_boundary", F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"))


@query("w01_ranked_gaps", f"""WITH RECURSIVE {_CELLS}
SELECT survey_id, CAST(ax AS DOUBLE) AS anchor_x, CAST(ay AS DOUBLE) AS anchor_y, round(area, 2) AS area_m2, area > {MAX_AREA} AS large_window,
  concat('Промежуток ', CAST(row_number() OVER (PARTITION BY survey_id ORDER BY area DESC, round(cx, 6), round(cy, 6)) AS VARCHAR)) AS label
FROM gap WHERE area >= {MIN_AREA} AND is_wide""")
def ranked_gaps(t):
    """Gaps that pass the area and width filters, ranked by size inside their window."""
    _, f = gap_table(t)
    rank = F.row_number().over(Window.partitionBy("survey_id").orderBy(F.desc("area"), F.round("cx", 6), F.round("cy", 6)))
    return (f.where((F.col("area") >= MIN_AREA) & F.col("wide"))
            .select("survey_id", F.col("anchor.xl0").alias("anchor_x"), F.col("anchor.y0").alias("anchor_y"), F.round("area", 2).alias("area_m2"),
                    (F.col("area") > MAX_AREA).alias("large_window"), F.concat(F.lit("Промежуток "), rank.cast("string")).alias("label")))


@query("p13_p14_g10_filtered_counts", f"""WITH RECURSIVE {_CELLS}
SELECT survey_id, count(*) FILTER (WHERE area < {MIN_AREA}) AS small, count(*) FILTER (WHERE area >= {MIN_AREA} AND NOT is_wide) AS narrow,
  count(*) FILTER (WHERE area >= {MIN_AREA} AND is_wide) AS kept FROM gap GROUP BY survey_id""")
def filtered_counts(t):
    """Nothing is dropped silently: small and narrow gaps are counted."""
    _, f = gap_table(t)
    small = F.col("area") < MIN_AREA
    return f.groupBy("survey_id").agg(F.count_if(small).alias("small"), F.count_if(~small & ~F.col("wide")).alias("narrow"),
                                      F.count_if(~small & F.col("wide")).alias("kept"))


@query("a05_survey_summary", """
WITH cell AS (SELECT s.survey_id, unnest(generate_series(CAST(0 AS BIGINT), 9999)) AS c, wx0, wy0 FROM surveys s),
xy AS (SELECT survey_id, wx0 + 20 * (c % 100) AS x, wy0 + 20 * floor(c / 100) AS y FROM cell),
p AS (SELECT DISTINCT c.survey_id, c.x, c.y FROM xy c JOIN parcels o ON o.survey_id = c.survey_id AND o.x0 <= c.x AND c.x < o.x1 AND o.y0 <= c.y AND c.y < o.y1),
b AS (SELECT DISTINCT c.survey_id, c.x, c.y FROM xy c JOIN buildings o ON o.survey_id = c.survey_id AND o.x0 <= c.x AND c.x < o.x1 AND o.y0 <= c.y AND c.y < o.y1)
SELECT s.survey_id, CAST(4000000.0 AS DOUBLE) AS area_m2, CAST((SELECT count(*) FROM p WHERE p.survey_id = s.survey_id) * 400 AS DOUBLE) AS observed_parcels_m2,
  CAST((SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM p) q WHERE q.survey_id = s.survey_id) * 400 AS DOUBLE) AS buildings_excluded_m2,
  CAST((10000 - (SELECT count(*) FROM (SELECT * FROM b UNION SELECT * FROM p) q WHERE q.survey_id = s.survey_id)) * 400 AS DOUBLE) AS remainder_m2,
  (SELECT count(*) FROM parcels q WHERE q.survey_id = s.survey_id) AS parcels, (SELECT count(*) FROM buildings q WHERE q.survey_id = s.survey_id) AS buildings,
  (SELECT count(*) FROM zones q WHERE q.survey_id = s.survey_id) AS pzz, (SELECT count(*) FROM restrictions q WHERE q.survey_id = s.survey_id) AS restrictions FROM surveys s""")
def survey_summary(t):
    """Observed, excluded and remaining ground per window, and layer counts."""
    w = t("surveys").select("survey_id", "wx0", "wy0", "wx1", "wy1")

    def covered(name, *layers):
        objs = None
        for layer in layers:
            o = t(layer).select("survey_id", *BOX)
            objs = o if objs is None else objs.unionByName(o)
        cut_ = (objs.join(w, "survey_id").withColumns({"x0": F.greatest("x0", "wx0"), "y0": F.greatest("y0", "wy0"), "x1": F.least("x1", "wx1"), "y1": F.least("y1", "wy1")})
                .where("x0 < x1 AND y0 < y1"))
        return FS.union_area(cut_.select("survey_id", *BOX, *FS.box_flat()), ["survey_id"]).withColumnRenamed("union_area_m2", name)

    counts = None
    for name in ("parcels", "buildings", "zones", "restrictions"):
        c = t(name).groupBy("survey_id").agg(F.count("*").alias("pzz" if name == "zones" else name))
        counts = c if counts is None else counts.join(c, "survey_id", "full")
    whole = (F.col("wx1") - F.col("wx0")) * (F.col("wy1") - F.col("wy0"))
    out = (w.join(covered("p", "parcels"), "survey_id", "left").join(covered("pb", "parcels", "buildings"), "survey_id", "left").join(counts, "survey_id", "left")
           .fillna(0))
    return out.select("survey_id", whole.alias("area_m2"), F.round("p", 2).alias("observed_parcels_m2"), F.round(F.col("pb") - F.col("p"), 2).alias("buildings_excluded_m2"),
                      F.round(whole - F.col("pb"), 2).alias("remainder_m2"), "parcels", "buildings", "pzz", "restrictions")


@query("a03_coverage_gate", """
WITH cov AS (SELECT survey_id, x0, y0, x1, y1 FROM zones UNION ALL SELECT survey_id, x0, y0, x1, y1 FROM parcels),
cell AS (SELECT s.survey_id, wx0 + 20 * (c % 100) AS x, wy0 + 20 * floor(c / 100) AS y FROM (SELECT survey_id, wx0, wy0, unnest(generate_series(CAST(0 AS BIGINT), 9999)) AS c FROM surveys) s),
hit AS (SELECT DISTINCT c.survey_id, c.x, c.y FROM cell c JOIN cov o ON o.survey_id = c.survey_id AND o.x0 <= c.x AND c.x < o.x1 AND o.y0 <= c.y AND c.y < o.y1)
SELECT s.survey_id, CAST((10000 - count(h.x)) * 400 AS DOUBLE) AS uncovered_m2, (10000 - count(h.x)) * 400 <= 0.1 AS covered FROM surveys s LEFT JOIN hit h ON s.survey_id = h.survey_id GROUP BY s.survey_id""")
def coverage_gate(t):
    """Window minus declared coverage; at most 0.1 m² may stay uncovered."""
    w = t("surveys").select("survey_id", "wx0", "wy0", "wx1", "wy1")
    clip = (t("zones").select("survey_id", *BOX).unionByName(t("parcels").select("survey_id", *BOX)).join(w, "survey_id")
            .withColumns({"x0": F.greatest("x0", "wx0"), "y0": F.greatest("y0", "wy0"), "x1": F.least("x1", "wx1"), "y1": F.least("y1", "wy1")}).where("x0 < x1 AND y0 < y1"))
    got = FS.union_area(clip.select("survey_id", *BOX, *FS.box_flat()), ["survey_id"])
    left = (F.col("wx1") - F.col("wx0")) * (F.col("wy1") - F.col("wy0")) - F.coalesce("union_area_m2", F.lit(0.0))
    return w.join(got, "survey_id", "left").select("survey_id", F.round(left, 2).alias("uncovered_m2"), (left <= 0.1).alias("covered"))


@query("a04_union_and_components", """
WITH RECURSIVE cell AS (SELECT s.survey_id, wx0 - 0 + 20 * (c % 120) AS x, wy0 + 20 * floor(c / 120) AS y FROM (SELECT survey_id, wx0, wy0, unnest(generate_series(CAST(0 AS BIGINT), 14399)) AS c FROM surveys) s),
hit AS (SELECT DISTINCT c.survey_id, c.x, c.y FROM cell c JOIN parcels o ON o.survey_id = c.survey_id AND o.x0 <= c.x AND c.x < o.x1 AND o.y0 <= c.y AND c.y < o.y1),
e AS (SELECT a.k AS a, b.k AS b FROM parcels a JOIN parcels b ON a.survey_id = b.survey_id AND a.k <> b.k AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
   AND (least(a.x1, b.x1) > greatest(a.x0, b.x0) OR least(a.y1, b.y1) > greatest(a.y0, b.y0))),
cc(k, label) USING KEY (k) AS (SELECT k, k FROM parcels UNION SELECT e.b, min(f.label) FROM cc f JOIN e ON e.a = f.k JOIN recurring.cc r ON r.k = e.b WHERE f.label < r.label GROUP BY e.b),
n AS (SELECT p.survey_id, count(DISTINCT c.label) AS component_count, sum((x1 - x0) * (y1 - y0)) AS total FROM parcels p JOIN cc c ON p.k = c.k GROUP BY p.survey_id),
u AS (SELECT survey_id, CAST(count(*) * 400 AS DOUBLE) AS area FROM hit GROUP BY survey_id)
SELECT n.survey_id, round(total, 2) AS sum_area_m2, round(area, 2) AS union_area_m2, round(greatest(0, total - area), 6) AS overlap_area_m2, component_count FROM n JOIN u ON n.survey_id = u.survey_id""")
def union_and_components(t):
    """Sum and union of areas per group, and how many separate bodies the union has."""
    p = t("parcels")
    u = FS.union_area(p.select("survey_id", *BOX, *FS.box_flat()), ["survey_id"])
    total = p.groupBy("survey_id").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("total"))
    small = p.select("survey_id", "id", *BOX)
    side = (F.least("x1", "r_x1") > F.greatest("x0", "r_x0")) | (F.least("y1", "r_y1") > F.greatest("y0", "r_y0"))
    edges = tile_join(small, small, touch=True).where((F.col("id") < F.col("r_id")) & side).select(F.col("id").alias("a"), F.col("r_id").alias("b"))
    comps = connected_components(p.select(F.col("id").alias("node")), edges)
    n = (comps.join(p.select("survey_id", F.col("id").alias("node")), "node").select("survey_id", "component").distinct()
         .groupBy("survey_id").agg(F.count("*").alias("component_count")))
    return (total.join(u, "survey_id").join(n, "survey_id")
            .select("survey_id", F.round("total", 2).alias("sum_area_m2"), F.round("union_area_m2", 2).alias("union_area_m2"),
                    F.round(F.greatest(F.lit(0.0), F.col("total") - F.col("union_area_m2")), 6).alias("overlap_area_m2"), "component_count"))


@query("j01_gap_overlays", f"""WITH RECURSIVE {_CELLS},
lay AS (SELECT survey_id, CASE WHEN p_type = 'ECONOMY' THEN 'free' ELSE 'auction' END AS layer, id, x0, y0, x1, y1 FROM offers
 UNION ALL SELECT survey_id, 'pzz', id, x0, y0, x1, y1 FROM zones UNION ALL SELECT survey_id, 'restrictions', id, x0, y0, x1, y1 FROM restrictions),
r AS (SELECT l.survey_id, l.label, s.wx0 + 20 * l.i0 AS x0, s.wx0 + 20 * (l.i1 + 1) AS x1, s.wy0 + 20 * l.j AS y0, s.wy0 + 20 * (l.j + 1) AS y1 FROM lab l JOIN surveys s ON l.survey_id = s.survey_id)
SELECT g.survey_id, CAST(g.ax AS DOUBLE) AS anchor_x, CAST(g.ay AS DOUBLE) AS anchor_y, b.layer, b.id AS feature_id,
  round(sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))), 2) AS area_m2
FROM r a JOIN gap g ON a.label = g.label JOIN lay b ON a.survey_id = b.survey_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 WHERE g.area >= {MIN_AREA} AND g.is_wide
GROUP BY g.survey_id, g.ax, g.ay, b.layer, b.id""")
def gap_overlays(t):
    pieces, f = gap_table(t)
    kept = f.where((F.col("area") >= MIN_AREA) & F.col("wide")).select("survey_id", "gap", F.col("anchor.xl0").alias("anchor_x"), F.col("anchor.y0").alias("anchor_y"))
    hits = piece_join(pieces.select("survey_id", "gap", *G.PIECE), box_pieces(overlay_layers(t)).select("survey_id", "layer", "id", *G.PIECE), ["gap"], ["layer", "id"])
    return hits.join(kept, ["survey_id", "gap"]).select("survey_id", "anchor_x", "anchor_y", F.col("r_layer").alias("layer"), F.col("r_id").alias("feature_id"),
                                                        F.round("area_m2", 2).alias("area_m2"))


def trial_plots(t, target_area: float = 900.0, limit: int = 6):
    """Plots of each window: a quota of ceil(limit / gaps) per gap, then the first ``limit`` in order of gap and turn."""
    pieces, f = gap_table(t, 30.0)
    kept = cut(f.where((F.col("area") >= MIN_AREA) & F.col("wide")))  # widths are measured once; it is read five times
    side = target_area**0.5
    exclusions = box_pieces(t("restrictions")).select("survey_id", "id", *G.PIECE)
    gaps = kept.groupBy("survey_id").agg(F.greatest(F.lit(1), F.ceil(F.lit(limit) / F.count("*"))).alias("quota"))
    quotas = kept.select("survey_id", "gap").join(gaps, "survey_id")
    squares = feasible_squares(pieces, kept.select("survey_id", "gap", *BOX), t("surveys"), occupied(t), exclusions, side, quotas)
    chosen = pick_plots(squares, side, quotas)
    # a window has fewer than limit + gaps plots by now
    order = Window.partitionBy("survey_id").orderBy(F.desc("area"), F.round("cx_", 6), F.round("cy_", 6), "turn")
    placed = chosen.join(kept.select("survey_id", "gap", "area", F.col("cx").alias("cx_"), F.col("cy").alias("cy_")), ["survey_id", "gap"])
    placed = placed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select(*chosen.columns)
    return cut(placed), kept, side


@query("r18_w03_trial_plots")
def plots(t):
    """Trial plots under quota and limit; every gap takes its least lattice places first."""
    chosen, kept, side = trial_plots(t)
    return (chosen.join(kept.select("survey_id", "gap", "gap_id"), ["survey_id", "gap"])
            .select("survey_id", "gap_id", F.col("turn").cast("bigint").alias("turn"), F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"),
                    F.col("angle").alias("rotation_degrees"), F.lit(side * side).alias("area_m2"), F.lit("draft").alias("kind")))


@query("w03_unplaced_gaps")
def unplaced_gaps(t):
    """What quota and limit left out is named: gaps, plots and gaps without a plot of each window."""
    chosen, kept, _ = trial_plots(t)
    gaps = kept.join(chosen.groupBy("survey_id", "gap").agg(F.count("*").alias("plots")), ["survey_id", "gap"], "left")
    return gaps.groupBy("survey_id").agg(F.count("*").alias("gaps"), F.coalesce(F.sum("plots"), F.lit(0)).cast("bigint").alias("plots"),
                                         F.count_if(F.col("plots").isNull()).alias("unplaced_gaps"))


@query("u01_j28_candidate_union")
def candidate_union(t):
    """Candidates of four kinds; a gap stands for itself only when it got no trial plot."""
    chosen, kept, side = trial_plots(t)
    drafts = chosen.join(kept.select("survey_id", "gap", "gap_id"), ["survey_id", "gap"]).select(
        "survey_id", F.concat_ws("-", F.lit("draft"), "gap_id", F.col("turn").cast("string")).alias("id"), F.lit("draft").alias("kind"),
        F.col("gap_id").alias("parent_gap_id"), F.lit(side * side).alias("area_m2"))
    alone = kept.join(chosen.select("survey_id", "gap").distinct(), ["survey_id", "gap"], "left_anti").select(
        "survey_id", F.col("gap_id").alias("id"), F.lit("gap").alias("kind"), F.col("gap_id").alias("parent_gap_id"), F.round("area", 2).alias("area_m2"))
    plots_ = candidates(t).select("survey_id", "id", "kind", F.lit(None).cast("string").alias("parent_gap_id"),
                                  ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area_m2"))
    return drafts.unionByName(alone).unionByName(plots_)


def observed_shapes(t):
    """Four occupied roles as polygons: notched parcels, buildings, road parcels, and exclusions with a hole and a second part."""
    from groundsift.plans.joins import road_parcels
    from groundsift.plans.shapes import framed, l_shape

    box = G.box_geom(*[F.col(c) for c in BOX])
    return (t("parcels").select("survey_id", l_shape().alias("geom")).unionByName(t("buildings").select("survey_id", box.alias("geom")))
            .unionByName(road_parcels(t).select("survey_id", box.alias("geom"))).unionByName(t("restrictions").select("survey_id", framed().alias("geom"))))


@query("a02_gaps_with_clearance")
def gaps_with_clearance(t, clearance: float = 5.0):
    """Metric workflow: occupied polygons grow by the clearance (round corners) before they are subtracted."""
    w = t("surveys")
    f = FS.gap_figures(FS.free_pieces(w, FS.grown_polygons(observed_shapes(t), clearance), winding=True), w)
    return f.select("survey_id", "gap_id", F.round("area", 2).alias("area_m2"), F.round("cx", 2).alias("cx"), F.round("cy", 2).alias("cy"), "touches_boundary")


@query("a02_remaining_ground", """
WITH ground AS (
  SELECT survey_id, x0, y0, x1, (y0 + y1) / 2 AS y1 FROM parcels UNION ALL SELECT survey_id, x0, (y0 + y1) / 2, (x0 + x1) / 2, y1 FROM parcels
  UNION ALL SELECT survey_id, x0, y0, x1, y1 FROM buildings UNION ALL SELECT survey_id, x0, y0, x1, y1 FROM parcels WHERE lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%hot%'
  UNION ALL SELECT survey_id, x0, y0, x1, y1 FROM restrictions UNION ALL SELECT survey_id, x1 + 5, y0, x1 + 15, y0 + 10 FROM restrictions),
cells AS (
  SELECT DISTINCT survey_id, i, unnest(generate_series(CAST(b AS BIGINT), CAST(d AS BIGINT) - 1)) AS j FROM (
    SELECT survey_id, b, d, unnest(generate_series(CAST(a AS BIGINT), CAST(c AS BIGINT) - 1)) AS i FROM (
      SELECT g.survey_id, (greatest(x0 - 5, wx0) - wx0) / 5 AS a, (greatest(y0 - 5, wy0) - wy0) / 5 AS b, (least(x1 + 5, wx1) - wx0) / 5 AS c, (least(y1 + 5, wy1) - wy0) / 5 AS d
      FROM ground g JOIN surveys s ON g.survey_id = s.survey_id) q WHERE a < c AND b < d) r)
SELECT s.survey_id, CAST(4000000 - 25 * count(c.i) AS DOUBLE) AS remaining_m2 FROM surveys s LEFT JOIN cells c ON s.survey_id = c.survey_id GROUP BY s.survey_id""")
def remaining_ground(t, clearance: float = 5.0):
    """Ground left in each window when the same polygons grow by 5 m with mitred corners: holes of 10 m close, all sides stay on a lattice."""
    w = t("surveys")
    pieces = FS.free_pieces(w, FS.grown_polygons(observed_shapes(t), clearance, "mitre"), winding=True)
    left = pieces.groupBy("survey_id").agg(F.sum(G.piece_area()).alias("left"))
    return w.join(left, "survey_id", "left").select("survey_id", F.round(F.coalesce("left", F.lit(0.0)), 2).alias("remaining_m2"))


@query("a01_gap_outlines", f"""WITH RECURSIVE {_CELLS},
c AS (SELECT survey_id, label, unnest(generate_series(i0, i1)) AS i, j FROM lab),
sides AS (SELECT c.survey_id, c.label, 4 - count(n.i) AS open_sides FROM c LEFT JOIN fre n ON n.survey_id = c.survey_id AND abs(n.i - c.i) + abs(n.j - c.j) = 1 GROUP BY c.survey_id, c.label, c.i, c.j),
p AS (SELECT survey_id, label, CAST(sum(open_sides) * 20 AS DOUBLE) AS length FROM sides GROUP BY survey_id, label)
SELECT g.survey_id, CAST(g.ax AS DOUBLE) AS anchor_x, CAST(g.ay AS DOUBLE) AS anchor_y, round(g.area, 2) AS outlined_m2, p.length AS outline_m FROM gap g JOIN p ON g.label = p.label""")
def gap_outlines(t):
    """Rings of every gap: signed areas add up to the gap, lengths to its outline."""
    from groundsift.operators import outlines as O

    w = t("surveys")
    pieces = FS.free_pieces(w, occupied(t))
    anchor = FS.gap_figures(pieces, w).select("survey_id", "gap", F.col("anchor.xl0").alias("anchor_x"), F.col("anchor.y0").alias("anchor_y"))
    rings = O.ring_figures(O.link_rings(O.boundary_sides(pieces)))
    g = rings.groupBy("survey_id", "gap").agg(F.round(F.sum("area"), 2).alias("outlined_m2"), F.round(F.sum("length"), 2).alias("outline_m"))
    return g.join(anchor, ["survey_id", "gap"]).drop("gap")


@query("l09_recalculation", f"""WITH RECURSIVE {_CELLS},
n AS (SELECT survey_id, count(*) AS source_rows FROM occ GROUP BY survey_id)
SELECT g.survey_id, count(*) FILTER (WHERE area >= {MIN_AREA}) AS parent_gaps, count(*) FILTER (WHERE area >= 5000 AND is_wide) AS gaps,
  count(*) FILTER (WHERE area >= 5000 AND is_wide) AS with_parent, any_value(n.source_rows) AS source_rows FROM gap g JOIN n ON g.survey_id = n.survey_id GROUP BY g.survey_id""")
def recalculation(t):
    """Free ground once more, with new parameters, from the layers of a saved version; the result names the one it came from."""
    path = scratch_folder(t.spark, "surveys")
    layers = None
    for name in ("parcels", "buildings"):
        rows = t(name).select(F.lit(name).alias("layer"), "survey_id", "id", *BOX)
        layers = rows if layers is None else layers.unionByName(rows)
    version = sinks.save(layers, f"{path}/layers")

    def result(min_area, min_width, parent):
        stored = sinks.load_version(t.spark, f"{path}/layers", version)  # refused if it no longer fits its address
        _, f = settled_gaps(t("surveys"), stored.select("survey_id", *BOX, *FS.box_flat()), min_width)
        kept = f.where((F.col("area") >= min_area) & F.col("wide")).select(
            "survey_id", "gap_id", F.round("area", 2).alias("area_m2"), F.lit(version).alias("layers"), F.lit(min_area).alias("min_area"), F.lit(min_width).alias("min_width"), F.lit(parent).cast("string").alias("parent_id"))
        name = sinks.save(cut(kept), f"{path}/results")
        return name, sinks.load_version(t.spark, f"{path}/results", name)

    parent_id, parent = result(MIN_AREA, 0.0, None)
    _, new = result(5000.0, MIN_WIDTH, parent_id)
    stored = sinks.load_version(t.spark, f"{path}/layers", version)
    j = t("surveys").select("survey_id").join(parent.groupBy("survey_id").agg(F.count("*").alias("parent_gaps")), "survey_id", "left")
    j = j.join(new.groupBy("survey_id").agg(F.count("*").alias("gaps"), F.count_if(F.col("parent_id") == parent_id).alias("with_parent")), "survey_id", "left")
    j = j.join(stored.groupBy("survey_id").agg(F.count("*").alias("source_rows")), "survey_id")
    return j.fillna(0, ["parent_gaps", "gaps", "with_parent"])
