"""J-series on boxes: overlays, nearest objects, lots and number matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundsift.functions import text as X
from groundsift.operators.freespace import FLAT, box_flat, covered_pieces
from groundsift.operators.knn import connected, nearest_polygons
from groundsift.operators.overlap import box_union_area, clip_box
from groundsift.operators.tiles import box_distance, box_overlap, distance_join, piece_join, tile_join
from groundsift.registry import query
from groundsift.session import spread

BOX = ["x0", "y0", "x1", "y1"]


def candidates(t):
    """Published plots as candidates: offers and auctions."""
    return t("offers").select("survey_id", "id", F.when(F.col("p_type") == "ECONOMY", "offer").otherwise("auction").alias("kind"),
                              "k", "cad_num", *BOX)


def overlay_layers(t):
    """Four overlay layers in one table, ``layer`` naming each."""
    def pick(df, layer):
        return df.select("survey_id", layer.alias("layer"), "id", *BOX)
    return (pick(t("offers"), F.when(F.col("p_type") == "ECONOMY", "free").otherwise("auction"))
            .unionByName(pick(t("zones"), F.lit("pzz"))).unionByName(pick(t("restrictions"), F.lit("restrictions"))))


_CAND = "cand AS (SELECT survey_id, id, k, cad_num, CASE WHEN p_type = 'ECONOMY' THEN 'offer' ELSE 'auction' END AS kind, x0, y0, x1, y1 FROM offers)"
_LAYERS = """lay AS (SELECT survey_id, CASE WHEN p_type = 'ECONOMY' THEN 'free' ELSE 'auction' END AS layer, id, x0, y0, x1, y1 FROM offers
 UNION ALL SELECT survey_id, 'pzz', id, x0, y0, x1, y1 FROM zones UNION ALL SELECT survey_id, 'restrictions', id, x0, y0, x1, y1 FROM restrictions)"""
_OV = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_DIST = ("sqrt(power(greatest(0, b.x0 - a.x1, a.x0 - b.x1), 2) + power(greatest(0, b.y0 - a.y1, a.y0 - b.y1), 2))")


def notched(df):
    """Boxes without their upper right quarter, as flat polygons; keeps survey, id and box."""
    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    return df.select("survey_id", "id", *BOX, F.array(x0, x1, x1, xm, xm, x0, x0).alias("xs"), F.array(y0, y0, ym, ym, y1, y1, y0).alias("ys"), F.array(F.lit(7)).alias("sizes"))


def holed(df):
    """Boxes with a square hole of 10 m in their lower left, as flat polygons; keeps survey, id and box."""
    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    return df.select("survey_id", "id", *BOX, F.array(x0, x1, x1, x0, x0, x0 + 10, x0 + 10, x0 + 20, x0 + 20, x0 + 10).alias("xs"),
                     F.array(y0, y0, y1, y1, y0, y0 + 10, y0 + 20, y0 + 20, y0 + 10, y0 + 10).alias("ys"), F.array(F.lit(5), F.lit(5)).alias("sizes"))


def overlays(left, right, left_keys, right_keys):
    """Common area of the polygons of both sides, pair by pair; ``left`` and ``right`` carry survey, keys and flat geometry."""
    pieces = lambda df, keys: covered_pieces(spread(df.select("survey_id", *keys, *FLAT), *keys), ["survey_id", *keys])
    return piece_join(pieces(left, left_keys), pieces(right, right_keys), left_keys, right_keys)


def _signed(table: str, columns: str, shape: str) -> str:
    """SQL: the boxes of a notched or holed polygon, with their sign."""
    if shape == "notched":
        return (f"SELECT {columns}, x0, y0, x1, (y0 + y1) / 2 AS y1, 1 AS s FROM {table} UNION ALL SELECT {columns}, x0, (y0 + y1) / 2, (x0 + x1) / 2, y1, 1 FROM {table}")
    return f"SELECT {columns}, x0, y0, x1, y1, 1 AS s FROM {table} UNION ALL SELECT {columns}, x0 + 10, y0 + 10, x0 + 20, y0 + 20, -1 FROM {table}"


@query("j02_candidate_overlays", f"""
WITH {_CAND}, ca AS ({_signed("cand", "survey_id, id, kind", "notched")}),
lb AS ({_signed("offers", "survey_id, CASE WHEN p_type = 'ECONOMY' THEN 'free' ELSE 'auction' END AS layer, id", "notched")} UNION ALL {_signed("zones", "survey_id, 'pzz' AS layer, id", "holed")}
  UNION ALL {_signed("restrictions", "survey_id, 'restrictions' AS layer, id", "holed")}),
o AS (SELECT a.survey_id, a.id, a.kind, b.layer, b.id AS feature_id, sum(a.s * b.s * {_OV}) AS area_m2 FROM ca a JOIN lb b ON a.survey_id = b.survey_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY ALL)
SELECT survey_id, id, kind, layer, feature_id, round(area_m2, 2) AS area_m2 FROM o WHERE area_m2 > 0.01""")
def candidate_overlays(t):
    """Notched candidates over four layers of notched and holed polygons."""
    kind = candidates(t).select("id", "kind")
    layer = F.when(F.col("p_type") == "ECONOMY", "free").otherwise("auction")
    parts = (notched(t("offers")).join(t("offers").select("id", layer.alias("layer")), "id").unionByName(holed(t("zones")).withColumn("layer", F.lit("pzz")))
             .unionByName(holed(t("restrictions")).withColumn("layer", F.lit("restrictions"))))
    found = overlays(notched(candidates(t)), parts, ["id"], ["layer", "id"])
    return found.join(kind, "id").select("survey_id", "id", "kind", F.col("r_layer").alias("layer"), F.col("r_id").alias("feature_id"), F.round("area_m2", 2).alias("area_m2"))


@query("j03_window_overlays", f"""
WITH lay AS ({_signed("restrictions", "survey_id, 'restrictions' AS role, s_name AS payload, id", "holed")} UNION ALL {_signed("zones", "survey_id, 'pzz' AS role, s_name AS payload, id", "holed")}
 UNION ALL {_signed("(SELECT * FROM context WHERE mode = 'quarters')", "survey_id, 'quarters' AS role, quarter_num AS payload, id", "notched")}),
o AS (SELECT a.survey_id, a.id, b.role, b.payload, b.id AS feature_id, sum(b.s * {_OV}) AS area_m2 FROM buildings a JOIN lay b ON a.survey_id = b.survey_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY ALL)
SELECT survey_id, id, role, payload, count(*) AS n, round(sum(area_m2), 2) AS area_m2 FROM o WHERE area_m2 > 0.01 GROUP BY ALL""")
def window_overlays(t):
    """Buildings over restrictions and zones with holes and notched quarters."""
    def pick(shape, df, role, payload):
        return shape(df).join(df.select("id", F.lit(role).alias("role"), F.col(payload).alias("payload")), "id")
    layers = (pick(holed, t("restrictions"), "restrictions", "s_name").unionByName(pick(holed, t("zones"), "pzz", "s_name"))
              .unionByName(pick(notched, t("context").where("mode = 'quarters'"), "quarters", "quarter_num")))
    boxes = t("buildings").select("survey_id", "id", *box_flat())
    return (overlays(boxes, layers, ["id"], ["role", "payload", "id"])
            .groupBy("survey_id", "id", F.col("r_role").alias("role"), F.col("r_payload").alias("payload"))
            .agg(F.count("*").alias("n"), F.round(F.sum("area_m2"), 2).alias("area_m2")))


def _apart(a: str, b: str) -> str:
    """SQL: distance of two boxes given as four expressions each."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a, b
    return f"sqrt(power(greatest(0, {bx0} - {ax1}, {ax0} - {bx1}), 2) + power(greatest(0, {by0} - {ay1}, {ay0} - {by1}), 2))"


def _halves(t: str) -> list[tuple[str, ...]]:
    return [(f"{t}.x0", f"{t}.y0", f"{t}.x1", f"({t}.y0 + {t}.y1) / 2"), (f"{t}.x0", f"({t}.y0 + {t}.y1) / 2", f"({t}.x0 + {t}.x1) / 2", f"{t}.y1")]


_NOTCHED = "least(" + ", ".join(_apart(a, b) for a in _halves("a") for b in _halves("b")) + ")"


@query("j04_nearest_parcels", f"""
WITH {_CAND}, d AS (SELECT a.survey_id, a.id, b.id AS parcel_id, {_NOTCHED} AS dist FROM cand a JOIN parcels b ON a.survey_id = b.survey_id),
r AS (SELECT *, row_number() OVER (PARTITION BY survey_id, id ORDER BY dist, parcel_id) AS rank FROM d)
SELECT survey_id, id, parcel_id, rank, round(dist, 1) AS distance_m FROM r WHERE rank <= 5""")
def nearest_parcels(t):
    """Five nearest parcels of every candidate, all of them notched polygons."""
    return (nearest_polygons(notched(candidates(t)), notched(t("parcels")), 5)
            .select("survey_id", "id", F.col("r_id").alias("parcel_id"), "rank", F.round("distance_m", 1).alias("distance_m")))


#: land-use texts that mark a parcel as road ground; the lift names colours instead
_ROAD_WORDS = ("red", "hot")


def road_parcels(t):
    use = F.lower(F.translate("p_name", "–—", "--"))
    hit = use.contains(_ROAD_WORDS[0])
    for w in _ROAD_WORDS[1:]:
        hit = hit | use.contains(w)
    return t("parcels").where(hit)


@query("p08_road_parcels", """
SELECT survey_id, id, p_name AS land_use FROM parcels
WHERE lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%hot%'""")
def road_designation(t):
    return road_parcels(t).select("survey_id", "id", F.col("p_name").alias("land_use"))


@query("j05_nearest_road", f"""
WITH {_CAND}, d AS (SELECT a.survey_id, a.id, b.id AS road_id, {_NOTCHED} AS dist
  FROM cand a JOIN parcels b ON a.survey_id = b.survey_id WHERE lower(b.p_name) LIKE '%red%' OR lower(b.p_name) LIKE '%hot%'),
r AS (SELECT *, row_number() OVER (PARTITION BY survey_id, id ORDER BY dist, road_id) AS rank FROM d)
SELECT survey_id, id, road_id, round(dist, 1) AS distance_m, false AS legal_access_confirmed FROM r WHERE rank = 1""")
def nearest_road(t):
    return (nearest_polygons(notched(candidates(t)), notched(road_parcels(t)), 1)
            .select("survey_id", "id", F.col("r_id").alias("road_id"), F.round("distance_m", 1).alias("distance_m"),
                    F.lit(False).alias("legal_access_confirmed")))


@query("j06_neighbours_within", f"""
WITH {_CAND} SELECT a.survey_id, a.id, b.id AS neighbour_id, round({_NOTCHED}, 2) AS distance_m
FROM cand a JOIN parcels b ON a.survey_id = b.survey_id WHERE {_NOTCHED} <= 21""")
def neighbours_within(t, clearance: float = 20.0):
    """Parcels not further from a candidate than its clearance and a metre; boxes only preselect."""
    near = distance_join(notched(candidates(t)), notched(t("parcels")), max(clearance + 1, 5.0)).drop("distance_m")
    found = connected(near).where(F.col("c.d") <= max(clearance + 1, 5.0))
    return found.select("survey_id", "id", F.col("r_id").alias("neighbour_id"), F.round("c.d", 2).alias("distance_m"))


@query("j07_context_matches", f"""
WITH {_CAND}
SELECT a.survey_id, a.id, b.mode, b.id AS feature_id,
  CASE WHEN b.mode = 'red_lines' THEN 0.0 ELSE round({_OV}, 2) END AS area_m2,
  CASE WHEN b.mode = 'red_lines' THEN CAST(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS DOUBLE) END AS length_m,
  CASE WHEN b.mode = 'settlements' THEN b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1 END AS spatially_inside,
  CASE WHEN b.mode = 'quarters' THEN b.quarter_num LIKE '%:0000' END AS aggregate_zero_quarter,
  CASE WHEN b.mode = 'quarters' AND b.c_acctbal >= 0 AND b.c_acctbal = floor(b.c_acctbal) THEN CAST(b.c_acctbal AS BIGINT) END AS parcels_without_geometry
FROM cand a JOIN context b ON a.survey_id = b.survey_id
WHERE CASE WHEN b.mode = 'red_lines' THEN a.x0 <= b.x1 AND b.x0 <= a.x1 AND b.y0 BETWEEN a.y0 AND a.y1 ELSE {_OV} > 0.01 END""")
def context_matches(t):
    """Nine layers at once; red lines are lines (the lower side of their box) and match by touching."""
    linear = F.col("mode") == "red_lines"
    ctx = t("context").withColumn("y1", F.when(linear, F.col("y0")).otherwise(F.col("y1")))
    pairs = tile_join(candidates(t), ctx.select("survey_id", "id", "mode", "quarter_num", "c_acctbal", *BOX), touch=True)
    line = F.col("r_mode") == "red_lines"
    length = F.greatest(F.lit(0.0), F.least("x1", "r_x1") - F.greatest("x0", "r_x0"))
    covers = (F.col("r_x0") <= F.col("x0")) & (F.col("r_y0") <= F.col("y0")) & (F.col("r_x1") >= F.col("x1")) & (F.col("r_y1") >= F.col("y1"))
    quarter = F.col("r_mode") == "quarters"
    last = F.substring_index("r_quarter_num", ":", -1)
    return (pairs.withColumn("a", box_overlap()).where(line | (F.col("a") > 0.01))
            .select("survey_id", "id", F.col("r_mode").alias("mode"), F.col("r_id").alias("feature_id"),
                    F.when(line, F.lit(0.0)).otherwise(F.round("a", 2)).alias("area_m2"), F.when(line, length).alias("length_m"),
                    F.when(F.col("r_mode") == "settlements", covers).alias("spatially_inside"),
                    F.when(quarter, last.rlike("^0+$")).alias("aggregate_zero_quarter"),
                    F.when(quarter, X.count_or_null(F.col("r_c_acctbal"))).alias("parcels_without_geometry")))


_COVERS = "b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1"


def _covering(t, layers):
    pairs = tile_join(candidates(t), layers)
    covers = (F.col("r_x0") <= F.col("x0")) & (F.col("r_y0") <= F.col("y0")) & (F.col("r_x1") >= F.col("x1")) & (F.col("r_y1") >= F.col("y1"))
    return pairs.withColumn("a", box_overlap()).where("a > 0.01").withColumn("spatially_covers", covers)


@query("j08_plan_layer_matches", f"""
WITH {_CAND}, lay AS (SELECT survey_id, 'functional' AS mode, id, x0, y0, x1, y1 FROM zones UNION ALL SELECT survey_id, 'roads', id, x0, y0, x1, y1 FROM restrictions)
SELECT a.survey_id, a.id, b.mode, b.id AS feature_id, round({_OV}, 2) AS area_m2, {_COVERS} AS spatially_covers, 'done' AS source_state
FROM cand a JOIN lay b ON a.survey_id = b.survey_id WHERE {_OV} > 0.01""")
def plan_matches(t):
    layers = (t("zones").select("survey_id", F.lit("functional").alias("mode"), "id", *BOX)
              .unionByName(t("restrictions").select("survey_id", F.lit("roads").alias("mode"), "id", *BOX)))
    return _covering(t, layers).select("survey_id", "id", F.col("r_mode").alias("mode"), F.col("r_id").alias("feature_id"),
                                       F.round("a", 2).alias("area_m2"), "spatially_covers", F.lit("done").alias("source_state"))


@query("j09_zoning_matches", f"""
WITH {_CAND} SELECT a.survey_id, a.id, b.id AS zone_id, b.s_name AS symbol, round({_OV}, 2) AS area_m2, {_COVERS} AS spatially_covers, false AS used_for_exclusion
FROM cand a JOIN zones b ON a.survey_id = b.survey_id WHERE {_OV} > 0.01""")
def zoning_matches(t):
    return _covering(t, t("zones").select("survey_id", "id", "s_name", *BOX)).select(
        "survey_id", "id", F.col("r_id").alias("zone_id"), F.col("r_s_name").alias("symbol"), F.round("a", 2).alias("area_m2"),
        "spatially_covers", F.lit(False).alias("used_for_exclusion"))


@query("j10_boundary_hypotheses", f"""
WITH {_CAND}, hyp AS (SELECT survey_id, 1 AS h, wx0 + 300 AS x0, wy0 + 300 AS y0, wx1 - 300 AS x1, wy1 - 300 AS y1 FROM surveys
  UNION ALL SELECT survey_id, 2, wx0 + 360, wy0 + 300, wx1 - 240, wy1 - 300 FROM surveys),
r AS (SELECT a.survey_id, a.id, {_OV} AS inside, (a.x1 - a.x0) * (a.y1 - a.y0) AS own,
  CASE WHEN {_COVERS} THEN 'inside' WHEN {_OV} <= 0.01 THEN 'outside' ELSE 'crosses' END AS rel FROM cand a JOIN hyp b ON a.survey_id = b.survey_id)
SELECT survey_id, id, CASE WHEN count(DISTINCT rel) = 1 THEN min(rel) ELSE 'varies' END AS relation, count(DISTINCT rel) = 1 AS operations_agree,
  round(min(inside), 2) AS least_inside_m2, round(max(own - inside), 2) AS most_outside_m2 FROM r GROUP BY survey_id, id""")
def boundary_hypotheses(t):
    """Candidate against alternative boundaries of its window; disagreement is reported, not resolved."""
    w = t("surveys")
    hyp = w.select("survey_id", F.explode(F.array(F.struct(F.lit(0.0).alias("d")), F.struct(F.lit(60.0).alias("d")))).alias("h"), "wx0", "wy0", "wx1", "wy1") \
        .select("survey_id", (F.col("wx0") + 300 + F.col("h.d")).alias("r_x0"), (F.col("wy0") + 300).alias("r_y0"),
                (F.col("wx1") - 300 + F.col("h.d")).alias("r_x1"), (F.col("wy1") - 300).alias("r_y1"))
    pairs = candidates(t).join(hyp, "survey_id").withColumn("inside", box_overlap())
    covers = (F.col("r_x0") <= F.col("x0")) & (F.col("r_y0") <= F.col("y0")) & (F.col("r_x1") >= F.col("x1")) & (F.col("r_y1") >= F.col("y1"))
    rel = F.when(covers, "inside").when(F.col("inside") <= 0.01, "outside").otherwise("crosses")
    own = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return (pairs.withColumn("rel", rel).groupBy("survey_id", "id")
            .agg(F.min("rel").alias("lo"), F.max("rel").alias("hi"), F.round(F.min("inside"), 2).alias("least_inside_m2"),
                 F.round(F.max(own - F.col("inside")), 2).alias("most_outside_m2"))
            .select("survey_id", "id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("varies").alias("relation"),
                    (F.col("lo") == F.col("hi")).alias("operations_agree"), "least_inside_m2", "most_outside_m2"))


# ---- numbers, lots ------------------------------------------------------------------------------

_CANON = "concat('90:12:', CAST({w} AS VARCHAR), ':', CAST({k} AS VARCHAR))"
_GEOM_SQL = f"""geo AS (SELECT {_CANON.format(w='survey_id', k='k')} AS number, id, survey_id, x0, y0, x1, y1 FROM parcels
 UNION ALL SELECT {_CANON.format(w='survey_id', k='k')}, concat('o', id), survey_id, x0, y0, x1, y1 FROM offers)"""


def number_geometries(t):
    """Canonical number to observed geometry, over every layer that names numbers."""
    return (t("parcels").select("cad_num", "id", "survey_id", *BOX)
            .unionByName(t("offers").select("cad_num", F.concat(F.lit("o"), "id").alias("id"), "survey_id", *BOX))
            .withColumn("number", X.canonical(F.col("cad_num"))).where("number IS NOT NULL").drop("cad_num"))


@query("j11_number_geometry", f"""WITH {_GEOM_SQL} SELECT number, count(*) AS features, min(id) AS first_id FROM geo GROUP BY number""")
def number_index(t):
    return number_geometries(t).groupBy("number").agg(F.count("*").alias("features"), F.min("id").alias("first_id"))


_LOTNUM = f"ln AS (SELECT DISTINCT lot_id, {_CANON.format(w='CAST(floor(k / 200.0) AS BIGINT)', k='k')} AS number FROM lot_numbers)"


def lot_number_pairs(t):
    return t("lot_numbers").select("lot_id", X.canonical(F.col("cad_num")).alias("number")).distinct()


@query("j12_geometry_precedence", f"""
WITH {_GEOM_SQL}, {_LOTNUM}, dated AS (SELECT {_CANON.format(w='CAST(floor(c_custkey / 200.0) AS BIGINT)', k='c_custkey')} AS number, c_nationkey FROM customer),
allobs AS (SELECT number, 'survey' AS source, 0 AS prio FROM geo UNION ALL
  SELECT number, concat('lookup-', CAST(c_nationkey AS VARCHAR)), 1 FROM dated WHERE number IN (SELECT number FROM ln)),
r AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY prio, source) AS rn FROM allobs)
SELECT number, source FROM r WHERE rn = 1""")
def geometry_precedence(t):
    """Current survey geometry beats a dated lookup; lookups survive only for numbers a lot names."""
    survey = number_geometries(t).select("number", F.lit("survey").alias("source"), F.lit(0).alias("prio"))
    dated = t("customer").select(F.concat_ws(":", F.lit("90"), F.lit("12"), F.floor(F.col("c_custkey") / 200).cast("string"),
                                             F.col("c_custkey").cast("string")).alias("number"),
                                 F.concat(F.lit("lookup-"), F.col("c_nationkey").cast("string")).alias("source"), F.lit(1).alias("prio"))
    needed = dated.join(lot_number_pairs(t).select("number"), "number", "left_semi")
    # a minimum combines before its shuffle, so a number seen very often stays cheap
    return (survey.unionByName(needed).groupBy("number").agg(F.min(F.struct("prio", "source")).alias("best")).select("number", "best.source"))


def lot_matches(t):
    """Lot numbers with the geometry observed for them and the lot's survey window."""
    lots = t("lots").select("lot_id", "survey_id").join(t("surveys"), "survey_id")
    geo = number_geometries(t).withColumnRenamed("survey_id", "geo_survey")
    return lots.join(lot_number_pairs(t), "lot_id", "left").join(geo, "number", "left")


_LOTM = f"""{_GEOM_SQL}, {_LOTNUM}, m AS (SELECT l.lot_id, l.survey_id, n.number, g.id, g.x0, g.y0, g.x1, g.y1, s.wx0, s.wy0, s.wx1, s.wy1
 FROM lots l JOIN surveys s ON l.survey_id = s.survey_id LEFT JOIN ln n ON l.lot_id = n.lot_id LEFT JOIN geo g ON n.number = g.number)"""
_IN = "(least(x1, wx1) - greatest(x0, wx0) > 0 AND least(y1, wy1) - greatest(y0, wy0) > 0)"


@query("j13_lot_spatial_state", f"""
WITH {_LOTM}
SELECT lot_id, survey_id, coalesce(bool_or({_IN}), false) AS in_survey,
  CASE WHEN coalesce(bool_or({_IN}), false) THEN 'inside' WHEN count(number) > 0 AND bool_and(id IS NOT NULL) THEN 'outside' ELSE 'unknown' END AS spatial_state,
  count(DISTINCT CASE WHEN {_IN} THEN number END) AS matched_numbers
FROM m GROUP BY lot_id, survey_id""")
def lot_spatial_state(t):
    """Inside as soon as one number lies in the window; outside only when every number is located."""
    inside = ((F.least("x1", "wx1") - F.greatest("x0", "wx0") > 0) & (F.least("y1", "wy1") - F.greatest("y0", "wy0") > 0))
    g = (lot_matches(t).groupBy("lot_id", "survey_id")
         .agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("in_survey"), F.bool_and(F.col("id").isNotNull()).alias("located"),
              F.count("number").alias("n"), F.count_distinct(F.when(inside, F.col("number"))).alias("matched_numbers")))
    return g.select("lot_id", "survey_id", "in_survey", F.when(F.col("in_survey"), "inside").when((F.col("n") > 0) & F.col("located"), "outside")
                    .otherwise("unknown").alias("spatial_state"), "matched_numbers")


@query("j14_candidate_lots", f"""
WITH {_CAND}, {_LOTM}, f AS (SELECT DISTINCT a.survey_id, a.id, m.lot_id, greatest(a.x0, m.x0) AS x0, greatest(a.y0, m.y0) AS y0, least(a.x1, m.x1) AS x1, least(a.y1, m.y1) AS y1
  FROM cand a JOIN (SELECT * FROM m WHERE {_IN}) AS m ON a.survey_id = m.survey_id AND a.x0 < m.x1 AND m.x0 < a.x1 AND a.y0 < m.y1 AND m.y0 < a.y1),
c AS (SELECT DISTINCT survey_id, id, lot_id, i, j FROM (SELECT *, unnest(generate_series(CAST(x0 / 20 AS BIGINT), CAST(x1 / 20 AS BIGINT) - 1)) AS i FROM f) AS q,
   LATERAL (SELECT unnest(generate_series(CAST(q.y0 / 20 AS BIGINT), CAST(q.y1 / 20 AS BIGINT) - 1)) AS j) AS v)
SELECT survey_id, id, lot_id, CAST(count(*) * 400 AS DOUBLE) AS overlap_m2 FROM c GROUP BY survey_id, id, lot_id""")
def candidate_lots(t):
    """Overlap of a candidate with the union of a lot's matching features."""
    inside = ((F.least("x1", "wx1") - F.greatest("x0", "wx0") > 0) & (F.least("y1", "wy1") - F.greatest("y0", "wy0") > 0))
    feats = lot_matches(t).where(inside).select("survey_id", "lot_id", *BOX).distinct()
    pairs = tile_join(candidates(t).select("survey_id", "id", *BOX), feats)
    clipped = clip_box(pairs, "r_x0", "r_y0", "r_x1", "r_y1").withColumnRenamed("r_lot_id", "lot_id")
    return (box_union_area(clipped, ["survey_id", "id", "lot_id"], "overlap_m2").where("overlap_m2 > 0.01")
            .select("survey_id", "id", "lot_id", F.round("overlap_m2", 2).alias("overlap_m2")))


_MENTION = f"""men AS (SELECT DISTINCT doc_id, page, number FROM (
 SELECT doc_id, 2 AS page, concat('90:12:', CAST(CAST(floor(doc_id / 100.0) AS BIGINT) AS VARCHAR), ':', CAST(doc_id * 2 AS VARCHAR)) AS number FROM documents
 UNION ALL SELECT doc_id, 2, concat('90:12:', CAST(CAST(floor(doc_id / 100.0) AS BIGINT) AS VARCHAR), ':', CAST(doc_id * 2 + 1 AS VARCHAR)) FROM documents
 UNION ALL SELECT doc_id, 3, concat('90:12:', CAST(CAST(floor(doc_id / 100.0) AS BIGINT) AS VARCHAR), ':', CAST(doc_id * 2 AS VARCHAR)) FROM documents WHERE lang = 'fr'))"""


def mentions(t):
    """Distinct (document, page, number) named in page text."""
    return t("doc_pages").select("doc_id", "page", F.explode(X.numbers(F.col("text"))).alias("number")).distinct()


@query("j15_candidate_documents", f"""
WITH {_CAND}, {_MENTION}, near AS (SELECT a.survey_id, a.id, {_CANON.format(w='b.survey_id', k='b.k')} AS number FROM cand a JOIN parcels b ON a.survey_id = b.survey_id
   WHERE {_DIST} <= 10 UNION SELECT survey_id, id, {_CANON.format(w='survey_id', k='k')} FROM cand),
j AS (SELECT n.survey_id, n.id, m.doc_id, m.number, m.page FROM near n JOIN men m ON n.number = m.number)
SELECT survey_id, id, doc_id, string_agg(DISTINCT number, ',' ORDER BY number) AS numbers, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS pages
FROM j GROUP BY survey_id, id, doc_id""")
def candidate_documents(t):
    """Documents naming the candidate's own number or that of a parcel at most 10 m away."""
    c = candidates(t)
    near = distance_join(c.select("survey_id", "id", *BOX), t("parcels").select("survey_id", "cad_num", *BOX), 10.0)
    wanted = (near.select("survey_id", "id", X.canonical(F.col("r_cad_num")).alias("number"))
              .unionByName(c.select("survey_id", "id", X.canonical(F.col("cad_num")).alias("number"))).distinct())
    return (wanted.join(mentions(t), "number").groupBy("survey_id", "id", "doc_id")
            .agg(F.array_join(F.sort_array(F.collect_set("number")), ",").alias("numbers"),
                 F.array_join(F.sort_array(F.collect_set(F.col("page").cast("string"))), ",").alias("pages")))


@query("j16_mentions_in_area", f"""
WITH {_MENTION} SELECT DISTINCT m.doc_id, m.number FROM men m WHERE m.number IN (
  SELECT {_CANON.format(w='p.survey_id', k='p.k')} FROM parcels p JOIN surveys s ON p.survey_id = s.survey_id WHERE least(p.x1, s.wx1) > greatest(p.x0, s.wx0) AND least(p.y1, s.wy1) > greatest(p.y0, s.wy0))""")
def mentions_in_area(t):
    inside = (t("parcels").join(t("surveys"), "survey_id")
              .where((F.least("x1", "wx1") > F.greatest("x0", "wx0")) & (F.least("y1", "wy1") > F.greatest("y0", "wy0"))))
    return mentions(t).select("doc_id", "number").distinct().join(inside.select(X.canonical(F.col("cad_num")).alias("number")), "number", "left_semi") \
        .select("doc_id", "number")


@query("j17_page_number_matches", f"""
WITH {_MENTION}, par AS (SELECT {_CANON.format(w='survey_id', k='k')} AS number, id FROM parcels)
SELECT m.doc_id, m.page, count(p.id) AS matched, count(*) FILTER (WHERE p.id IS NULL) AS unmatched, coalesce(string_agg(CASE WHEN p.id IS NULL THEN m.number END, ',' ORDER BY m.number), '') AS unmatched_numbers
FROM (SELECT doc_id, CAST(page AS BIGINT) AS page, number FROM men) m LEFT JOIN par p ON m.number = p.number GROUP BY m.doc_id, m.page""")
def page_number_matches(t):
    par = t("parcels").select(X.canonical(F.col("cad_num")).alias("number"), "id")
    miss = F.col("id").isNull()
    return (mentions(t).join(par, "number", "left").groupBy("doc_id", "page")
            .agg(F.count("id").alias("matched"), F.count_if(miss).alias("unmatched"),
                 F.array_join(F.sort_array(F.collect_set(F.when(miss, F.col("number")))), ",").alias("unmatched_numbers")))


def body_digest(t):
    return t("catalog").select("doc_id", "url", "title", "source", "text", F.sha2("text", 256).alias("sha256"))


@query("j18_same_bytes_conflicts", """
SELECT a.doc_id, count(*) AS conflicts, min(b.url) AS first_url FROM catalog a JOIN catalog b ON sha256(a.text) = sha256(b.text)
WHERE a.url <> b.url AND a.title <> b.title GROUP BY a.doc_id""")
def same_bytes_conflicts(t):
    """How many other documents share a document's bytes under another url and title.

    Counted from grouped totals, never from pairs: all of the digest, less the
    same url, less the same title, plus both the same.
    """
    d = body_digest(t).select("doc_id", "sha256", "url", "title")
    n = lambda name, *k: d.groupBy(*k).agg(F.count("*").alias(name), F.min("url").alias(f"{name}_url"))
    total, by_url = n("n", "sha256"), d.groupBy("sha256", "url").agg(F.count("*").alias("nu"))
    by_title, both = n("nt", "sha256", "title"), d.groupBy("sha256", "url", "title").agg(F.count("*").alias("nb"))
    # the first url of another title: least over titles, or the runner-up when the least is under this title
    ranked = by_title.withColumn("rk", F.row_number().over(Window.partitionBy("sha256").orderBy("nt_url", "title"))).where("rk <= 2")
    first = ranked.where("rk = 1").select("sha256", F.col("title").alias("t1"), F.col("nt_url").alias("u1"))
    second = ranked.where("rk = 2").select("sha256", F.col("nt_url").alias("u2"))
    out = (d.join(total.where("n > 1"), "sha256").join(by_url, ["sha256", "url"]).join(by_title, ["sha256", "title"]).join(both, ["sha256", "url", "title"])
           .withColumn("conflicts", F.col("n") - F.col("nu") - F.col("nt") + F.col("nb")).where("conflicts > 0")
           .join(first, "sha256").join(second, "sha256", "left"))
    return out.select("doc_id", "conflicts", F.when(F.col("t1") == F.col("title"), F.col("u2")).otherwise(F.col("u1")).alias("first_url"))


@query("j19_cross_catalogue_bytes", """
WITH p AS (SELECT doc_id, sha256(text) AS s, url FROM catalog WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src4')),
m AS (SELECT sha256(text) AS s, url FROM catalog WHERE source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4'))
SELECT p.doc_id, count(*) AS same_bytes, min(m.url) AS first_url FROM p JOIN m ON p.s = m.s GROUP BY p.doc_id""")
def cross_catalogue(t):
    d = body_digest(t)
    first = F.col("source").isin("src0", "src1", "src2", "src3", "src4")
    other = d.where(~first).groupBy("sha256").agg(F.count("*").alias("same_bytes"), F.min("url").alias("first_url"))
    return d.where(first).join(other, "sha256").select("doc_id", "same_bytes", "first_url")


_ACT = "printf('%04d-%02d-%02d', 2015 + doc_id % 10, 1 + doc_id % 12, 1 + doc_id % 28) AS date, CAST(doc_id % 97 AS VARCHAR) AS number"


def acts(t):
    """Identity of each document from its act page."""
    a = t("doc_pages").where("page = 2").select("doc_id", "survey_id", X.own_act(F.col("text")).alias("act"))
    return a.where("act IS NOT NULL").select("doc_id", "survey_id", "act.date", "act.number")


@query("j20_reference_documents", f"""
WITH a AS (SELECT doc_id, {_ACT} FROM documents), r AS (SELECT doc_id, printf('%04d-%02d-%02d', 2015 + (doc_id + 5) % 10, 1 + (doc_id + 5) % 12, 1 + (doc_id + 5) % 28) AS date, CAST((doc_id + 5) % 97 AS VARCHAR) AS number FROM documents)
SELECT r.doc_id, r.date, r.number, count(a.doc_id) AS observed, min(a.doc_id) AS first_doc FROM r LEFT JOIN a ON r.date = a.date AND r.number = a.number GROUP BY r.doc_id, r.date, r.number""")
def reference_documents(t):
    """Each document refers to the act numbered five documents on; how many observed documents are that act."""
    ref = t("documents").select("doc_id", X.act_identity(F.format_string(
        "от %02d.%02d.%04d № %d", (F.lit(1) + (F.col("doc_id") + 5) % 28).cast("int"), (F.lit(1) + (F.col("doc_id") + 5) % 12).cast("int"),
        (F.lit(2015) + (F.col("doc_id") + 5) % 10).cast("int"), (F.col("doc_id") + 5) % 97)).alias("ref"))
    known = acts(t).groupBy("date", "number").agg(F.count("*").alias("observed"), F.min("doc_id").alias("first_doc"))
    return (ref.select("doc_id", "ref.date", "ref.number").join(known, ["date", "number"], "left")
            .select("doc_id", "date", "number", F.coalesce("observed", F.lit(0)).alias("observed"), "first_doc"))


@query("j21_cancellations", f"""
WITH a AS (SELECT doc_id, {_ACT} FROM documents), c AS (SELECT doc_id AS by_doc, printf('%04d-%02d-%02d', 2015 + (doc_id + 7) % 10, 1 + (doc_id + 7) % 12, 1 + (doc_id + 7) % 28) AS date, CAST((doc_id + 7) % 97 AS VARCHAR) AS number FROM documents WHERE lang = 'de')
SELECT a.doc_id, count(*) AS cancellation_observations, min(c.by_doc) AS first_by, false AS legal_effect_confirmed FROM a JOIN c ON a.date = c.date AND a.number = c.number WHERE a.doc_id <> c.by_doc GROUP BY a.doc_id""")
def cancellations(t):
    text = F.concat(F.lit("Признать утратившим силу постановление от "), F.format_string(
        "%02d.%02d.%04d № %d", (F.lit(1) + (F.col("doc_id") + 7) % 28).cast("int"), (F.lit(1) + (F.col("doc_id") + 7) % 12).cast("int"),
        (F.lit(2015) + (F.col("doc_id") + 7) % 10).cast("int"), (F.col("doc_id") + 7) % 97))
    c = t("documents").where("lang = 'de'").select(F.col("doc_id").alias("by_doc"), X.act_identity(text).alias("r")) \
        .groupBy("r.date", "r.number").agg(F.count("*").alias("n"), F.min("by_doc").alias("first_by"))
    return (acts(t).join(c, ["date", "number"])  # a text that cancels itself would count once too many; identities differ by construction
            .select("doc_id", F.col("n").alias("cancellation_observations"), "first_by", F.lit(False).alias("legal_effect_confirmed")))
