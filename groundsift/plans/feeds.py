"""S-series: landed answers, cards, listings, traffic, exports and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.functions import text as X
from groundsift.operators.ranking import global_rank
from groundsift.plans.joins import BOX, candidates, number_geometries
from groundsift.registry import query
from groundsift.session import scratch_folder, spread
from groundsift.sources import contours, features, listings, sinks, traffic


def box_of(df):
    return G.box_geom(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))


def answer_rows(t):
    """Feature rows as a spatial service answers them: Mercator boxes, some of them bow ties, some without id."""
    p = t("parcels")
    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    bow = F.array(F.array(F.array(G.point(x0, y0), G.point(x1, y1), G.point(x1, y0), G.point(x0, y1), G.point(x0, y0))))
    geom = F.when(F.col("p_size") == 50, bow).otherwise(box_of(p))
    return p.select(F.concat_ws("/", F.col("survey_id").cast("string"), F.col("p_brand")).alias("response"), F.lit(36368).alias("category"), F.col("id").alias("fid"),
                    F.when(F.col("p_size") == 49, "EPSG:28406").otherwise("EPSG:3857").alias("crs"), geom.alias("geom"), "survey_id", "p_brand", "k")


def feature_json(t):
    """The same rows as GeoJSON text, one feature per line."""
    a = answer_rows(t)
    return a.select("response", "k", F.concat(F.lit('{"type":"Feature","id":"'), "fid", F.lit('","geometry":{"type":"Polygon","crs":"'), "crs",
                                             F.lit('","coordinates":'), F.get_json_object(sinks.geojson_geometry(F.col("geom")), "$.coordinates"),
                                             F.lit('},"properties":{"category":36368,"options":{"cad_num":"n","token":"t"}}}')).alias("value"))


_ANSWER = """ans AS (SELECT concat(CAST(survey_id AS VARCHAR), '/', p_brand) AS response, id, p_size, survey_id, k, x0, y0, x1, y1,
  CASE WHEN p_size = 49 THEN 'crs' WHEN p_size = 50 THEN 'self-intersection' END AS reason FROM parcels)"""


@query("s01_layer_validation", f"""WITH {_ANSWER} SELECT response, count(*) AS received, count(reason) AS bad, count(reason) = 0 AS accepted FROM ans GROUP BY response""")
def layer_validation(t):
    """Layers as text features; one bad feature rejects its layer."""
    schema = "type string, id string, geometry struct<type:string,crs:string,coordinates:array<array<array<double>>>>, properties struct<category:bigint,options:map<string,string>>"
    j = feature_json(t).select("response", F.from_json("value", schema).alias("f"))
    rows = j.select("response", F.col("f.properties.category").alias("category"), F.col("f.id").alias("fid"), F.col("f.geometry.crs").alias("crs"),
                    features.parse_geometry(F.col("f.geometry.type"), F.to_json("f.geometry.coordinates")).alias("geom"))
    return features.accept_strict(features.normalize(rows))


@query("s02_completeness_gate", """
SELECT survey_id, count(*) AS got, CASE WHEN survey_id % 4 = 1 THEN 'further page' WHEN survey_id % 4 = 2 THEN 'count differs' END AS problem FROM parcels GROUP BY survey_id""")
def completeness_gate(t):
    g = t("parcels").groupBy("survey_id").agg(F.count("*").alias("got"))
    declared = F.when(F.col("survey_id") % 4 == 3, "unknown").otherwise((F.col("got") + F.when(F.col("survey_id") % 4 == 2, 1).otherwise(0)).cast("string"))
    return g.select("survey_id", "got", features.response_gate(F.col("survey_id") % 4 == 1, declared, F.col("got")).alias("problem"))


@query("s03_spatial_answers", f"""WITH {_ANSWER} SELECT concat('36368:', id) AS key, round(degrees(x0 / 6378137.0), 7) AS lon, round(degrees(2 * atan(exp(y0 / 6378137.0)) - pi() / 2), 7) AS lat FROM ans WHERE reason IS NULL""")
def spatial_answers(t):
    """Accepted features in longitude and latitude, one per key; every feature arrives twice."""
    a = answer_rows(t)
    rows = features.normalize(a.unionByName(a)).where("reason IS NULL").dropDuplicates(["key"])
    first = F.get(F.get(F.get(F.col("world"), F.lit(0)), F.lit(0)), F.lit(0))
    return rows.select("key", F.round(first["x"], 7).alias("lon"), F.round(first["y"], 7).alias("lat"))


@query("s04_strict_answers", f"""WITH {_ANSWER} SELECT response, count(*) AS received, count(reason) AS bad, count(reason) = 0 AS accepted FROM ans GROUP BY response""")
def strict_answers(t):
    return features.accept_strict(features.normalize(answer_rows(t)))


@query("s05_quarantine_receipts", f"""WITH {_ANSWER}, s AS (SELECT response, count(*) AS received, count(*) FILTER (WHERE reason = 'crs') AS st, count(*) FILTER (WHERE reason = 'self-intersection') AS inv FROM ans GROUP BY response)
SELECT response, received, CASE WHEN st > 0 THEN 0 ELSE received - inv END AS accepted, CASE WHEN st > 0 THEN 0 ELSE inv END AS invalid, CASE WHEN st > 0 THEN 'rejected' WHEN inv > 0 THEN 'partial' ELSE 'done' END AS state FROM s""")
def quarantine_receipts(t):
    return features.split_quarantine(features.normalize(answer_rows(t)))[2]


@query("s05_quarantine_rejects", f"""WITH {_ANSWER} SELECT response, concat('36368:', id) AS key, reason, x0, y0, x1, y1 FROM ans a
WHERE reason = 'self-intersection' AND NOT EXISTS (SELECT 1 FROM ans b WHERE b.response = a.response AND b.reason = 'crs')""")
def quarantine_rejects(t):
    return features.split_quarantine(features.normalize(answer_rows(t)))[1].select("response", "key", "reason", "bbox.*")


@query("s06_zoning_answers", """
SELECT survey_id, count(*) AS received, count(*) FILTER (WHERE s_nationkey = 3) AS foreign_ids, count(*) FILTER (WHERE s_nationkey = 3) = 0 AS accepted FROM zones GROUP BY survey_id""")
def zoning_answers(t, budget: int = 200_000):
    """Ids must carry the layer prefix and something after it; counters agree; coordinates stay in budget."""
    prefix = "territorialzone_polygon."
    z = t("zones").withColumn("fid", F.concat(F.when(F.col("s_nationkey") == 3, "other.").otherwise(prefix), F.col("k").cast("string"))).withColumn("geom", box_of(t("zones")))
    bad = ~(F.col("fid").startswith(prefix) & (F.length("fid") > len(prefix)) & G.ring_structure_ok(F.col("geom")) & G.finite_in_range(F.col("geom"), -20040000.0, -20040000.0, 20040000.0, 20040000.0))
    g = z.groupBy("survey_id").agg(F.count("*").alias("received"), F.count_if(bad).alias("foreign_ids"), F.count_distinct("fid").alias("ids"),
                                   F.sum(G.coordinate_count(F.col("geom"), True)).alias("coordinates"))
    return g.select("survey_id", "received", "foreign_ids", ((F.col("foreign_ids") == 0) & (F.col("ids") == F.col("received")) & (F.col("coordinates") <= budget)).alias("accepted"))


@query("s07_lot_rows", """
SELECT lot_id, status, type_code, CASE WHEN lot_id % 10 = 0 THEN 'region' WHEN lot_id % 10 = 1 THEN 'lot id' END AS rejected, CASE WHEN lot_id % 10 > 1 THEN concat('90:12:7:', CAST(lot_id AS VARCHAR)) END AS numbers FROM lots""")
def lot_rows(t):
    """Lot rows from the text a lot search answers, with gates on id and region."""
    k = F.col("lot_id").cast("string")
    body = F.to_json(F.struct(
        F.when(F.col("lot_id") % 10 == 1, "x").otherwise(F.concat(F.lit("21000012340000"), k, F.lit("_1"))).alias("id"),
        F.when(F.col("lot_id") % 10 == 0, "77").otherwise("91").alias("subjectRFCode"), F.col("status").alias("lotStatus"), F.struct(F.col("type_code").alias("code")).alias("biddType"),
        F.array(F.struct(F.lit("CadastralNumber").alias("code"), F.concat(F.lit("участок 90:12:007:"), k).alias("characteristicValue")),
                F.struct(F.lit("SquareZU").alias("code"), F.lit("600").alias("characteristicValue"))).alias("characteristics")))
    schema = ("id string, subjectRFCode string, lotStatus string, biddType struct<code:string>, characteristics array<struct<code:string,characteristicValue:string>>")
    r = t("lots").select("lot_id", F.from_json(body, schema).alias("r"))
    why = F.when(~F.col("r.id").rlike(r"^\d{10,30}_\d{1,6}$"), "lot id").when(F.col("r.subjectRFCode") != "91", "region")
    named = F.filter("r.characteristics", lambda c: c["code"] == "CadastralNumber")
    nums = F.array_distinct(F.flatten(F.transform(named, lambda c: X.numbers(c["characteristicValue"]))))
    return r.select("lot_id", F.col("r.lotStatus").alias("status"), F.col("r.biddType.code").alias("type_code"), why.alias("rejected"),
                    F.when(why.isNull(), F.array_join(F.array_sort(nums), ",")).alias("numbers"))


@query("s08_paged_assembly", """
WITH p AS (SELECT o_custkey AS search_id, o_orderkey AS lot_id, o_orderkey % 3 AS page, CASE WHEN o_custkey % 7 = 0 AND o_orderkey % 3 = 1 THEN -1 ELSE count(*) OVER (PARTITION BY o_custkey) END AS total, o_orderstatus FROM orders)
SELECT search_id, count(*) AS received, CASE WHEN count(DISTINCT total) > 1 THEN 'total changed' WHEN count(DISTINCT lot_id) <> count(*) THEN 'repeated lot' WHEN count(*) <> max(total) THEN 'count differs'
  WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 8 THEN 'status' END AS problem FROM p GROUP BY search_id""")
def paged_assembly(t, tolerated: int = 8):
    """Pages of one search: same total everywhere, no repeated lot, as many lots as stated, open statuses."""
    o = t("orders")
    totals = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    p = o.join(totals, "o_custkey").withColumn("total", F.when((F.col("o_custkey") % 7 == 0) & (F.col("o_orderkey") % 3 == 1), F.lit(-1)).otherwise(F.col("n")))
    g = p.groupBy(F.col("o_custkey").alias("search_id")).agg(
        F.count("*").alias("received"), F.min("total").alias("lo"), F.max("total").alias("hi"), F.count_distinct("o_orderkey").alias("ids"),
        F.count_if(F.col("o_orderstatus") == "P").alias("closed"))
    why = (F.when(F.col("lo") != F.col("hi"), "total changed").when(F.col("ids") != F.col("received"), "repeated lot")
           .when(F.col("received") != F.col("hi"), "count differs").when(F.col("closed") > tolerated, "status"))
    return g.select("search_id", "received", why.alias("problem"))


def descriptors(t):
    """Attachments with their content key: digest of the identity fields."""
    return t("attachments").withColumn("key", X.digest(F.col("declared_size"), F.col("file_id"), F.col("file_name"), length=24)) \
        .withColumn("format", X.extension(F.col("file_name")))


@query("s09_card_scan", """
SELECT lot_id, scope, count(*) AS attachments, count(*) - count(DISTINCT (file_id, file_name, declared_size)) AS repeats FROM attachments GROUP BY lot_id, scope""")
def card_scan(t):
    """Attachments per card group; a repeat inside a group rejects the card."""
    per_key = descriptors(t).groupBy("lot_id", "scope", "key").agg(F.count("*").alias("n"))
    return per_key.groupBy("lot_id", "scope").agg(F.sum("n").alias("attachments"), (F.sum("n") - F.count("*")).alias("repeats"))


@query("s10_descriptor_keys", """
SELECT DISTINCT file_id, file_name, declared_size, substring(sha256(concat('{"declared_size":', CAST(declared_size AS VARCHAR), ',"file_id":', CAST(file_id AS VARCHAR), ',"file_name":"', file_name, '"}')), 1, 24) AS key,
  lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) AS format FROM attachments""")
def descriptor_keys(t):
    return descriptors(t).select("file_id", "file_name", "declared_size", "key", "format").distinct()


def listing_pages(t):
    """Listing pages: the given page with list items put inside its article."""
    k = F.col("page_id").cast("string")
    items = F.concat(F.lit("<ul><li><a href='/doc/"), k, F.lit(".pdf'>Документ  "), k, F.lit("</a> Дата публикации: 05.03.2024</li><li><a href=\"/s/"), k,
                     F.lit("\">Сессия "), k, F.lit("</a> Дата публикации: 05.03.2024 Дата опубликования 06.03.2024</li>"),
                     F.lit("<li><a href='https://elsewhere.example.net/x.pdf'>Чужой документ</a></li><li><a href='/doc/x.pdf?sid=1'>С запросом</a></li></ul></article>"))
    return t("pages").select("page_id", F.lit("https://docs.example.org/list/").alias("url"), F.replace(F.col("html"), F.lit("</article>"), items).alias("html"))


#: host of the listing
LISTING_HOSTS = ("docs.example.org",)
_NART = "CAST((length(html) - length(replace(html, '</article>', ''))) / 10 AS BIGINT)"


@query("s11_article_links", f"""
SELECT page_id, concat('https://docs.example.org/doc/', CAST(page_id AS VARCHAR), '.pdf') AS url, concat('Документ ', CAST(page_id AS VARCHAR)) AS title FROM pages WHERE {_NART} > 0
UNION ALL SELECT page_id, concat('https://docs.example.org/s/', CAST(page_id AS VARCHAR)), concat('Сессия ', CAST(page_id AS VARCHAR)) FROM pages WHERE {_NART} > 0""")
def article_links(t):
    return listings.extract_links(listing_pages(t), LISTING_HOSTS).select("page_id", "url", "title").distinct()


@query("s12_dated_links", f"""
SELECT page_id, concat('Документ ', CAST(page_id AS VARCHAR)) AS title, '05.03.2024' AS publication_date FROM pages WHERE {_NART} > 0
UNION ALL SELECT page_id, concat('Сессия ', CAST(page_id AS VARCHAR)), NULL FROM pages WHERE {_NART} > 0""")
def dated_links(t):
    """Date of the list item; two different dates in one item leave it open."""
    return listings.extract_links(listing_pages(t), LISTING_HOSTS).select("page_id", "title", "publication_date")


@query("s13_session_links", f"SELECT page_id, concat('https://docs.example.org/s/', CAST(page_id AS VARCHAR)) AS url, concat('Сессия ', CAST(page_id AS VARCHAR)) AS title FROM pages WHERE {_NART} > 0")
def session_links(t):
    return listings.sessions(listings.extract_links(listing_pages(t), LISTING_HOSTS))


@query("s14_bundle_import", """
WITH b AS (SELECT c_custkey, concat('90:12:', CAST(CAST(floor(c_custkey / 200.0) AS BIGINT) AS VARCHAR), ':', CAST(c_custkey AS VARCHAR)) AS number, c_mktsegment, c_nationkey FROM customer)
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'digest' WHEN c_nationkey = 5 THEN 'session key' WHEN c_nationkey > 5 AND number NOT IN (SELECT concat('90:12:', CAST(CAST(floor(k / 200.0) AS BIGINT) AS VARCHAR), ':', CAST(k AS VARCHAR)) FROM lot_numbers) THEN 'not asked for'
  WHEN number IN (SELECT concat('90:12:', CAST(survey_id AS VARCHAR), ':', CAST(k AS VARCHAR)) FROM offers) THEN 'already known' END AS refused FROM b""")
def bundle_import(t):
    """Saved answers: digest must fit, no session keys, number asked for, geometry not known yet."""
    number = F.concat_ws(":", F.lit("90"), F.lit("12"), F.floor(F.col("c_custkey") / 200).cast("string"), F.col("c_custkey").cast("string"))
    body = F.concat(F.lit('{"n":"'), number, F.when(F.col("c_nationkey") == 5, '","session":1}').otherwise('"}'))
    stated = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("0" * 64)).otherwise(F.sha2(body, 256))
    b = t("customer").select("c_custkey", "c_nationkey", number.alias("number"), body.alias("body"), stated.alias("sha256"))
    asked = t("lot_numbers").select(X.canonical(F.col("cad_num")).alias("number")).distinct().withColumn("asked", F.lit(True))
    known = t("offers").select(X.canonical(F.col("cad_num")).alias("number")).distinct().withColumn("known", F.lit(True))
    keys = F.regexp_extract_all("body", F.lit(r'"(\w+)"\s*:'), F.lit(1))
    why = (F.when(F.sha2("body", 256) != F.col("sha256"), "digest").when(F.exists(keys, lambda k: F.lower(k).rlike("token|auth|cookie|session")), "session key")
           .when((F.col("c_nationkey") > 5) & F.col("asked").isNull(), "not asked for").when(F.col("known").isNotNull(), "already known"))
    return b.join(asked, "number", "left").join(known, "number", "left").select("c_custkey", why.alias("refused"))


@query("s15_layer_catalogue", "SELECT c.id, c.mode, CAST(36000 + CASE c.mode WHEN 'settlements' THEN 0 WHEN 'quarters' THEN 1 WHEN 'schemes' THEN 2 WHEN 'planned_parcels' THEN 3 WHEN 'red_lines' THEN 4 WHEN 'water' THEN 5 WHEN 'forests' THEN 6 WHEN 'protected' THEN 7 ELSE 8 END AS BIGINT) AS category_id FROM context c")
def layer_catalogue(t):
    """Category of each layer by trimmed title, from a catalogue of fixed size."""
    from groundsift.lift import CONTEXT_MODES

    rows = [(f" {m} ", 36000 + i) for i, m in enumerate(CONTEXT_MODES)]
    cat = t.spark.createDataFrame(rows, "title string, category_id bigint").select(F.trim("title").alias("mode"), "category_id")
    return t("context").join(F.broadcast(cat), "mode").select("id", "mode", "category_id")


def har_entries(t):
    k = F.col("event_id")
    url = F.concat(F.lit("https://"), F.when(k % 5 == 0, "other.example.com").otherwise("maps.example.org"),
                   F.when(k % 3 == 0, "/api/v1/layers/").otherwise("/static/"), F.when(k % 2 == 0, F.substring(F.sha2(k.cast("string"), 256), 1, 32)).otherwise(F.col("event_type")),
                   F.lit("?id="), k.cast("string"), F.lit("&v=1"))
    return t("events").select(k.alias("ord"), F.when(k % 4 == 0, "POST").otherwise("GET").alias("method"), url.alias("url"),
                              F.array(F.lit("Accept"), F.when(F.col("event_type") == "error", "Cookie").otherwise("Host")).alias("headers"), "ts")


@query("s16_endpoint_inventory", """
WITH e AS (SELECT event_id AS ord, CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, concat('https://maps.example.org/api/v1/layers/', CASE WHEN event_id % 2 = 0 THEN '{id}' ELSE event_type END) AS url, event_type FROM events WHERE event_id % 5 > 0 AND event_id % 3 = 0)
SELECT substring(sha256(concat(method, ' ', url)), 1, 12) AS id, method, url, 'id,v' AS parameters, arg_max(event_type, ord) = 'error' AS auth_seen, count(*) AS seen FROM e GROUP BY method, url""")
def endpoint_inventory(t):
    return traffic.endpoints(har_entries(t), ["maps.example.org"])


@query("s17_registry_merge", """
WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, concat('https://maps.example.org/api/v1/layers/', CASE WHEN event_id % 2 = 0 THEN '{id}' ELSE event_type END) AS url, ts FROM events WHERE event_id % 5 > 0 AND event_id % 3 = 0),
o AS (SELECT method, url, count(*) AS seen FROM e WHERE ts < TIMESTAMP '2024-01-02' OR event_type = 'click' GROUP BY method, url), n AS (SELECT method, url, count(*) AS seen FROM e WHERE event_type <> 'click' GROUP BY method, url)
SELECT substring(sha256(concat(coalesce(n.method, o.method), ' ', coalesce(n.url, o.url))), 1, 12) AS id, CASE WHEN o.url IS NULL THEN 'added' WHEN n.url IS NULL THEN 'kept' WHEN o.seen = n.seen THEN 'same' ELSE 'changed' END AS change, coalesce(n.seen, o.seen) AS seen
FROM o FULL JOIN n ON o.method = n.method AND o.url = n.url""")
def registry_merge(t):
    e = har_entries(t).join(t("events").select(F.col("event_id").alias("ord"), "event_type"), "ord")
    old = traffic.endpoints(e.where((F.col("ts") < "2024-01-02") | (F.col("event_type") == "click")), ["maps.example.org"])
    new = traffic.endpoints(e.where("event_type <> 'click'"), ["maps.example.org"])
    return traffic.merge_registry(old, new, ["seen"])


@query("s18_source_registry", "SELECT source, count(*) AS documents, min(title) AS first_title FROM catalog GROUP BY source")
def source_registry(t):
    return t("catalog").groupBy("source").agg(F.count("*").alias("documents"), F.min("title").alias("first_title"))


@query("s19_synthetic_layers", """
SELECT s.survey_id, r.role, CAST(i AS BIGINT) AS ord, s.wx0 + 40 * i AS x0, s.wy0 + 15.0 * r.n AS y0, s.wx0 + 40 * i + 30 AS x1, s.wy0 + 15.0 * r.n + 10 AS y1
FROM surveys s, (VALUES ('parcels', 0), ('buildings', 1), ('roads', 2)) r(role, n), range(6) g(i)""")
def synthetic_layers(t):
    """Deterministic practice layers for every window."""
    base = t("surveys").select("survey_id", "wx0", "wy0", F.posexplode(F.array(F.lit("parcels"), F.lit("buildings"), F.lit("roads"))).alias("n", "role"))
    g = base.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))))
    x, y = F.col("wx0") + 40 * F.col("ord"), F.col("wy0") + 15.0 * F.col("n")
    return g.select("survey_id", "role", "ord", x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 10).alias("y1"))


_FORK = """(SELECT survey_id, id, cad_num, x0, y0, x1, (y0 + y1) / 2 AS y1, 1 AS s FROM parcels UNION ALL SELECT survey_id, id, cad_num, x0, (y0 + y1) / 2, x0 + (x1 - x0) / 4, y1, 1 FROM parcels
 UNION ALL SELECT survey_id, id, cad_num, x1 - (x1 - x0) / 4, (y0 + y1) / 2, x1, y1, 1 FROM parcels UNION ALL SELECT survey_id, id, cad_num, x0 + 10, y0 + 10, x0 + 20, y0 + 20, -1 FROM parcels)"""


@query("s20_clipped_layers", f"""
SELECT p.survey_id, p.id, p.cad_num AS label, round(sum(p.s * (least(x1, wx1 - 400) - greatest(x0, wx0 + 400)) * (least(y1, wy1 - 400) - greatest(y0, wy0 + 400))), 2) AS area_m2
FROM {_FORK} p JOIN surveys s ON p.survey_id = s.survey_id WHERE least(x1, wx1 - 400) > greatest(x0, wx0 + 400) AND least(y1, wy1 - 400) > greatest(y0, wy0 + 400) GROUP BY p.survey_id, p.id, p.cad_num""")
def clipped_layers(t, inset: float = 400.0):
    """Layer export with polygons cut to the window, holes and arms kept; objects outside it are left out."""
    from groundsift.operators.clipping import clipped_figures
    from groundsift.operators.freespace import flat_geometry
    from groundsift.plans.shapes import forked
    w = t("surveys").select("survey_id", (F.col("wx0") + inset).alias("bx0"), (F.col("wy0") + inset).alias("by0"), (F.col("wx1") - inset).alias("bx1"), (F.col("wy1") - inset).alias("by1"))
    p = spread(t("parcels").select("survey_id", "id", "cad_num", *BOX), "id").select("survey_id", "id", "cad_num", *BOX, *flat_geometry(forked())).join(w, "survey_id").where("x1 > bx0 AND x0 < bx1 AND y1 > by0 AND y0 < by1")
    return clipped_figures(p).join(t("parcels").select("survey_id", "id", F.col("cad_num").alias("label")), ["survey_id", "id"]).select("survey_id", "id", "label", F.round("area_m2", 2).alias("area_m2"))


@query("s21_candidate_features", """
SELECT id, concat('{"type":"Feature","id":"', id, '","geometry":{"type":"Polygon","coordinates":[[[', CAST(CAST(x0 AS BIGINT) AS VARCHAR), '.0,', CAST(CAST(y0 AS BIGINT) AS VARCHAR), '.0],[') AS head FROM offers""")
def candidate_features(t):
    lines = sinks.feature_lines(candidates(t), "id", box_of(None), ["id", "kind", "survey_id"])
    return lines.select(F.get_json_object("value", "$.id").alias("id"), F.regexp_extract("value", r"^(.*?\.0,\d+\.0\],\[)", 1).alias("head"))


@query("s22_registry_csv", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 5 WHEN 0 THEN chr(39) || '=1+1' WHEN 1 THEN chr(39) || ' @x' WHEN 2 THEN chr(39) || '-5' WHEN 3 THEN 'a;"b";c' ELSE o_orderpriority END AS note,
  CASE WHEN o_orderkey % 3 = 0 THEN chr(39) || '+' || o_orderpriority ELSE o_orderpriority END AS state FROM orders""")
def registry_csv(t):
    """The registry as a ``;`` separated file that no spreadsheet runs, written and read again."""
    k = F.col("o_orderkey")
    note = F.when(k % 5 == 0, "=1+1").when(k % 5 == 1, " @x").when(k % 5 == 2, "-5").when(k % 5 == 3, 'a;"b";c').otherwise(F.col("o_orderpriority"))
    state = F.when(k % 3 == 0, F.concat(F.lit("+"), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    path = scratch_folder(t.spark, "registry")
    sinks.write_csv(t("orders").select(k.cast("string").alias("id"), note.alias("note"), state.alias("state")), path)
    return sinks.read_csv(t.spark, path)


@query("s23_vertex_rows", """
SELECT id, 1 AS part, 1 AS ring, CAST(v AS INTEGER) AS vertex, CASE WHEN v IN (2, 3) THEN x1 ELSE x0 END AS x, CASE WHEN v IN (3, 4) THEN y1 ELSE y0 END AS y FROM offers, range(1, 6) r(v)""")
def vertex_rows(t):
    return sinks.vertex_rows(candidates(t), ["id"], box_of(None))


@query("s24_enquiry_geometry", "SELECT id, (x1 - x0) * (y1 - y0) AS area_m2, false AS is_srzu FROM offers")
def enquiry_geometry(t):
    """Attachment of one candidate and version, for all candidates: contour, area and what it is not."""
    c = candidates(t)
    return c.select("id", G.area(box_of(c)).alias("area_m2"), F.lit(False).alias("is_srzu"))


@query("s25_observation_receipts", """
SELECT s.survey_id, m.mode, CASE WHEN count(c.id) > 0 THEN 'received' ELSE 'not_available' END AS state, count(c.id) AS features
FROM surveys s CROSS JOIN (SELECT unnest(['settlements', 'quarters', 'schemes', 'planned_parcels', 'red_lines', 'water', 'forests', 'protected', 'heritage']) AS mode) m
LEFT JOIN context c ON c.survey_id = s.survey_id AND c.mode = m.mode AND c.c_acctbal < 2000 GROUP BY s.survey_id, m.mode""")
def observation_receipts(t):
    """Receipts without geometry; an expected layer nobody answered shows as not available."""
    from groundsift.lift import CONTEXT_MODES

    expected = t("surveys").select("survey_id", F.explode(F.array(*[F.lit(m) for m in CONTEXT_MODES])).alias("mode"))
    got = t("context").where("c_acctbal < 2000").groupBy("survey_id", "mode").agg(F.count("*").alias("n"))
    return expected.join(got, ["survey_id", "mode"], "left").select("survey_id", "mode", F.when(F.col("n") > 0, "received").otherwise("not_available").alias("state"), F.coalesce("n", F.lit(0)).alias("features"))


@query("s26_version_addresses", """
SELECT survey_id, count(*) AS rows, survey_id % 2 = 1 AS refused, CAST(CASE WHEN survey_id % 2 = 0 THEN sum(k) END AS BIGINT) AS loaded_keys FROM parcels GROUP BY survey_id""")
def version_addresses(t):
    """A version of every window's parcels, written and loaded again; those of odd windows, altered in one row behind their address, are refused."""
    path = scratch_folder(t.spark, "versions")
    parcels = t("parcels").select("survey_id", "k", "id", "cad_num", *BOX)
    sinks.write_versions(parcels, f"{path}/saved", ["survey_id"])
    saved = t.spark.read.parquet(f"{path}/saved")
    last = saved.groupBy("survey_id").agg(F.max("k").alias("last"))
    touched = saved.join(last, "survey_id").withColumn("cad_num", F.when((F.col("survey_id") % 2 == 1) & (F.col("k") == F.col("last")), "90:00").otherwise(F.col("cad_num"))).drop("last")
    touched.write.partitionBy("version").parquet(f"{path}/kept")
    rows, states = sinks.load_versions(t.spark, f"{path}/kept", ["survey_id"])
    counts = saved.groupBy("survey_id").agg(F.count("*").alias("rows"))
    loaded = rows.groupBy("survey_id").agg(F.sum("k").alias("loaded_keys"))
    return states.select("survey_id", "refused").join(counts, "survey_id").join(loaded, "survey_id", "left").select("survey_id", "rows", "refused", "loaded_keys")


@query("s27_w19_latest_events", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def latest_events(t):
    return t("events").orderBy(F.desc("event_id")).limit(100).select("event_id", "event_type")


@query("s28_latest_settings", "SELECT user_id AS key, arg_max(value, (ts, event_id)) AS body FROM events GROUP BY user_id")
def latest_settings(t):
    return t("events").groupBy(F.col("user_id").alias("key")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("body"))


@query("s29_layer_upsert", """
WITH v AS (SELECT user_id % 20 AS project, event_type AS role, max(ts) AS at FROM events GROUP BY 1, 2), c AS (SELECT event_id, user_id % 20 AS project, ts FROM events WHERE event_type = 'view')
SELECT c.event_id, max(v.at) > c.ts AS stale FROM c JOIN v ON c.project = v.project GROUP BY c.event_id, c.ts""")
def layer_upsert(t):
    """Latest layer per project and role; candidates computed before any of them are stale."""
    e = t("events").withColumn("project", F.col("user_id") % 20)
    latest = e.groupBy("project", "event_type").agg(F.max("ts").alias("at")).groupBy("project").agg(F.max("at").alias("at"))
    return e.where("event_type = 'view'").join(latest, "project").select("event_id", (F.col("at") > F.col("ts")).alias("stale"))


# First bytes of the file formats.
MAGIC = {"pdf": "255044462D", "docx": "504B0304", "doc": "D0CF11E0A1B11AE1", "rtf": "7B5C72746631", "jpg": "FFD8FF", "jpeg": "FFD8FF", "png": "89504E47"}


@query("s30_download_gate", """
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'size' WHEN doc_id % 3 = 2 THEN 'content' END AS refused FROM documents""")
def download_gate(t):
    """Declared size and first bytes must fit the format."""
    head = F.when(F.col("doc_id") % 3 == 2, "PK..").otherwise("%PDF-1.7 ")
    content = F.encode(F.concat(head, F.col("text")), "UTF-8")
    declared = F.length(content) + F.when(F.col("doc_id") % 3 == 1, 1).otherwise(0)
    start = F.hex(F.substring(content, 1, len(MAGIC["pdf"]) // 2))
    return t("documents").select("doc_id", F.when(F.length(content) != declared, "size").when(start != MAGIC["pdf"], "content").alias("refused"))


@query("s31_number_search", """
WITH q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE concat('90:12:', CAST(survey_id AS VARCHAR), ':', CAST(doc_id AS VARCHAR)) END AS asked FROM catalog)
SELECT q.doc_id, asked LIKE '90:%' AS well_formed, count(p.k) AS found FROM q LEFT JOIN parcels p ON asked = concat('90:12:', CAST(p.survey_id AS VARCHAR), ':', CAST(p.k AS VARCHAR)) GROUP BY q.doc_id, asked""")
def number_search(t):
    asked = F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.concat(F.lit("90:12:"), F.col("survey_id").cast("string"), F.lit(":"), F.col("doc_id").cast("string")))
    q = t("catalog").select("doc_id", asked.alias("asked"))
    geo = t("parcels").select(X.canonical(F.col("cad_num")).alias("asked"), "k")
    return q.join(geo, "asked", "left").groupBy("doc_id", "asked").agg(F.count("k").alias("found")).select("doc_id", F.col("asked").rlike(X.NUMBER_FULL_RE).alias("well_formed"), "found")


def xml_records(t):
    """Land records as XML text, one contour each; some open, some with a broken number or order."""
    k = F.col("k")
    def o(x, y, n):
        return F.concat(F.lit("<ordinate><x>"), F.col(x).cast("string"), F.lit("</x><y>"), F.col(y).cast("string"), F.lit("</y><ord_nmb>"), F.lit(n), F.lit("</ord_nmb></ordinate>"))
    last = (F.when(F.col("p_size") == 1, F.lit("")).when(F.col("p_size") == 2, F.lit("<ordinate><x>1,5</x><y>2</y><ord_nmb>5</ord_nmb></ordinate>"))
            .when(F.col("p_size") == 3, o("x0", "y0", "7")).otherwise(o("x0", "y0", "1")))
    ords = F.concat(o("x0", "y0", "1"), o("x1", "y0", "2"), o("x1", "y1", "3"), o("x0", "y1", "4"), last)
    # dealt out before texts are made and parsed: a small file of parcels would be one task
    return spread(t("parcels").select("k", "cad_num", "p_size", *BOX), "k").select("k", F.concat(F.lit("<land_record><object><common_data><cad_number>"), "cad_num", F.lit(
        "</cad_number></common_data></object><contours_location><contours><contour><entity_spatial><sk_id>91.1</sk_id><spatials_elements><spatial_element><ordinates>"), ords, F.lit(
        "</ordinates></spatial_element></spatials_elements></entity_spatial></contour></contours></contours_location></land_record>")).alias("value"))


@query("s32_r05_xml_contours", """
SELECT k, CAST(CASE WHEN p_size = 1 THEN 4 ELSE 5 END AS BIGINT) AS point_count, CASE p_size WHEN 1 THEN 'unclosed_contour' WHEN 2 THEN 'invalid_coordinate' WHEN 3 THEN 'invalid_point_order' END AS code,
  CASE WHEN p_size > 3 THEN (x1 - x0) * (y1 - y0) END AS area FROM parcels""")
def xml_contours(t):
    rec = xml_records(t).select("k", F.from_xml("value", contours.RECORD).alias("r")).select("k", "r.*")
    pts = contours.record_points(rec)
    checked = contours.check_contours(pts)
    number = F.regexp_extract("cad_number", r"(\d+)$", 1).cast("bigint").alias("k")
    return checked.select(number, "point_count", "code", "area")
