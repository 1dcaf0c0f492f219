"""P-series: field whitelists, gates and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsift.functions import geometry as G
from groundsift.functions import text as X
from groundsift.operators.ranking import grouped_rank
from groundsift.plans.joins import BOX, candidates
from groundsift.registry import query

NOW = "2000-06-15 00:00:00"

# Fields a public record may show.
PUBLIC_FIELDS = ("cad_num", "ownership_type", "right_type", "permitted_use_established_by_document", "category", "name_by_doc",
                 "content_restrict_encumbrances", "legal_act_document_name", "legal_act_document_number", "legal_act_document_date")
COUNTERS = ("cnt_land", "cnt_land_geom", "cnt_land_not_geom", "cnt_oks", "cnt_oks_geom", "cnt_oks_not_geom")
CONTEXT_FIELDS = ("cad_num", "reg_numb_border", "name", "name_by_doc", "type_boundary_value", "legal_act_document_name",
                  "legal_act_document_number", "legal_act_document_date", *COUNTERS, "is_actual", "is_conditional", "status", "date_cr")
PLAN_FIELDS = ("OBJECTID", "CLASS_ID", "STAT_OBJ_U", "TYPE_ZONE_", "TYPE_ZONE", "SUBTYPE_ZO", "SUBSUBTYPE", "NAME", "NAME_MO",
               "LOCATIONS", "VALUE_ROAD", "STATUS_ROA", "CATEGORY_R", "LOCATION_R", "TYPE_ROAD_", "TYPE_PAVEM")
SUBJECTS = {"СНТ «Луч»": r"снт\s*[«\"„]?\s*луч(?![\p{L}])", "Проект": r"проект"}


def whitelist(options, names, limit: int = 2000):
    """Named entries only, NULLs dropped, long text cut."""
    kept = F.map_filter(options, lambda k, v: k.isin(*names) & v.isNotNull())
    return F.transform_values(kept, lambda k, v: F.substring(v, 1, limit))


def _shown(m):
    """Map as sorted text, so that two engines print it alike."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit("="), F.element_at(m, k))), ";")


@query("p01_public_fields", """
SELECT doc_id, concat('cad_num=', CAST(doc_id AS VARCHAR), ';category=', lang, ';name_by_doc=', substring(text, 1, 2000), CASE WHEN lang <> 'de' THEN concat(';right_type=', source) ELSE '' END) AS fields FROM documents""")
def public_fields(t):
    m = F.create_map(F.lit("name_by_doc"), F.col("text"), F.lit("session"), F.col("source"), F.lit("category"), F.col("lang"),
                     F.lit("cad_num"), F.col("doc_id").cast("string"), F.lit("right_type"), F.when(F.col("lang") != "de", F.col("source")))
    return t("documents").select("doc_id", _shown(whitelist(m, PUBLIC_FIELDS)).alias("fields"))


@query("p02_context_fields", "SELECT c_custkey, concat('cnt_land=', CAST(c_nationkey AS VARCHAR), ';name=', c_name, ';status=', c_mktsegment) AS fields FROM customer")
def context_fields(t):
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("cnt_land"), F.col("c_nationkey").cast("string"), F.lit("balance"),
                     F.col("c_acctbal").cast("string"), F.lit("status"), F.col("c_mktsegment"))
    return t("customer").select("c_custkey", _shown(F.map_filter(m, lambda k, v: k.isin(*CONTEXT_FIELDS))).alias("fields"))


@query("p03_plan_properties", """
SELECT doc_id, length(text) <= 2000 AS valid, CASE WHEN length(text) <= 2000 THEN concat('NAME=', lang, ';OBJECTID=', CAST(doc_id AS VARCHAR)) END AS fields FROM documents""")
def plan_properties(t):
    """Every property is checked, the discarded ones too, before the whitelist applies."""
    m = F.create_map(F.lit("NAME"), F.col("lang"), F.lit("OBJECTID"), F.col("doc_id").cast("string"), F.lit("note"), F.col("text"))
    valid = F.forall(F.map_entries(m), lambda e: (F.length(e["key"]) <= 2000) & (e["value"].isNull() | (F.length(e["value"]) <= 2000)))
    return t("documents").select("doc_id", valid.alias("valid"), F.when(valid, _shown(F.map_filter(m, lambda k, v: k.isin(*PLAN_FIELDS)))).alias("fields"))


def parameter_error(min_area, max_area, min_width, target_area, limit):
    """First rule a parameter row breaks, NULL when it may run."""
    finite = F.lit(True)
    for c in (min_area, max_area, min_width, target_area):
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    return (F.when(~finite | ~((min_area > 0) & (min_area <= max_area) & (max_area <= 1e8) & min_width.between(0, 1000)), "area or width")
            .when(~target_area.between(min_area, max_area), "target area").when(F.sqrt(target_area) < min_width, "target narrower than width")
            .when(~limit.between(1, 20), "limit"))


@query("p04_parameter_gate", """
WITH p AS (SELECT o_orderkey AS k, CAST(o_custkey % 700 AS DOUBLE) AS mn, CAST(o_custkey AS DOUBLE) AS mx, CAST(o_orderkey % 60 AS DOUBLE) AS w, CAST(o_orderkey % 1500 AS DOUBLE) AS tg, o_orderkey % 25 AS lim FROM orders)
SELECT k, CASE WHEN NOT (mn > 0 AND mn <= mx AND mx <= 1e8 AND w BETWEEN 0 AND 1000) THEN 'area or width' WHEN tg NOT BETWEEN mn AND mx THEN 'target area'
  WHEN sqrt(tg) < w THEN 'target narrower than width' WHEN lim NOT BETWEEN 1 AND 20 THEN 'limit' END AS error FROM p""")
def parameter_gate(t):
    o = t("orders")
    d = lambda e: e.cast("double")
    return o.select(F.col("o_orderkey").alias("k"), parameter_error(
        d(F.col("o_custkey") % 700), d(F.col("o_custkey")), d(F.col("o_orderkey") % 60), d(F.col("o_orderkey") % 1500), F.col("o_orderkey") % 25).alias("error"))


@query("p05_window_gate", """
WITH b AS (SELECT p_partkey, 33.5 + (p_partkey % 1000) / 1000.0 AS w, 44.5 + (p_partkey % 700) / 1000.0 AS s, 0.001 * (p_size - 1) AS d FROM part),
m AS (SELECT p_partkey, d > 0 AS ordered, 6378137.0 * 6378137.0 * radians(d) * (ln(tan(radians(s + d) / 2 + pi() / 4)) - ln(tan(radians(s) / 2 + pi() / 4))) AS area FROM b)
SELECT p_partkey, ordered AND area <= 10000000 AS accepted, CAST(floor(area / 100000 + 0.5) AS BIGINT) AS hectares10 FROM m""")
def window_gate(t):
    """Ordered finite bounds, at most 10 km² in the map projection."""
    d = F.lit(0.001) * (F.col("p_size") - 1)
    w, s = F.lit(33.5) + (F.col("p_partkey") % 1000) / 1000.0, F.lit(44.5) + (F.col("p_partkey") % 700) / 1000.0
    x0, y0 = G.mercator(w, s)
    x1, y1 = G.mercator(w + d, s + d)
    a = (x1 - x0) * (y1 - y0)
    ok = (w < w + d) & w.between(-180, 180) & (s > -85) & (s + d < 85)
    return t("part").select("p_partkey", (ok & (a <= 10_000_000)).alias("accepted"), F.floor(a / 100000 + 0.5).alias("hectares10"))


@query("p06_category_gate", """
SELECT survey_id, p_brand AS layer, count(*) AS received, count(*) FILTER (WHERE p_type NOT IN ('ECONOMY', 'PROMO', 'SMALL', 'LARGE')) AS wrong,
  count(*) FILTER (WHERE p_type NOT IN ('ECONOMY', 'PROMO', 'SMALL', 'LARGE')) = 0 AS accepted FROM parcels GROUP BY survey_id, p_brand""")
def category_gate(t):
    """One row of another category rejects the layer of its window."""
    wrong = ~F.col("p_type").isin("ECONOMY", "PROMO", "SMALL", "LARGE")
    return (t("parcels").groupBy("survey_id", F.col("p_brand").alias("layer"))
            .agg(F.count("*").alias("received"), F.count_if(wrong).alias("wrong"), (F.count_if(wrong) == 0).alias("accepted")))


@query("p07_intersects_window", """
SELECT c.survey_id, c.id FROM context c JOIN surveys s ON c.survey_id = s.survey_id
WHERE least(c.x1, s.wx1 - 500) > greatest(c.x0, s.wx0 + 500) AND least(c.y1, s.wy1 - 500) > greatest(c.y0, s.wy0 + 500)""")
def intersects_window(t, inset: float = 500.0):
    j = t("context").join(t("surveys"), "survey_id")
    return j.where((F.least("x1", F.col("wx1") - inset) > F.greatest("x0", F.col("wx0") + inset))
                   & (F.least("y1", F.col("wy1") - inset) > F.greatest("y0", F.col("wy0") + inset))).select("survey_id", "id")


def land_group(code):
    return F.when(code == "ZK", "land_provision").when(code == "229FZ", "debt_sale").otherwise("other")


_GROUP = "CASE type_code WHEN 'ZK' THEN 'land_provision' WHEN '229FZ' THEN 'debt_sale' ELSE 'other' END"
_STATE = f"CASE WHEN deadline NOT LIKE '%Z' THEN 'unknown' WHEN deadline_ts + INTERVAL 12 HOUR <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'future' END"


@query("p09_lot_groups", f"SELECT lot_id, {_GROUP} AS land_group FROM lots")
def lot_groups(t):
    return t("lots").select("lot_id", land_group(F.col("type_code")).alias("land_group"))


@query("p10_deadline_state", f"SELECT lot_id, {_STATE} AS deadline_state FROM lots")
def deadline_states(t):
    return t("lots").select("lot_id", X.deadline_state(F.col("deadline"), F.lit(NOW).cast("timestamp")).alias("deadline_state"))


def active_lot(age):
    """Status open, not stopped, deadline ahead, snapshot between 0 and 1 day old."""
    return (F.col("status").isin("PUBLISHED", "APPLICATIONS_SUBMISSION") & ~F.col("stopped")
            & (X.deadline_state(F.col("deadline"), F.lit(NOW).cast("timestamp")) == "future") & age.isNotNull() & age.between(0, 1))


@query("p11_active_lots", f"""
SELECT lot_id, {_GROUP} AS land_group FROM lots WHERE status IN ('PUBLISHED', 'APPLICATIONS_SUBMISSION') AND NOT stopped AND {_STATE} = 'future' AND (lot_id % 40) / 24.0 BETWEEN 0 AND 1""")
def active_lots(t):
    return t("lots").where(active_lot((F.col("lot_id") % 40) / 24.0)).select("lot_id", land_group(F.col("type_code")).alias("land_group"))


@query("p12_age_days", f"""
SELECT lot_id, CASE WHEN deadline LIKE '%Z' THEN round((epoch(TIMESTAMP '{NOW}') - epoch(deadline_ts) - 43200) / 86400.0, 2) END AS age_days FROM lots""")
def ages(t):
    return t("lots").select("lot_id", F.round(X.age_days(F.col("deadline"), F.lit(NOW).cast("timestamp")), 2).alias("age_days"))


HOSTS = ("blog.example.com", "docs.example.org")


@query("p15_trusted_links", """
SELECT page_id, url LIKE 'https://%' AND regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) IN ('ththrer.example.com', 'spam-farm.example.org') AND url NOT LIKE '%?%' AND url NOT LIKE '%#%' AS strict_link,
  url LIKE 'https://%' AND regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) IN ('ththrer.example.com', 'spam-farm.example.org') AS trusted_link FROM pages""")
def trusted_links(t):
    hosts = ("ththrer.example.com", "spam-farm.example.org")
    u = F.col("url")
    return t("pages").select("page_id", X.trusted_link(u, hosts).alias("strict_link"), X.trusted_link(u, hosts, strict=False).alias("trusted_link"))


@query("p16_sensitive_links", """
WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '?page=2' WHEN 1 THEN '?Session_id=9' WHEN 2 THEN '?a=1&apikey=z' ELSE '' END AS url FROM pages)
SELECT page_id, url LIKE 'https://%' AND page_id % 4 NOT IN (1, 2) AS public FROM u""")
def sensitive_links(t):
    tail = F.when(F.col("page_id") % 4 == 0, "?page=2").when(F.col("page_id") % 4 == 1, "?Session_id=9").when(F.col("page_id") % 4 == 2, "?a=1&apikey=z").otherwise("")
    return t("pages").select("page_id", X.public_link(F.concat(F.regexp_replace("url", r"[?#].*$", ""), tail)).alias("public"))


@query("p17_listing_keywords", """
SELECT doc_id FROM catalog WHERE regexp_matches(lower(title), 'земель|сервитут|планиров|межеван|пзз|аукцион|торги|извещение|обсужд')""")
def listing_keywords(t):
    low = F.lower("title")
    return t("catalog").where(F.exists(F.array(*[F.lit(w) for w in X.LISTING_WORDS]), lambda w: low.contains(w))).select("doc_id")


_KIND = """CASE doc_id % 6 WHEN 0 THEN 'regulation' WHEN 1 THEN 'notice_or_auction' WHEN 2 THEN 'restriction' WHEN 3 THEN 'planning' WHEN 4 THEN 'planning' ELSE 'land_document' END"""


@query("p18_document_kind", f"SELECT doc_id, {_KIND} AS kind FROM catalog")
def document_kinds(t):
    return t("catalog").select("doc_id", X.document_kind(F.col("title")).alias("kind"))


def catalog_item(t):
    """Catalogue row derived from a listing link."""
    ext = X.extension(X.url_part(F.col("url"), "PATH"))
    fmt = F.when(ext.isin("pdf", "doc", "docx", "zip"), ext).otherwise("html")
    return t("catalog").select(
        "*", F.substring(F.sha2("url", 256), 1, 20).alias("item_id"), X.document_kind(F.col("title")).alias("kind"), fmt.alias("format"),
        F.array_join(F.regexp_extract_all("title", F.lit(r"\b\d{2}\.\d{2}\.\d{4}\b"), F.lit(0)), ",").alias("date_mentions"),
        F.when(fmt.isin("pdf", "html"), "pending").otherwise("unsupported").alias("first_state"))


@query("p19_document_rows", f"""
SELECT doc_id, substring(sha256(url), 1, 20) AS item_id, {_KIND} AS kind, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc' WHEN 2 THEN 'zip' WHEN 3 THEN 'pdf' ELSE 'html' END AS format,
  array_to_string(regexp_extract_all(title, '\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}'), ',') AS date_mentions, CASE WHEN doc_id % 5 IN (1, 2) THEN 'unsupported' ELSE 'pending' END AS state FROM catalog""")
def document_rows(t):
    return catalog_item(t).select("doc_id", "item_id", "kind", "format", "date_mentions", F.col("first_state").alias("state"))


@query("p20_service_type", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'direct' END AS service FROM catalog")
def service_types(t):
    return t("catalog").select("doc_id", X.service_type(F.col("title")).alias("service"))


@query("p21_subject_tags", """SELECT doc_id, CASE WHEN doc_id % 6 = 3 THEN 'СНТ «Луч»,Проект' ELSE '' END AS subjects FROM catalog""")
def subjects(t):
    return t("catalog").select("doc_id", F.array_join(X.subject_tags(F.col("title"), SUBJECTS), ",").alias("subjects"))


def eligible_link(stem: str = "заречн"):
    path = F.lower(X.url_part(F.col("url"), "PATH"))
    low = F.lower("title")
    rules = low.contains("пзз") | low.rlike(r"правил[\p{L}\d_]*\s+землепользован")
    return path.endswith(".pdf") & (low.contains(stem) & rules | (F.size(X.subject_tags(F.col("title"), SUBJECTS)) > 0))


@query("p22_eligible_links", "SELECT doc_id FROM catalog WHERE url LIKE '%.pdf' AND doc_id % 6 IN (3, 4)")
def eligible_links(t):
    return t("catalog").where(eligible_link()).select("doc_id")


def zoning_documents(t):
    """Documents some listing reference marks as zoning."""
    refs = t("catalog").select("doc_id", F.array(F.struct(F.concat(F.lit("https://docs.example.org/"), "source").alias("root_url"),
                                                          F.when(F.col("title").contains("ПЗЗ"), "pzz").alias("planning_kind"))).alias("refs"))
    return refs.where(F.exists("refs", lambda r: (r["root_url"] == "https://docs.example.org/src5") | F.coalesce(r["planning_kind"] == "pzz", F.lit(False)))).select("doc_id")


@query("p23_zoning_documents", "SELECT doc_id FROM catalog WHERE source = 'src5' OR title LIKE '%ПЗЗ%'")
def zoning_docs(t):
    return zoning_documents(t)


@query("p24_selected_documents", """
SELECT doc_id, printf('%04d-%02d-%02d', 2015 + doc_id % 10, 1 + doc_id % 12, 1 + doc_id % 28) AS act_date,
  row_number() OVER (PARTITION BY survey_id ORDER BY printf('%04d-%02d-%02d', 2015 + doc_id % 10, 1 + doc_id % 12, 1 + doc_id % 28), doc_id) AS position
FROM catalog WHERE state = 'read' AND (source = 'src5' OR title LIKE '%ПЗЗ%')""")
def selected_documents(t):
    """Read zoning documents in order of act date and id."""
    d = t("catalog").where("state = 'read'").join(zoning_documents(t), "doc_id", "left_semi").select(
        "doc_id", "survey_id", F.coalesce(X.act_identity(F.col("title"))["date"], F.lit("")).alias("act_date"))
    return grouped_rank(d, ["survey_id"], [F.col("act_date"), F.col("doc_id")]).select("doc_id", "act_date", "position")


@query("p26_applicable_context", """
SELECT o_orderkey, coalesce(o_orderstatus <> 'P' AND o_custkey % 2 = 0, false) AS applicable FROM orders""")
def applicable_context(t):
    """A context serves only the identical window and a known version."""
    version = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
    have = F.array(F.lit(0.0), F.lit(0.0), (F.col("o_custkey") % 2).cast("double"), F.lit(1.0))
    want = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return t("orders").select("o_orderkey", F.coalesce(version.isin(1, 2) & have.eqNullSafe(want), F.lit(False)).alias("applicable"))


@query("p27_registry_search", "SELECT lot_id FROM lots WHERE status = 'PUBLISHED' AND (lower(status) LIKE '%229fz%' OR lower(type_code) LIKE '%229fz%' OR lower(deadline) LIKE '%229fz%')")
def registry_search(t, text: str = "229FZ"):
    return (t("lots").where((F.col("status") == "PUBLISHED") & F.lower(F.to_json(F.struct("status", "type_code", "deadline"))).contains(text.lower())).select("lot_id"))


@query("p30_overflow_rows", """
SELECT survey_id, least(count(*), 50) AS kept, greatest(0, count(*) - 50) AS omitted FROM offers GROUP BY survey_id""")
def overflow_rows(t, shown: int = 50):
    """The report shows the first rows of a window; the omitted ones are counted, and stay in the table."""
    n = F.count("*")
    return candidates(t).groupBy("survey_id").agg(F.least(n, F.lit(shown)).alias("kept"), F.greatest(F.lit(0), n - shown).alias("omitted"))


@query("p31_sparse_pages", "SELECT doc_id, page, length(regexp_replace(text, '\\s', '', 'g')) < 20 AS sparse FROM doc_pages")
def sparse_pages(t):
    return t("doc_pages").select("doc_id", "page", X.sparse(F.col("text")).alias("sparse"))


@query("p32_reference_choices", """
SELECT doc_id, concat('90:12:', CAST(survey_id AS VARCHAR), ':', CAST(doc_id * 2 AS VARCHAR)) AS cadastral_number FROM doc_pages WHERE page = 3 AND text LIKE 'СК-63%'""")
def reference_choices(t):
    """Pages, of all there are, with exactly one CRS label and one labelled control number."""
    p = t("doc_pages")
    g = p.select("doc_id", F.transform(X.crs_labels(F.col("text")), X.crs_name).alias("names"), X.numbers(F.col("text")).alias("nums"))
    return (g.where((F.size(F.array_distinct("names")) == 1) & (F.get("names", F.lit(0)) == "СК63") & (F.size("nums") == 1))
            .select("doc_id", F.get("nums", F.lit(0)).alias("cadastral_number")))


@query("p33_scan_pages", """
SELECT doc_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM doc_pages p WHERE length(regexp_replace(text, '\\s', '', 'g')) < 20 AND doc_id IN (SELECT doc_id FROM catalog WHERE state = 'read') GROUP BY doc_id""")
def scan_pages(t):
    read = t("catalog").where("state = 'read'").select("doc_id")
    s = t("doc_pages").where(X.sparse(F.col("text"))).join(read, "doc_id", "left_semi")
    return s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"))


@query("p34_fully_read", "SELECT o.l_orderkey AS source_id, sum(l_quantity) AS total FROM lineitem o GROUP BY o.l_orderkey HAVING sum(l_quantity) = 50 * count(*) OR sum(l_quantity) > 200")
def fully_read(t):
    """Sources whose windows add up to their stated total, or that are long enough to count as read in full."""
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("source_id")).agg(F.sum("l_quantity").alias("total"), F.count("*").alias("n"))
    return g.where((F.col("total") == 50 * F.col("n")) | (F.col("total") > 200)).select("source_id", "total")


@query("p35_member_projection", """
SELECT lot_id, string_agg(nm, '|' ORDER BY ord, nm) AS shown, max(n) - count(*) AS omitted FROM (
  SELECT lot_id, ord, substring(file_name, 1, 20) AS nm, row_number() OVER (PARTITION BY lot_id ORDER BY ord, file_name) AS rn, count(*) OVER (PARTITION BY lot_id) AS n FROM attachments) WHERE rn <= 4 GROUP BY lot_id""")
def member_projection(t, shown: int = 4):
    """A short public projection of a lot's members; how many are not shown is stated."""
    a = t("attachments").select("lot_id", "ord", F.substring("file_name", 1, 20).alias("nm"), "file_name")
    ranked = grouped_rank(a, ["lot_id"], [F.col("ord"), F.col("file_name")])
    first = ranked.where(F.col("position") <= shown).groupBy("lot_id").agg(F.sort_array(F.collect_list(F.struct("ord", "nm"))).alias("m"))
    n = a.groupBy("lot_id").agg(F.count("*").alias("n"))
    return first.join(n, "lot_id").select("lot_id", F.array_join(F.transform("m", lambda x: x["nm"]), "|").alias("shown"), (F.col("n") - F.size("m")).alias("omitted"))


@query("p36_extended_scope", """
SELECT lot_id, ord, file_id, CASE WHEN file_name LIKE '%.pdf' AND scope = 'lot' AND NOT inactive THEN 120 ELSE 40 END AS page_limit FROM attachments""")
def extended_scope(t):
    """A larger page limit needs every source-bound field to agree."""
    ok = (X.extension(F.col("file_name")) == "pdf") & (F.col("scope") == "lot") & ~F.col("inactive")
    return t("attachments").select("lot_id", "ord", "file_id", F.when(ok, 120).otherwise(40).alias("page_limit"))
