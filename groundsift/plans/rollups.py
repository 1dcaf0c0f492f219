"""A- and U-series: counts, states and set operations over evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsift.functions import text as X
from groundsift.operators.ranking import grouped_rank, with_neighbours
from groundsift.operators.tiles import box_overlap, tile_join
from groundsift.plans.evidence import card_files
from groundsift.plans.filters import active_lot, land_group
from groundsift.plans.joins import BOX, acts, candidates, mentions, overlay_layers
from groundsift.plans.scalars import act_texts, evidence_paragraphs, paragraph_action
from groundsift.registry import query

ROLES = ("boundary", "parcels", "roads", "exclusions", "restrictions", "buildings", "pzz", "quarters")


@query("a06_analysis_warnings", """
WITH r AS (SELECT unnest(['boundary', 'parcels', 'roads', 'exclusions', 'restrictions', 'buildings', 'pzz', 'quarters']) AS role), l AS (SELECT survey_id, CASE p_brand WHEN 'Brand#1' THEN 'parcels' WHEN 'Brand#2' THEN 'roads' WHEN 'Brand#3' THEN 'pzz' WHEN 'Brand#4' THEN 'boundary' END AS role, max(p_size) AS age, bool_and(p_type <> 'SMALL') AS official FROM parcels GROUP BY 1, 2)
SELECT s.survey_id, r.role, CASE WHEN l.role IS NULL THEN 'missing' WHEN NOT official AND age > 30 THEN 'unofficial,old' WHEN NOT official THEN 'unofficial' WHEN age > 30 THEN 'old' ELSE '' END AS warnings FROM surveys s CROSS JOIN r LEFT JOIN l ON l.survey_id = s.survey_id AND l.role = r.role""")
def analysis_warnings(t):
    """Per window and role: layer missing, not official, or older than 30 days."""
    role = F.when(F.col("p_brand") == "Brand#1", "parcels").when(F.col("p_brand") == "Brand#2", "roads").when(F.col("p_brand") == "Brand#3", "pzz").when(F.col("p_brand") == "Brand#4", "boundary")
    layers = t("parcels").withColumn("role", role).where("role IS NOT NULL").groupBy("survey_id", "role").agg(F.max("p_size").alias("age"), F.bool_and(F.col("p_type") != "SMALL").alias("official"))
    want = t("surveys").select("survey_id", F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("role"))
    j = want.join(layers, ["survey_id", "role"], "left")
    found = F.filter(F.array(F.when(~F.col("official"), "unofficial"), F.when(F.col("age") > 30, "old")), lambda w: w.isNotNull())
    return j.select("survey_id", "role", F.when(F.col("age").isNull(), "missing").otherwise(F.array_join(found, ",")).alias("warnings"))


@query("a07_result_summary", """
SELECT survey_id, count(*) AS candidate_count, count(*) FILTER (WHERE p_type = 'ECONOMY') AS offers, count(*) FILTER (WHERE p_type = 'PROMO') AS auctions, count(*) FILTER (WHERE (x1 - x0) * (y1 - y0) < 10000) AS small,
 0 AS confirmed_free FROM offers GROUP BY survey_id""")
def result_summary(t):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return candidates(t).groupBy("survey_id").agg(F.count("*").alias("candidate_count"), F.count_if(F.col("kind") == "offer").alias("offers"), F.count_if(F.col("kind") == "auction").alias("auctions"),
                                                  F.count_if(area < 10000).alias("small")).withColumn("confirmed_free", F.lit(0))


@query("a08_lot_counts", """
WITH n AS (SELECT l.lot_id, l.type_code, l.survey_id, count(DISTINCT x.k) AS numbers, count(DISTINCT CASE WHEN o.k IS NULL THEN x.k END) AS unlocated FROM lots l LEFT JOIN lot_numbers x ON l.lot_id = x.lot_id LEFT JOIN offers o ON o.k = x.k GROUP BY ALL)
SELECT survey_id, CASE type_code WHEN 'ZK' THEN 'land_provision' WHEN '229FZ' THEN 'debt_sale' ELSE 'other' END AS land_group, count(*) AS lots, count(*) FILTER (WHERE numbers = 0) AS lots_without_number, CAST(sum(unlocated) AS BIGINT) AS unlocated FROM n GROUP BY ALL""")
def lot_counts(t):
    """Lots per group; numbers without geometry and lots without number are stated, not dropped."""
    located = t("offers").select("k").distinct().withColumn("loc", F.lit(1))
    per_lot = (t("lot_numbers").select("lot_id", "k").distinct().join(located, "k", "left").groupBy("lot_id")
               .agg(F.count("*").alias("numbers"), F.count_if(F.col("loc").isNull()).alias("unlocated")))
    j = t("lots").select("lot_id", "survey_id", land_group(F.col("type_code")).alias("land_group")).join(per_lot, "lot_id", "left")
    return j.groupBy("survey_id", "land_group").agg(F.count("*").alias("lots"), F.count_if(F.col("numbers").isNull()).alias("lots_without_number"), F.coalesce(F.sum("unlocated"), F.lit(0)).alias("unlocated"))


@query("a09_parent_and_children", """
WITH q AS (SELECT survey_id, id, x0, y0, x1, y1, wx0, wy0, wx1, wy1, (wx0 + wx1) / 2 AS mx, (wy0 + wy1) / 2 AS my, p_size FROM parcels JOIN surveys USING (survey_id)),
t AS (SELECT survey_id, id, p_size <> 7 AND least(x1, wx1) > greatest(x0, wx0) AND least(y1, wy1) > greatest(y0, wy0) AS parent, p_size <> 9 AND least(x1, wx1) > greatest(x0, wx0) AND least(y1, wy1) > greatest(y0, wy0) AS child FROM q)
SELECT survey_id, count(*) FILTER (WHERE parent) AS parent_count, count(*) FILTER (WHERE child) AS children_unique_count, count(*) FILTER (WHERE child AND NOT parent) AS additional, count(*) FILTER (WHERE parent AND NOT child) AS parent_only, count(*) FILTER (WHERE child <> parent) = 0 AS responses_consistent, CAST(0 AS BIGINT) AS geometry_conflicts FROM t GROUP BY survey_id""")
def parent_and_children(t):
    """A window's answer against those of its four quarters: distinct ids, differences, conflicting outlines."""
    p = t("parcels").join(t("surveys"), "survey_id").withColumns({"mx": (F.col("wx0") + F.col("wx1")) / 2, "my": (F.col("wy0") + F.col("wy1")) / 2})
    areas = F.array(*[F.struct(F.lit(i).alias("part"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"), F.col(d).alias("d")) for i, (a, b, c, d) in enumerate(
        (("wx0", "wy0", "wx1", "wy1"), ("wx0", "wy0", "mx", "my"), ("mx", "wy0", "wx1", "my"), ("wx0", "my", "mx", "wy1"), ("mx", "my", "wx1", "wy1")))])
    rows = p.select("survey_id", "id", "p_size", *BOX, F.explode(areas).alias("q"))
    rows = rows.where((F.least("x1", "q.c") > F.greatest("x0", "q.a")) & (F.least("y1", "q.d") > F.greatest("y0", "q.b"))
                      & ~((F.col("q.part") == 0) & (F.col("p_size") == 7)) & ~((F.col("q.part") > 0) & (F.col("p_size") == 9)))
    ids = rows.groupBy("survey_id", "id").agg(F.bool_or(F.col("q.part") == 0).alias("parent"), F.bool_or(F.col("q.part") > 0).alias("child"), F.count_distinct(*BOX).alias("shapes"))
    return ids.groupBy("survey_id").agg(
        F.count_if("parent").alias("parent_count"), F.count_if("child").alias("children_unique_count"), F.count_if(F.col("child") & ~F.col("parent")).alias("additional"),
        F.count_if(F.col("parent") & ~F.col("child")).alias("parent_only"), (F.count_if(F.col("parent") != F.col("child")) == 0).alias("responses_consistent"), F.count_if(F.col("shapes") > 1).alias("geometry_conflicts"))


_MEN = """men AS (SELECT DISTINCT doc_id, page, k FROM (SELECT doc_id, 2 AS page, doc_id * 2 AS k FROM documents UNION ALL SELECT doc_id, 2, doc_id * 2 + 1 FROM documents UNION ALL SELECT doc_id, 3, doc_id * 2 FROM documents WHERE lang = 'fr'))"""


@query("a10_mentions", f"""WITH {_MEN} SELECT doc_id, concat('90:12:', CAST(CAST(floor(doc_id / 100.0) AS BIGINT) AS VARCHAR), ':', CAST(k AS VARCHAR)) AS number, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM men GROUP BY doc_id, k""")
def mention_pages(t):
    """Number to the sorted distinct pages that name it."""
    return mentions(t).groupBy("doc_id", "number").agg(F.array_join(F.transform(F.sort_array(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"))


@query("a11_coordinate_pages", "SELECT doc_id, page, CASE WHEN text LIKE '%МСК-91%' THEN 'МСК-91' ELSE 'СК-63' END AS labels FROM doc_pages WHERE page = 3 AND text NOT LIKE 'стр.%'")
def coordinate_pages(t):
    p = t("doc_pages").where(F.lower("text").rlike(f"(?iu){X.COORDINATE_LABEL_RE}"))
    return p.select("doc_id", "page", F.array_join(X.crs_labels(F.col("text")), ",").alias("labels"))


@query("a12_crs_status", "SELECT doc_id, CASE lang WHEN 'en' THEN 'parameters_missing' WHEN 'fr' THEN 'parameters_missing' ELSE 'label_missing' END AS crs_status FROM documents")
def crs_status(t):
    names = F.explode_outer(F.transform(X.crs_labels(F.col("text")), X.crs_name))
    n = t("doc_pages").select("doc_id", names.alias("name")).groupBy("doc_id").agg(F.count_distinct("name").alias("n"))
    return n.select("doc_id", F.when(F.col("n") > 1, "ambiguous_labels").when(F.col("n") == 1, "parameters_missing").otherwise("label_missing").alias("crs_status"))


def readings(t):
    """Numbers read from two views of every turn, line by line: assistants are one view, all others the other; words of three letters stand for numbers."""
    c = t("conversations").select("conv_id", F.when(F.col("role") == "assistant", 2).otherwise(1).alias("view"), F.explode(F.split(F.lower("text"), r"\s+")).alias("number"))
    return c.where(F.col("number").rlike(r"^[a-z]{3}$")).distinct()


_READ = """rd AS (SELECT DISTINCT conv_id, CASE WHEN role = 'assistant' THEN 2 ELSE 1 END AS view, w AS number FROM (SELECT conv_id, role, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM conversations) WHERE regexp_matches(w, '^[a-z]{3}$'))"""


@query("a13_u04_reading_agreement", f"WITH {_READ} SELECT conv_id, number, CASE WHEN count(*) = 2 THEN 'both' ELSE 'one' END AS agreement FROM rd GROUP BY conv_id, number")
def reading_agreement(t):
    r = readings(t)
    return r.groupBy("conv_id", "number").agg(F.count("*").alias("n")).select("conv_id", "number", F.when(F.col("n") == 2, "both").otherwise("one").alias("agreement"))


@query("a14_ocr_rollup", f"WITH {_READ}, a AS (SELECT conv_id, number, count(*) AS n FROM rd GROUP BY conv_id, number) SELECT number, count(*) AS pages, count(*) FILTER (WHERE n = 2) AS agreed_pages, count(*) FILTER (WHERE n = 1) AS single_pages FROM a GROUP BY number")
def ocr_rollup(t):
    a = readings(t).groupBy("conv_id", "number").agg(F.count("*").alias("n"))
    return a.groupBy("number").agg(F.count("*").alias("pages"), F.count_if(F.col("n") == 2).alias("agreed_pages"), F.count_if(F.col("n") == 1).alias("single_pages"))


@query("a15_listing_conflict", "SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS link, count(*) AS listings, count(DISTINCT html) > 1 AS listing_conflict FROM pages GROUP BY 1")
def listing_conflict(t):
    """One url under different titles."""
    p = t("pages").select(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/$", "").alias("link"), F.sha2("html", 256).alias("title"))
    return p.groupBy("link").agg(F.count("*").alias("listings"), (F.count_distinct("title") > 1).alias("listing_conflict"))


@query("a16_title_mentions", f"""WITH {_MEN}, u AS (SELECT doc_id, k, CAST(page AS BIGINT) AS page, false AS in_title FROM men UNION ALL SELECT doc_id, doc_id * 2, NULL, true FROM documents WHERE lang = 'es')
SELECT doc_id, concat('90:12:', CAST(CAST(floor(doc_id / 100.0) AS BIGINT) AS VARCHAR), ':', CAST(k AS VARCHAR)) AS number, count(page) AS pages, bool_or(in_title) AS in_title FROM u GROUP BY doc_id, k""")
def title_mentions(t):
    title = t("doc_pages").where("page = 2").join(t("documents").where("lang = 'es'").select("doc_id"), "doc_id", "left_semi")
    named = title.select("doc_id", F.get(X.numbers(F.col("text")), F.lit(0)).alias("number"), F.lit(None).cast("bigint").alias("page"), F.lit(True).alias("in_title"))
    return mentions(t).select("doc_id", "number", "page", F.lit(False).alias("in_title")).unionByName(named).groupBy("doc_id", "number").agg(F.count("page").alias("pages"), F.bool_or("in_title").alias("in_title"))


@query("a17_index_counters", """
WITH d AS (SELECT survey_id, doc_id, 3 AS total, count(*) FILTER (WHERE page < 3 OR doc_id % 2 = 0) AS done, count(*) FILTER (WHERE length(regexp_replace(text, '\\s', '', 'g')) < 20) AS sparse FROM doc_pages GROUP BY survey_id, doc_id)
SELECT survey_id, count(*) AS documents, CAST(sum(total) AS BIGINT) AS total_pages, CAST(sum(done) AS BIGINT) AS processed_pages, CAST(sum(total - done) AS BIGINT) AS remaining_pages, CAST(sum(sparse) AS BIGINT) AS sparse_pages, count(*) FILTER (WHERE done = total) AS complete_documents FROM d GROUP BY survey_id""")
def index_counters(t):
    read = (F.col("page") < 3) | (F.col("doc_id") % 2 == 0)
    d = t("doc_pages").groupBy("survey_id", "doc_id").agg(F.count("*").alias("total"), F.count_if(read).alias("done"), F.count_if(X.sparse(F.col("text"))).alias("sparse"))
    return d.groupBy("survey_id").agg(F.count("*").alias("documents"), F.sum("total").alias("total_pages"), F.sum("done").alias("processed_pages"), F.sum(F.col("total") - F.col("done")).alias("remaining_pages"),
                                      F.sum("sparse").alias("sparse_pages"), F.count_if(F.col("done") == F.col("total")).alias("complete_documents"))


@query("a18_archive_counters", """
SELECT user_id AS archive, count(*) AS total, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS received, count(*) FILTER (WHERE event_type = 'signup') AS remaining, count(*) FILTER (WHERE event_type = 'error') AS errors, bool_and(event_type IN ('view', 'click')) AS all_received FROM events GROUP BY user_id""")
def archive_counters(t):
    got = F.col("event_type").isin("view", "click")
    return t("events").groupBy(F.col("user_id").alias("archive")).agg(F.count("*").alias("total"), F.count_if(got).alias("received"), F.count_if(F.col("event_type") == "signup").alias("remaining"),
                                                                      F.count_if(F.col("event_type") == "error").alias("errors"), F.bool_and(got).alias("all_received"))


@query("a19_map_coverage", """
SELECT survey_id, count(*) AS pages, count(*) FILTER (WHERE doc_id % 3 = 0) AS rendered, count(*) FILTER (WHERE doc_id % 3 = 1) AS remaining, count(*) FILTER (WHERE doc_id % 3 = 2) AS errors FROM doc_pages GROUP BY survey_id""")
def map_coverage(t):
    k = F.col("doc_id") % 3
    return t("doc_pages").groupBy("survey_id").agg(F.count("*").alias("pages"), F.count_if(k == 0).alias("rendered"), F.count_if(k == 1).alias("remaining"), F.count_if(k == 2).alias("errors"))


@query("a20_unread_pages", "SELECT l_suppkey AS project, CAST(sum(greatest(0, l_quantity - 40)) AS BIGINT) AS unread, count(*) FILTER (WHERE l_quantity > 40 AND l_quantity <= 48) AS queued, count(*) FILTER (WHERE l_quantity > 48) AS limited FROM lineitem GROUP BY l_suppkey")
def unread_pages(t):
    """Pages beyond the reading limit, files that a longer limit would finish, and files beyond any limit."""
    q = F.col("l_quantity")
    return t("lineitem").groupBy(F.col("l_suppkey").alias("project")).agg(F.sum(F.greatest(F.lit(0.0), q - 40)).cast("bigint").alias("unread"), F.count_if((q > 40) & (q <= 48)).alias("queued"), F.count_if(q > 48).alias("limited"))


@query("a21_archive_members", """
SELECT lot_id, count(*) AS members, count(*) FILTER (WHERE file_name NOT LIKE '%.zip') AS readable, CASE WHEN count(*) FILTER (WHERE file_name LIKE '%.zip') = 0 THEN 'read' ELSE 'partial' END AS state FROM attachments GROUP BY lot_id""")
def archive_members(t):
    bad = X.extension(F.col("file_name")) == "zip"
    return t("attachments").groupBy("lot_id").agg(F.count("*").alias("members"), F.count_if(~bad).alias("readable"), F.when(F.count_if(bad) == 0, "read").otherwise("partial").alias("state"))


@query("a22_attachment_groups", """
SELECT survey_id, type_code, count(*) AS files, count(*) FILTER (WHERE inactive) AS inactive, greatest(0, count(*) - 20) AS omitted FROM attachments GROUP BY survey_id, type_code""")
def attachment_groups(t):
    n = F.count("*")
    return t("attachments").groupBy("survey_id", "type_code").agg(n.alias("files"), F.count_if("inactive").alias("inactive"), F.greatest(F.lit(0), n - 20).alias("omitted"))


@query("a23_frame_summary", """
WITH f AS (SELECT p_partkey, unnest(generate_series(1, p_size - 1)) AS frame, p_size FROM part), o AS (SELECT f.p_partkey, f.frame, CASE WHEN (f.p_partkey + f.frame) % 3 = 0 THEN 'received' WHEN (f.p_partkey + f.frame) % 7 = 0 THEN 'error' END AS st FROM f)
SELECT p_partkey, count(*) AS declared, count(*) FILTER (WHERE st = 'received') AS received, count(*) FILTER (WHERE st = 'error') AS errors, count(*) FILTER (WHERE st IS NULL) AS remaining FROM o GROUP BY p_partkey""")
def frame_summary(t):
    """Auxiliary frames a file declares, against what was observed of them."""
    f = t("part").where("p_size > 1").select("p_partkey", F.explode(F.sequence(F.lit(1), F.col("p_size") - 1)).alias("frame"))
    s = (F.col("p_partkey") + F.col("frame"))
    st = F.when(s % 3 == 0, "received").when(s % 7 == 0, "error")
    return f.withColumn("st", st).groupBy("p_partkey").agg(F.count("*").alias("declared"), F.count_if(F.col("st") == "received").alias("received"), F.count_if(F.col("st") == "error").alias("errors"), F.count_if(F.col("st").isNull()).alias("remaining"))


@query("a24_archive_summary", """
SELECT l.type_code, count(*) FILTER (WHERE a.file_name LIKE '%.zip' AND NOT inactive AND declared_size <= 8388608) AS pending, count(*) FILTER (WHERE a.file_name LIKE '%.zip' AND declared_size > 8388608) AS blocked, count(*) FILTER (WHERE a.file_name LIKE '%.zip' AND l.status = 'SUCCEED') AS retained
FROM attachments a JOIN lots l ON a.lot_id = l.lot_id GROUP BY l.type_code""")
def archive_summary(t):
    zip_ = X.extension(F.col("file_name")) == "zip"
    j = t("attachments").join(t("lots").select("lot_id", F.col("type_code").alias("lot_type"), "status"), "lot_id")
    small = F.col("declared_size") <= 8 * 1024 * 1024
    return j.groupBy(F.col("lot_type").alias("type_code")).agg(F.count_if(zip_ & ~F.col("inactive") & small).alias("pending"), F.count_if(zip_ & ~small).alias("blocked"), F.count_if(zip_ & (F.col("status") == "SUCCEED")).alias("retained"))


@query("a25_component_groups", """
WITH c AS (SELECT DISTINCT l_orderkey AS parcel, l_linenumber AS n FROM lineitem), h AS (SELECT parcel, max(n) AS top FROM c GROUP BY parcel), m AS (SELECT h.parcel, g AS n FROM h, LATERAL (SELECT unnest(generate_series(1, h.top)) AS g) x)
SELECT h.parcel, (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FROM c WHERE c.parcel = h.parcel) AS observed, coalesce((SELECT string_agg(CAST(m.n AS VARCHAR), ',' ORDER BY m.n) FROM m WHERE m.parcel = h.parcel AND NOT EXISTS (SELECT 1 FROM c WHERE c.parcel = m.parcel AND c.n = m.n)), '') AS missing FROM h""")
def component_groups(t):
    """Component numbers seen, and those missing below the highest."""
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("parcel")).agg(F.sort_array(F.collect_set("l_linenumber")).alias("n"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return g.select("parcel", text(F.col("n")).alias("observed"), text(F.array_except(F.sequence(F.lit(1), F.array_max("n")), F.col("n"))).alias("missing"))


@query("a26_role_totals", "SELECT survey_id, p_type AS purpose_hint, count(*) AS count, round(sum((x1 - x0) * (y1 - y0)), 2) AS sum_area_m2 FROM parcels GROUP BY survey_id, p_type")
def role_totals(t):
    a = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return t("parcels").groupBy("survey_id", F.col("p_type").alias("purpose_hint")).agg(F.count("*").alias("count"), F.round(F.sum(a), 2).alias("sum_area_m2"))


@query("a27_origin_ambiguity", """
SELECT survey_id, p_brand, count(DISTINCT (p_type, p_size)) > 1 AS origin_ambiguous, CASE WHEN count(DISTINCT (p_type, p_size)) = 1 THEN round(sum((x1 - x0) * (y1 - y0)) - min(p_size) * 100, 2) END AS difference_m2 FROM parcels GROUP BY survey_id, p_brand""")
def origin_ambiguity(t):
    """Several stated origins are never reconciled; a single one is compared with the drawn area."""
    n = F.count_distinct("p_type", "p_size")
    a = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return t("parcels").groupBy("survey_id", "p_brand").agg((n > 1).alias("origin_ambiguous"), F.when(n == 1, F.round(a - F.min("p_size") * 100, 2)).alias("difference_m2"))


@query("a28_duplicate_labels", "SELECT l_orderkey AS table_id, l_linenumber AS ord, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS rejected FROM lineitem")
def duplicate_labels(t):
    """A label used twice rejects every row that carries it."""
    n = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return t("lineitem").join(n, ["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("ord"), "l_partkey", (F.col("n") > 1).alias("rejected"))


_ACT = "printf('%04d-%02d-%02d', 2015 + doc_id % 10, 1 + doc_id % 12, 1 + doc_id % 28)"


@query("a29_act_timeline", f"""
WITH a AS (SELECT lang AS subject, {_ACT} AS date, CAST(doc_id % 97 AS VARCHAR) AS number, sha256(text) AS s, count(*) AS urls FROM documents GROUP BY ALL)
SELECT subject, date, number, s AS sha256, urls, row_number() OVER (PARTITION BY subject ORDER BY date, number, s) AS position FROM a""")
def act_timeline(t):
    """Acts per subject in order of date and number; same identity and bytes are one entry."""
    a = acts(t).join(t("documents").select("doc_id", F.col("lang").alias("subject"), F.sha2("text", 256).alias("sha256")), "doc_id")
    g = a.groupBy("subject", "date", "number", "sha256").agg(F.count("*").alias("urls"))
    return grouped_rank(g, ["subject"], [F.col("date"), F.col("number"), F.col("sha256")])


# The checks of a registry entry.
CHECKS = ("boundary", "rights", "category", "general_plan", "pzz", "red_lines", "restrictions", "access", "visual", "planning", "refusal", "procedure", "authority", "contour")
PACKAGE_CHECKS = ("srzu", "application", "channel")


def check_rows(t):
    """Registry checks: quality gives the result, toxicity a failure, for the first checks of the list."""
    names = F.array(*[F.lit(c) for c in CHECKS])
    c = t("labels").select("doc_id", "quality", "toxic", F.posexplode(names).alias("i", "check"))
    result = F.when((F.col("toxic") == 1) & (F.col("i") == 1), "fail").when(F.col("quality") == 1, "pass").otherwise("unknown")
    source = F.when((F.col("doc_id") % 11 == 0) & (F.col("i") == 3), "  ").otherwise("реестр")
    return c.select("doc_id", "check", result.alias("result"), source.alias("source"), F.lit("сверено").alias("note"), (F.col("doc_id") % 40).alias("age"))


def passed():
    return (F.col("result") == "pass") & (F.trim("source") != "") & (F.trim("note") != "") & F.col("age").between(0, 30)


_STALE = "doc_id % 13 = 0"


@query("a30_registry_status", f"""
SELECT doc_id, CASE WHEN toxic = 1 THEN 'red' WHEN {_STALE} THEN 'yellow' WHEN quality = 1 AND doc_id % 40 <= 30 AND doc_id % 11 <> 0 THEN 'green' ELSE 'yellow' END AS status FROM labels""")
def registry_status(t):
    """Any failure is red, even when stale; stale is yellow; green needs every check passed."""
    g = check_rows(t).groupBy("doc_id").agg(F.bool_or(F.col("result") == "fail").alias("failed"), F.count_if(passed()).alias("ok"))
    return g.select("doc_id", F.when(F.col("failed"), "red").when(F.expr(_STALE), "yellow").when(F.col("ok") == len(CHECKS), "green").otherwise("yellow").alias("status"))


@query("a31_blockers", f"""
SELECT doc_id, CAST(CASE WHEN quality = 0 OR doc_id % 40 > 30 THEN 14 ELSE CASE WHEN toxic = 1 THEN 1 ELSE 0 END + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END END + CASE WHEN {_STALE} THEN 1 ELSE 0 END AS BIGINT) AS blockers, 'review' AS effective_workflow FROM labels""")
def blockers(t):
    """Checks not passed, plus staleness; the package checks are missing, so nobody is ready."""
    want = t("labels").select("doc_id", F.explode(F.array(*[F.lit(c) for c in CHECKS])).alias("check"))
    done = check_rows(t).where(passed()).select("doc_id", "check")
    left = want.join(done, ["doc_id", "check"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("open"))
    n = F.coalesce("open", F.lit(0)) + F.when(F.expr(_STALE), 1).otherwise(0)
    return t("labels").select("doc_id").join(left, "doc_id", "left").select("doc_id", n.alias("blockers"), F.when(n + len(PACKAGE_CHECKS) > 0, "review").otherwise("ready").alias("effective_workflow"))


def evidence_counts(t):
    """One row per candidate with the number of matches of every evidence layer."""
    hits = (tile_join(candidates(t), overlay_layers(t).unionByName(t("context").select("survey_id", F.col("mode").alias("layer"), "id", *BOX)))
            .withColumn("a", box_overlap()).where("a > 0.01"))
    names = ("free", "auction", "pzz", "restrictions", "settlements", "quarters", "schemes", "planned_parcels", "water", "forests", "protected", "heritage")
    g = hits.groupBy("survey_id", "id").agg(*[F.count_if(F.col("r_layer") == n).alias(n) for n in names])
    c = candidates(t).select("survey_id", "id", "kind", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    return c.join(g, ["survey_id", "id"], "left").fillna(0, list(names))


_EV = """ly AS (SELECT survey_id, CASE WHEN p_type = 'ECONOMY' THEN 'free' ELSE 'auction' END AS layer, x0, y0, x1, y1 FROM offers UNION ALL SELECT survey_id, 'pzz', x0, y0, x1, y1 FROM zones UNION ALL SELECT survey_id, 'restrictions', x0, y0, x1, y1 FROM restrictions
  UNION ALL SELECT survey_id, mode, x0, y0, x1, y1 FROM context),
ev AS (SELECT c.survey_id, c.id, c.p_type, (c.x1 - c.x0) * (c.y1 - c.y0) AS area, count(*) FILTER (WHERE l.layer = 'pzz') AS pzz, count(*) FILTER (WHERE l.layer = 'restrictions') AS restrictions, count(*) FILTER (WHERE l.layer = 'settlements') AS settlements,
  count(*) FILTER (WHERE l.layer = 'schemes') AS schemes, count(*) FILTER (WHERE l.layer = 'planned_parcels') AS planned_parcels, count(*) FILTER (WHERE l.layer IN ('water', 'forests', 'protected', 'heritage')) AS env, count(*) FILTER (WHERE l.layer = 'quarters') AS quarters
  FROM offers c LEFT JOIN ly l ON c.survey_id = l.survey_id AND c.x0 < l.x1 AND l.x0 < c.x1 AND c.y0 < l.y1 AND l.y0 < c.y1 GROUP BY ALL)"""


@query("a32_evidence_assessment", f"""WITH {_EV}, rows AS (SELECT survey_id, id, 'cadastre' AS key, CASE WHEN quarters > 0 THEN 'attention' ELSE 'observed' END AS state, quarters AS evidence FROM ev
 UNION ALL SELECT survey_id, id, 'boundary', CASE WHEN settlements > 0 THEN 'observed' ELSE 'unknown' END, settlements FROM ev UNION ALL SELECT survey_id, id, 'zoning', CASE WHEN pzz > 0 THEN 'observed' ELSE 'unknown' END, pzz FROM ev
 UNION ALL SELECT survey_id, id, 'restrictions', CASE WHEN restrictions + schemes + planned_parcels + env > 0 THEN 'attention' ELSE 'observed' END, restrictions + schemes + planned_parcels + env FROM ev
 UNION ALL SELECT survey_id, id, 'rights', 'unknown', 0 FROM ev UNION ALL SELECT survey_id, id, 'contour', CASE WHEN area > 20000 THEN 'attention' ELSE 'observed' END, 1 FROM ev) SELECT *, false AS confirmed FROM rows""")
def evidence_assessment(t):
    """Long table of check groups per candidate; no observation ever confirms one, and rights stay unknown."""
    e = evidence_counts(t)
    env = sum((F.col(c) for c in ("forests", "protected", "heritage")), F.col("water"))
    limits = F.col("restrictions") + F.col("schemes") + F.col("planned_parcels") + env

    def row(key, state, n):
        return F.struct(F.lit(key).alias("key"), state.alias("state"), n.cast("bigint").alias("evidence"))

    obs = lambda c, yes="observed", no="unknown": F.when(c > 0, yes).otherwise(no)
    rows = F.array(row("cadastre", obs(F.col("quarters"), "attention", "observed"), F.col("quarters")), row("boundary", obs(F.col("settlements")), F.col("settlements")),
                   row("zoning", obs(F.col("pzz")), F.col("pzz")), row("restrictions", obs(limits, "attention", "observed"), limits), row("rights", F.lit("unknown"), F.lit(0)),
                   row("contour", F.when(F.col("area") > 20000, "attention").otherwise("observed"), F.lit(1)))
    return e.select("survey_id", "id", F.explode(rows).alias("r")).select("survey_id", "id", "r.*", F.lit(False).alias("confirmed"))


@query("a33_candidate_flags", f"""WITH {_EV} SELECT survey_id, id, rtrim(CASE WHEN settlements = 0 THEN 'no settlement boundary;' ELSE '' END || CASE WHEN schemes > 0 THEN 'schemes;' ELSE '' END || CASE WHEN planned_parcels > 0 THEN 'planned parcels;' ELSE '' END || CASE WHEN restrictions > 0 THEN 'restrictions;' ELSE '' END
 || CASE WHEN pzz = 0 THEN 'no zone;' ELSE '' END || CASE WHEN area > 20000 THEN 'large;' ELSE '' END, ';') AS flags FROM ev""")
def candidate_flags(t):
    flags = F.array(F.when(F.col("settlements") == 0, "no settlement boundary"), F.when(F.col("schemes") > 0, "schemes"), F.when(F.col("planned_parcels") > 0, "planned parcels"),
                    F.when(F.col("restrictions") > 0, "restrictions"), F.when(F.col("pzz") == 0, "no zone"), F.when(F.col("area") > 20000, "large"))
    return evidence_counts(t).select("survey_id", "id", F.array_join(F.filter(flags, lambda x: x.isNotNull()), ";").alias("flags"))


@query("a34_land_status", f"""WITH {_EV} SELECT survey_id, id, CASE WHEN survey_id % 3 > 0 THEN schemes END AS scheme_matches, CASE WHEN survey_id % 3 > 0 THEN planned_parcels END AS planned_matches, 'unknown' AS ownership FROM ev""")
def land_status(t):
    """Match counts only where the context belongs to the same window; otherwise unknown, not zero."""
    same = F.col("survey_id") % 3 > 0
    return evidence_counts(t).select("survey_id", "id", F.when(same, F.col("schemes")).alias("scheme_matches"), F.when(same, F.col("planned_parcels")).alias("planned_matches"), F.lit("unknown").alias("ownership"))


@query("a35_map_pages", """
SELECT doc_id, page, CASE WHEN lang = 'fr' THEN 'map' ELSE 'reference' END AS kind, CASE WHEN page = 2 THEN concat('Ж', CAST(1 + doc_id % 4 AS VARCHAR), CASE WHEN doc_id % 5 = 0 THEN '.1' ELSE '' END, ',СХ2') ELSE '' END AS zone_hints FROM doc_pages JOIN documents USING (doc_id)""")
def map_pages(t):
    """Pages that show a zoning map: both editions make a map page, otherwise a reference."""
    text = F.concat(F.lit("Фрагмент карты градостроительного зонирования. Старая редакция. "), F.when(F.col("lang") == "fr", "Новая  редакция. ").otherwise(""), F.col("page_text"))
    p = t("doc_pages").select("doc_id", "page", F.col("text").alias("page_text")).join(t("documents").select("doc_id", "lang"), "doc_id").withColumn("body", text)
    p = p.where(F.col("body").rlike(r"(?iu)фрагмент\s+карты\s+градостроительного\s*зонирования"))
    both = F.col("body").rlike(r"(?iu)старая\s+редакция") & F.col("body").rlike(r"(?iu)новая\s+редакция")
    return p.select("doc_id", "page", F.when(both, "map").otherwise("reference").alias("kind"), F.array_join(X.map_zone_codes(F.col("page_text")), ",").alias("zone_hints"))


@query("a37_state_counts", """
SELECT type_code, count(*) FILTER (WHERE status = 'PUBLISHED') AS published, count(*) FILTER (WHERE status = 'APPLICATIONS_SUBMISSION') AS accepting, count(*) FILTER (WHERE status = 'SUCCEED') AS closed FROM lots GROUP BY type_code""")
def state_counts(t):
    p = t("lots").groupBy("type_code").pivot("status", ["PUBLISHED", "APPLICATIONS_SUBMISSION", "SUCCEED"]).count().fillna(0)
    return p.select("type_code", F.col("PUBLISHED").alias("published"), F.col("APPLICATIONS_SUBMISSION").alias("accepting"), F.col("SUCCEED").alias("closed"))


@query("a38_index_gate", """
SELECT l_orderkey AS doc, count(*) - count(DISTINCT l_linenumber) AS repeated, count(*) FILTER (WHERE l_linenumber > 6) AS out_of_range, count(*) - count(DISTINCT l_linenumber) = 0 AND count(*) FILTER (WHERE l_linenumber > 6) = 0 AS valid FROM lineitem GROUP BY l_orderkey""")
def index_gate(t):
    """Page numbers unique and inside the document."""
    per_page = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    g = per_page.groupBy(F.col("l_orderkey").alias("doc")).agg(F.sum(F.col("n") - 1).alias("repeated"), F.coalesce(F.sum(F.when(F.col("l_linenumber") > 6, F.col("n"))), F.lit(0)).alias("out_of_range"))
    return g.withColumn("valid", (F.col("repeated") == 0) & (F.col("out_of_range") == 0))


@query("a40_source_manifest", """
SELECT survey_id, 'parcels' AS source, count(*) AS count, false AS coverage_confirmed FROM parcels GROUP BY survey_id UNION ALL SELECT survey_id, 'buildings', count(*), false FROM buildings GROUP BY survey_id
UNION ALL SELECT survey_id, 'lots', count(*), false FROM lots GROUP BY survey_id UNION ALL SELECT survey_id, 'documents', count(*), false FROM catalog GROUP BY survey_id""")
def source_manifest(t):
    out = None
    for source, table in (("parcels", "parcels"), ("buildings", "buildings"), ("lots", "lots"), ("documents", "catalog")):
        c = t(table).groupBy("survey_id").agg(F.count("*").alias("count")).select("survey_id", F.lit(source).alias("source"), "count", F.lit(False).alias("coverage_confirmed"))
        out = c if out is None else out.unionByName(c)
    return out


@query("u02_distinct_links", "SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def distinct_links(t):
    return t("pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("url")).distinct()


@query("u03_set_differences", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45")
def set_differences(t):
    l = t("lineitem")
    return l.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).distinct().join(l.where("l_returnflag = 'A' AND l_quantity > 45").select(F.col("l_partkey").alias("k")).distinct(), "k", "left_anti")


@query("u05_catalogue_union", """
WITH r AS (SELECT url, source AS ref FROM catalog UNION ALL SELECT url, 'history' FROM catalog WHERE lang = 'fr' UNION ALL SELECT url, 'archive' FROM catalog WHERE lang = 'es')
SELECT url, count(*) AS refs, string_agg(ref, ',' ORDER BY ref) AS listing_references FROM r GROUP BY url""")
def catalogue_union(t):
    """Listings, history and archive as one catalogue; references accumulate per url."""
    c = t("catalog")
    r = (c.select("url", F.col("source").alias("ref")).unionByName(c.where("lang = 'fr'").select("url", F.lit("history").alias("ref")))
         .unionByName(c.where("lang = 'es'").select("url", F.lit("archive").alias("ref"))))
    return r.groupBy("url").agg(F.count("*").alias("refs"), F.array_join(F.sort_array(F.collect_set("ref")), ",").alias("listing_references"))


@query("u06_upsert", "SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def upsert(t):
    """One observation replaces the earlier one of its key."""
    g = t("events").groupBy(F.col("user_id").alias("key")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return g.select("key", "m.event_id", F.col("m.event_type").alias("state"))


@query("u07_update_history", """
SELECT user_id AS id, event_id AS version, event_type AS workflow, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS current FROM events""")
def update_history(t):
    """Every update keeps the state it replaced; the last one is current."""
    e = with_neighbours(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], ["event_id", "event_type"])
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("event_type").alias("workflow"), F.col("prev_event_type").alias("previous"), F.col("next_event_id").isNull().alias("current"))


@query("p28_lot_list_filters", """
SELECT lot_id, CASE WHEN lot_id % 5 = 0 THEN 'unknown' WHEN n > 0 THEN 'inside' ELSE 'outside' END AS shown_state FROM (SELECT l.lot_id, count(x.k) FILTER (WHERE CAST(floor(x.k / 200.0) AS BIGINT) = l.survey_id) AS n FROM lots l LEFT JOIN lot_numbers x ON l.lot_id = x.lot_id WHERE l.type_code = 'ZK' GROUP BY l.lot_id)""")
def lot_list_filters(t):
    """Lots of one group with their spatial state; a stale match shows as unknown."""
    own = F.floor(F.col("k") / 200) == F.col("survey_id")
    g = t("lots").where("type_code = 'ZK'").join(t("lot_numbers").select("lot_id", "k"), "lot_id", "left").groupBy("lot_id").agg(F.count_if(own).alias("n"))
    return g.select("lot_id", F.when(F.col("lot_id") % 5 == 0, "unknown").when(F.col("n") > 0, "inside").otherwise("outside").alias("shown_state"))


@query("p29_document_list_filters", "SELECT doc_id FROM documents WHERE lang = 'fr' OR doc_id * 2 IN (SELECT k FROM parcels WHERE k < 500) OR doc_id * 2 + 1 IN (SELECT k FROM parcels WHERE k < 500)")
def document_list_filters(t):
    """Documents with a mention in the area, or with a mention on a coordinate page."""
    m = mentions(t)
    in_area = m.join(t("parcels").where("k < 500").select(X.canonical(F.col("cad_num")).alias("number")), "number", "left_semi").select("doc_id")
    return in_area.union(m.where("page = 3").select("doc_id")).distinct()
