"""Joins over cards, catalogues, observations and the registry (J22 to J45)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundsift.functions import text as X
from groundsift.operators.ranking import global_rank
from groundsift.plans.feeds import descriptors
from groundsift.plans.joins import BOX, candidates, lot_number_pairs
from groundsift.registry import query


@query("j22_listing_chain", """
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'title' WHEN doc_id % 4 = 2 THEN 'digest' WHEN doc_id % 7 = 0 THEN 'not listed' END AS violation FROM catalog""")
def listing_chain(t):
    """A reference must fit the listing page it names: title, url, digest and date all equal, nulls included."""
    k = F.col("doc_id")
    page = t("catalog").select("url", F.col("title").alias("l_title"), F.sha2("source", 256).alias("l_sha"), F.lit("2024-01-01").alias("l_at"), k.alias("lk")).where("lk % 7 <> 0 OR lk % 4 IN (1, 2)").drop("lk")
    ref = t("catalog").select("doc_id", "url", F.when(k % 4 == 1, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"),
                              F.when(k % 4 == 2, F.lit("0")).otherwise(F.sha2("source", 256)).alias("sha"), F.lit("2024-01-01").alias("at"))
    j = ref.join(page, "url", "left")
    why = (F.when(F.col("l_sha").isNull(), "not listed").when(~F.col("title").eqNullSafe(F.col("l_title")), "title")
           .when(~F.col("sha").eqNullSafe(F.col("l_sha")), "digest").when(~F.col("at").eqNullSafe(F.col("l_at")), "date"))
    return j.select("doc_id", why.alias("violation"))


READABLE = ("pdf", "docx", "doc", "rtf", "jpg", "jpeg", "png")


def size_limit(fmt):
    return F.when(fmt == "pdf", 16 * 1024 * 1024).otherwise(8 * 1024 * 1024)


def initial_state(inactive):
    fmt = F.col("format")
    return (F.when(inactive, "inactive").when(F.col("declared_size") > size_limit(fmt), "oversized").when(fmt.isin(*READABLE), "pending").otherwise("unsupported"))


def card_files(t):
    """Files of all cards: one per content key, with conflict and eligibility; associations stay their own table."""
    d = descriptors(t)
    versions = d.groupBy("file_id").agg(F.count_distinct("key").alias("versions"))
    f = d.groupBy("key", "file_id", "file_name", "declared_size", "format").agg(F.count("*").alias("associations"), F.bool_or(~F.col("inactive")).alias("some_active"), F.bool_and("inactive").alias("all_inactive"))
    f = f.join(versions, "file_id").withColumn("metadata_conflict", F.col("versions") > 1)
    f = f.withColumn("eligible", ~F.col("metadata_conflict") & F.col("some_active"))
    return f.withColumn("state", initial_state(F.col("all_inactive")))


_FILES = """d AS (SELECT *, concat(file_name, '|', CAST(declared_size AS VARCHAR)) AS ky, lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) AS format FROM attachments),
 f AS (SELECT file_id, file_name, declared_size, format, count(*) AS associations, bool_or(NOT inactive) AS some_active, bool_and(inactive) AS all_inactive FROM d GROUP BY file_id, file_name, declared_size, format),
 v AS (SELECT file_id, count(DISTINCT ky) AS versions FROM d GROUP BY file_id),
 files AS (SELECT f.*, versions > 1 AS metadata_conflict, versions = 1 AND some_active AS eligible, CASE WHEN all_inactive THEN 'inactive' WHEN declared_size > CASE WHEN format = 'pdf' THEN 16777216 ELSE 8388608 END THEN 'oversized'
   WHEN format IN ('pdf', 'docx', 'doc', 'rtf', 'jpg', 'jpeg', 'png') THEN 'pending' ELSE 'unsupported' END AS state FROM f JOIN v ON f.file_id = v.file_id)"""


@query("j23_p25_card_files", f"WITH {_FILES} SELECT file_id, file_name, associations, metadata_conflict, eligible, state FROM files")
def files(t):
    return card_files(t).select("file_id", "file_name", "associations", "metadata_conflict", "eligible", "state")


@query("j24_files_of_lots", f"WITH {_FILES} SELECT d.lot_id, count(DISTINCT (d.file_id, d.file_name)) AS files FROM d JOIN files x ON d.file_id = x.file_id AND d.file_name = x.file_name WHERE x.eligible AND NOT d.inactive GROUP BY d.lot_id")
def files_of_lots(t):
    """Files reach a lot only through explicit, active associations."""
    ok = card_files(t).where("eligible").select("key")
    d = descriptors(t).where(~F.col("inactive")).join(ok, "key", "left_semi")
    return d.select("lot_id", "key").distinct().groupBy("lot_id").agg(F.count("*").alias("files"))


@query("j25_source_binding", """
SELECT a.file_id, a.lot_id, a.file_name, count(*) AS occurrences FROM attachments a JOIN lots l ON a.lot_id = l.lot_id WHERE a.file_name LIKE '%.zip' AND l.type_code = 'ZK' AND l.status <> 'SUCCEED' GROUP BY a.file_id, a.lot_id, a.file_name""")
def source_binding(t):
    """Archive files bound to accepted cards of current lots, descriptor for descriptor."""
    lots = t("lots").where("type_code = 'ZK' AND status <> 'SUCCEED'").select("lot_id")
    d = descriptors(t).where("format = 'zip'").join(lots, "lot_id", "left_semi")
    return d.groupBy("file_id", "lot_id", "file_name").agg(F.count("*").alias("occurrences"))


@query("j26_lot_precedence", """
WITH u AS (SELECT lot_id, 'regional' AS snapshot, 0 AS p FROM lots WHERE type_code = 'ZK' UNION ALL SELECT lot_id, 'text', 1 FROM lots WHERE status = 'PUBLISHED')
SELECT lot_id, arg_min(snapshot, p) AS snapshot FROM u GROUP BY lot_id""")
def lot_precedence(t):
    """The regional snapshot replaces the text search for the same lot."""
    u = (t("lots").where("type_code = 'ZK'").select("lot_id", F.lit("regional").alias("snapshot"), F.lit(0).alias("p"))
         .unionByName(t("lots").where("status = 'PUBLISHED'").select("lot_id", F.lit("text").alias("snapshot"), F.lit(1).alias("p"))))
    return u.groupBy("lot_id").agg(F.min_by("snapshot", "p").alias("snapshot"))


@query("j27_auction_duplicates", """
SELECT id FROM offers WHERE p_type = 'PROMO' AND k NOT IN (SELECT n.k FROM lot_numbers n JOIN lots l ON n.lot_id = l.lot_id WHERE l.type_code = 'ZK' AND l.status = 'PUBLISHED')""")
def auction_duplicates(t):
    """A layer auction is skipped when a lot already brought its number."""
    taken = lot_number_pairs(t).join(t("lots").where("type_code = 'ZK' AND status = 'PUBLISHED'").select("lot_id"), "lot_id", "left_semi").select("number").distinct()
    a = candidates(t).where("kind = 'auction'").withColumn("number", X.canonical(F.col("cad_num")))
    return a.join(taken, "number", "left_anti").select("id")


@query("j29_retained_observations", """
WITH last AS (SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS et, max(ts) AS at FROM events GROUP BY user_id), good AS (SELECT user_id AS key, arg_max(value, (ts, event_id)) AS v, max(ts) AS at FROM events WHERE event_type <> 'error' AND value > 0 GROUP BY user_id)
SELECT l.key, CASE WHEN l.et <> 'error' THEN 'received' WHEN g.key IS NOT NULL THEN 'retained' ELSE 'error' END AS state, strftime(g.at, '%Y-%m-%d %H:%M:%S') AS received_at FROM last l LEFT JOIN good g ON l.key = g.key""")
def retained(t):
    """A failed refresh keeps the last good, non-empty observation; its date is not renewed."""
    order = F.struct("ts", "event_id")
    good = F.when((F.col("event_type") != "error") & (F.col("value") > 0), order)
    g = t("events").groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", order).alias("last"), F.max(good).alias("good"))
    state = F.when(F.col("last") != "error", "received").when(F.col("good").isNotNull(), "retained").otherwise("error")
    return g.select("key", state.alias("state"), F.date_format("good.ts", "yyyy-MM-dd HH:mm:ss").alias("received_at"))


@query("j30_catalogue_diff", """
WITH p AS (SELECT doc_id, source FROM catalog WHERE doc_id % 10 <> 3), c AS (SELECT doc_id, source FROM catalog WHERE doc_id % 10 <> 4 AND source <> 'src2')
SELECT coalesce(p.doc_id, c.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'added' WHEN c.doc_id IS NOT NULL THEN 'listed' WHEN p.source = 'src2' THEN 'unknown' ELSE 'not_seen' END AS listing_state FROM p FULL JOIN c ON p.doc_id = c.doc_id""")
def catalogue_diff(t):
    """Missing from a listing that failed is unknown, not gone."""
    failed = ["src2"]
    p = t("catalog").where("doc_id % 10 <> 3").select("doc_id", F.col("source").alias("was"))
    c = t("catalog").where(~F.col("source").isin(*failed) & (F.col("doc_id") % 10 != 4)).select("doc_id", F.col("source").alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNotNull(), "listed").when(F.col("was").isin(*failed), "unknown").otherwise("not_seen")
    return p.join(c, "doc_id", "full").select("doc_id", state.alias("listing_state"))


@query("j31_w04_registry_merge", """
WITH o AS (SELECT k AS id, concat(id, 'g') AS hash, p_size AS fp, p_brand AS checks FROM parcels WHERE p_size <= 40), n AS (SELECT concat(id, 'g') AS hash, CASE WHEN p_size % 5 = 0 THEN -1 ELSE p_size END AS fp FROM parcels WHERE p_size >= 10),
m AS (SELECT max(id) AS top FROM o), j AS (SELECT coalesce(o.hash, n.hash) AS hash, o.id, n.hash IS NOT NULL AS active, o.fp AS ofp, n.fp AS nfp, o.checks FROM o FULL JOIN n ON o.hash = n.hash)
SELECT hash, CASE WHEN id IS NOT NULL THEN id ELSE (SELECT top FROM m) + row_number() OVER (PARTITION BY id IS NULL ORDER BY hash) END AS id, active, CASE WHEN active AND id IS NOT NULL AND ofp = nfp THEN checks WHEN NOT active THEN checks ELSE '' END AS checks,
  active AND id IS NOT NULL AND ofp <> nfp AS history_added FROM j""")
def registry_merge(t):
    """Same outline keeps its id and notes; changed sources clear the checks into history; missing ones go inactive; new ones are numbered on."""
    p = t("parcels").withColumn("hash", F.concat("id", F.lit("g")))
    old = p.where("p_size <= 40").select("hash", F.col("k").alias("old_id"), F.col("p_size").alias("old_fp"), F.col("p_brand").alias("old_checks"))
    new = p.where("p_size >= 10").select("hash", F.when(F.col("p_size") % 5 == 0, -1).otherwise(F.col("p_size")).alias("new_fp"))
    j = old.join(new, "hash", "full")
    top = old.agg(F.max("old_id")).first()[0] or 0
    fresh = global_rank(j.where("old_id IS NULL").select("hash"), [F.col("hash")], "n").select("hash", (F.col("n") + F.lit(top)).alias("fresh_id"))
    active, changed = F.col("new_fp").isNotNull(), F.coalesce(F.col("old_fp") != F.col("new_fp"), F.lit(False))
    return j.join(fresh, "hash", "left").select("hash", F.coalesce("old_id", "fresh_id").alias("id"), active.alias("active"),
                                                F.when(active & (changed | F.col("old_id").isNull()), "").otherwise(F.col("old_checks")).alias("checks"),
                                                (active & F.col("old_id").isNotNull() & changed).alias("history_added"))


@query("j32_deferred_numbers", """
WITH n AS (SELECT DISTINCT concat(CASE WHEN k % 3 = 0 THEN '91' ELSE '90' END, ':12:', CAST(k AS VARCHAR)) AS number FROM lot_numbers) SELECT number FROM n WHERE number NOT LIKE '90:%'""")
def deferred_numbers(t):
    """Numbers of districts no survey covers are put off, not dropped."""
    n = t("lot_numbers").select(F.concat(F.when(F.col("k") % 3 == 0, "91").otherwise("90"), F.lit(":12:"), F.col("k").cast("string")).alias("number")).distinct()
    seen = t("parcels").select(X.district(X.canonical(F.col("cad_num"))).alias("district")).distinct()
    return n.withColumn("district", X.district(F.col("number"))).join(seen, "district", "left_anti").select("number")


@query("j34_overlap_pairs", """
SELECT a.survey_id, a.id AS left_id, b.id AS right_id, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) AS area_m2 FROM zones a JOIN zones b
ON a.survey_id = b.survey_id AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def overlap_pairs(t):
    from groundsift.operators.tiles import box_overlap, tile_join

    z = t("zones").select("survey_id", "id", *BOX)
    j = tile_join(z, z).where(F.col("id") < F.col("r_id")).withColumn("a", box_overlap()).where("a > 1e-6")
    return j.select("survey_id", F.col("id").alias("left_id"), F.col("r_id").alias("right_id"), F.round("a", 6).alias("area_m2"))


@query("j35_component_tables", """
WITH RECURSIVE e AS (SELECT a.k AS a, b.k AS b FROM zones a JOIN zones b ON a.survey_id = b.survey_id AND a.k <> b.k AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
cc(k, label) USING KEY (k) AS (SELECT k, k FROM zones UNION SELECT e.b, min(f.label) FROM cc f JOIN e ON e.a = f.k JOIN recurring.cc r ON r.k = e.b WHERE f.label < r.label GROUP BY e.b)
SELECT z.survey_id, z.id, count(*) OVER (PARTITION BY z.survey_id, c.label) AS component_size FROM zones z JOIN cc c ON z.k = c.k""")
def component_tables(t):
    """Every table with the size of the connected body it belongs to."""
    from groundsift.operators.components import connected_components
    from groundsift.operators.tiles import tile_join

    z = t("zones").select("survey_id", "id", *BOX)
    e = tile_join(z, z).where(F.col("id") < F.col("r_id")).select(F.col("id").alias("a"), F.col("r_id").alias("b"))
    c = connected_components(z.select(F.col("id").alias("node")), e)
    size = c.groupBy("component").agg(F.count("*").alias("component_size"))
    return c.join(size, "component").join(z.select("survey_id", F.col("id").alias("node")), "node").select("survey_id", F.col("node").alias("id"), "component_size")


@query("j36_row_alignment", """
WITH a AS (SELECT conv_id, turn, turn * CAST(0.02 AS DOUBLE) + (length(text) % 9) * CAST(0.0001 AS DOUBLE) AS y FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn, (turn - 1) * CAST(0.02 AS DOUBLE) + (length(text) % 90) * CAST(0.0001 AS DOUBLE) AS y FROM conversations WHERE role = 'assistant')
SELECT a.conv_id, a.turn, count(b.turn) AS matches, CASE WHEN count(b.turn) > 1 THEN 'ambiguous' WHEN count(b.turn) = 1 THEN 'aligned' ELSE 'single' END AS state FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND abs(a.y - b.y) < CAST(0.006 AS DOUBLE) GROUP BY a.conv_id, a.turn""")
def row_alignment(t, band: float = 0.006):
    """Rows of two readings at nearly the same height; two partners are an error, not a choice."""
    c = t("conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", (F.col("turn") * 0.02 + (F.length("text") % 9) * 0.0001).alias("y"))
    b = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("other"), ((F.col("turn") - 1) * 0.02 + (F.length("text") % 90) * 0.0001).alias("y2"))
    # band join: heights fall in buckets as wide as the band, the left side looks at three
    bucket = lambda y: F.floor(y / F.lit(band))
    left = a.withColumn("bk", F.explode(F.sequence(bucket(F.col("y")) - 1, bucket(F.col("y")) + 1)))
    right = b.withColumn("bk", bucket(F.col("y2")))
    m = left.join(right, ["conv_id", "bk"]).where(F.abs(F.col("y") - F.col("y2")) < band).groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    out = a.join(m, ["conv_id", "turn"], "left").withColumn("matches", F.coalesce("n", F.lit(0)))
    return out.select("conv_id", "turn", "matches", F.when(F.col("matches") > 1, "ambiguous").when(F.col("matches") == 1, "aligned").otherwise("single").alias("state"))


@query("j37_index_reuse", """
WITH i AS (SELECT sha256(text) AS s, max(length(text)) AS pages FROM catalog WHERE source < 'src2' GROUP BY 1) SELECT c.doc_id, i.s IS NOT NULL AS reused FROM catalog c LEFT JOIN i ON sha256(c.text) = i.s AND length(c.text) = i.pages""")
def index_reuse(t):
    """A document keeps its index when digest and page count still agree."""
    c = t("catalog").select("doc_id", "source", F.sha2("text", 256).alias("s"), F.length("text").alias("pages"))
    i = c.where("source < 'src2'").select("s", "pages").distinct().withColumn("hit", F.lit(True))
    return c.join(i, ["s", "pages"], "left").select("doc_id", F.col("hit").isNotNull().alias("reused"))


@query("j38_history_documents", "SELECT p.page_id, c.doc_id IS NOT NULL AS document_read, substring(c.title, 1, 10) AS title FROM pages p LEFT JOIN catalog c ON c.doc_id = p.page_id AND c.state = 'read'")
def history_documents(t):
    """Plan history rows enriched with the document read under the same url, when there is one."""
    hist = t("pages").select("page_id").join(t("catalog").select(F.col("doc_id").alias("page_id"), "url"), "page_id", "left")
    read = t("catalog").where("state = 'read'").select("url", F.col("title").alias("full"), F.lit(True).alias("hit"))
    return hist.join(read, "url", "left").select("page_id", F.col("hit").isNotNull().alias("document_read"), F.substring("full", 1, 10).alias("title"))


@query("j39_unique_reference", """
SELECT n.lot_id, n.number, count(o.id) AS features, count(o.id) = 1 AS accepted FROM (SELECT DISTINCT lot_id, k, concat('90:12:', CAST(CAST(floor(k / 200.0) AS BIGINT) AS VARCHAR), ':', CAST(k AS VARCHAR)) AS number FROM lot_numbers) n
LEFT JOIN offers o ON o.k = n.k AND o.p_type = 'ECONOMY' GROUP BY n.lot_id, n.number""")
def unique_reference(t):
    """Exactly one feature of the asked category may carry the number."""
    ref = candidates(t).where("kind = 'offer'").select(X.canonical(F.col("cad_num")).alias("number"), "id").groupBy("number").agg(F.count("*").alias("f"))
    n = lot_number_pairs(t).join(ref, "number", "left").withColumn("features", F.coalesce("f", F.lit(0)))
    return n.select("lot_id", "number", "features", (F.col("features") == 1).alias("accepted"))


@query("j41_link_tree", """
WITH l AS (SELECT doc_id, CASE WHEN doc_id < 20 THEN -1 WHEN doc_id % 4 = 0 THEN doc_id % 20 ELSE CAST(floor(doc_id / 4.0) AS BIGINT) * 4 END AS parent FROM documents),
y AS (SELECT doc_id FROM l WHERE parent = -1), s AS (SELECT l.doc_id, l.parent AS yr FROM l JOIN y ON l.parent = y.doc_id), p AS (SELECT l.doc_id, s.doc_id AS ses, s.yr FROM l JOIN s ON l.parent = s.doc_id)
SELECT doc_id, count(DISTINCT ses) AS sessions, min(yr) AS year_page FROM p GROUP BY doc_id""")
def link_tree(t):
    """Root to year pages to sessions to documents, a fixed number of self joins; references accumulate."""
    k = F.col("doc_id")
    l = t("documents").select("doc_id", F.when(k < 20, -1).when(k % 4 == 0, k % 20).otherwise(F.floor(k / 4) * 4).alias("parent"))
    years = l.where("parent = -1").select(F.col("doc_id").alias("year_page"))
    ses = l.join(years, F.col("parent") == F.col("year_page")).select(F.col("doc_id").alias("session"), "year_page")
    docs = l.join(ses, F.col("parent") == F.col("session"))
    return docs.groupBy("doc_id").agg(F.count_distinct("session").alias("sessions"), F.min("year_page").alias("year_page"))


@query("j42_prune_and_retain", """
WITH cur AS (SELECT DISTINCT file_id FROM attachments a JOIN lots l ON a.lot_id = l.lot_id WHERE l.status = 'PUBLISHED') SELECT DISTINCT a.file_id, cur.file_id IS NULL AS retained FROM attachments a LEFT JOIN cur ON a.file_id = cur.file_id""")
def prune_and_retain(t):
    """Cards of known lots stay; files nothing refers to any more move to the retained table."""
    open_ = t("lots").where("status = 'PUBLISHED'").select("lot_id")
    cur = t("attachments").join(open_, "lot_id", "left_semi").select("file_id").distinct()
    every = t("attachments").select("file_id").distinct()
    return (every.join(cur, "file_id", "left_semi").select("file_id", F.lit(False).alias("retained"))
            .unionByName(every.join(cur, "file_id", "left_anti").select("file_id", F.lit(True).alias("retained"))))


@query("j43_child_attachments", """
SELECT c.doc_id + 1000000 AS child_id, CASE c.doc_id % 6 WHEN 0 THEN 'regulation' WHEN 1 THEN 'notice_or_auction' WHEN 2 THEN 'restriction' WHEN 5 THEN 'land_document' ELSE 'planning' END AS kind FROM catalog c WHERE c.state = 'read' AND c.doc_id % 3 > 0""")
def child_attachments(t):
    """Attachments found on a read page and not known yet inherit the page's kind."""
    read = t("catalog").where("state = 'read'").select("doc_id", X.document_kind(F.col("title")).alias("kind"), F.concat("url", F.lit("/a")).alias("child_url"))
    known = t("catalog").where("doc_id % 3 = 0").select(F.concat("url", F.lit("/a")).alias("child_url"))
    return read.join(known, "child_url", "left_anti").select((F.col("doc_id") + 1000000).alias("child_id"), "kind")


@query("j44_carried_images", """
SELECT p.doc_id, p.page, o.s IS NOT NULL AS carried FROM doc_pages p JOIN catalog c ON p.doc_id = c.doc_id LEFT JOIN (SELECT DISTINCT sha256(text) AS s, 2 AS page FROM catalog WHERE lang = 'en') o ON sha256(c.text) = o.s AND p.page = o.page""")
def carried_images(t):
    """Earlier page images serve again for the same digest and page."""
    d = t("catalog").select("doc_id", "lang", F.sha2("text", 256).alias("s"))
    earlier = d.where("lang = 'en'").select("s", F.lit(2).cast("bigint").alias("page"), F.lit(True).alias("hit")).distinct()
    return t("doc_pages").select("doc_id", "page").join(d, "doc_id").join(earlier, ["s", "page"], "left").select("doc_id", "page", F.col("hit").isNotNull().alias("carried"))


@query("j45_current_schemes", "SELECT doc_id FROM catalog WHERE doc_id % 5 <> 1")
def current_schemes(t):
    """Scheme documents whose digest the catalogue still holds."""
    saved = t("catalog").select("doc_id", F.when(F.col("doc_id") % 5 == 1, F.lit("old")).otherwise(F.sha2("text", 256)).alias("s"))
    return saved.join(t("catalog").select("doc_id", F.sha2("text", 256).alias("s")), ["doc_id", "s"], "left_semi").select("doc_id")
