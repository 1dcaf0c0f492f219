"""W-series: work queues in order, version chains, page search.

A queue holds all its work; ``position`` says what comes first and a caller
takes as many as it likes.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundsift.functions import text as X
from groundsift.operators.ranking import global_rank, grouped_rank, running_total, with_neighbours
from groundsift.plans.evidence import card_files, size_limit
from groundsift.plans.feeds import descriptors
from groundsift.plans.scalars import file_priority
from groundsift.registry import query


@query("w02_knn_rank", """
WITH d AS (SELECT a.survey_id, a.id, b.id AS building_id, row_number() OVER (PARTITION BY a.survey_id, a.id ORDER BY sqrt(power(greatest(0, b.x0 - a.x1, a.x0 - b.x1), 2) + power(greatest(0, b.y0 - a.y1, a.y0 - b.y1), 2)), b.id) AS rank
FROM offers a JOIN buildings b ON a.survey_id = b.survey_id) SELECT survey_id, id, building_id, rank FROM d WHERE rank <= 3""")
def knn_rank(t):
    from groundsift.operators.knn import knn_join
    from groundsift.plans.joins import candidates

    return knn_join(candidates(t), t("buildings"), 3).select("survey_id", "id", F.col("r_id").alias("building_id"), "rank")


@query("w05_file_queue", """
WITH d AS (SELECT file_id, file_name, declared_size, lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) AS format, bool_or(NOT inactive) AS act, bool_or(scope = 'lot') AS lot, min(type_code) AS type_code FROM attachments GROUP BY ALL),
v AS (SELECT file_id, count(DISTINCT (file_name, declared_size)) AS n FROM attachments GROUP BY file_id),
q AS (SELECT d.file_id, d.file_name, CASE WHEN d.type_code = 'Notice_Document' OR file_name LIKE 'Схема%' THEN 0 WHEN d.type_code = 'Basis_for_sale' OR lot THEN 1 WHEN file_name LIKE 'Договор%' OR d.type_code = 'Draft_Contract' THEN 3 ELSE 2 END AS priority
 FROM d JOIN v ON d.file_id = v.file_id WHERE n = 1 AND act AND format IN ('pdf', 'docx', 'doc', 'rtf', 'jpg', 'jpeg', 'png') AND declared_size <= CASE WHEN format = 'pdf' THEN 16777216 ELSE 8388608 END)
SELECT file_id, file_name, priority, row_number() OVER (ORDER BY priority, file_id, file_name) AS position FROM q""")
def file_queue(t):
    """Files to read: notices and schemes first, contract forms last."""
    meta = (descriptors(t).groupBy("key").agg(F.min("type_code").alias("type_code"), F.bool_or(F.col("scope") == "lot").alias("_lot"))
            .withColumn("scope", F.when(F.col("_lot"), "lot").otherwise("notice")))
    q = card_files(t).where("eligible AND state = 'pending'").join(meta, "key").select("file_id", "file_name", file_priority().alias("priority"))
    return global_rank(q, [F.col("priority"), F.col("file_id"), F.col("file_name")])


@query("w06_card_queue", """
WITH n AS (SELECT lot_id, bool_or(CAST(floor(k / 200.0) AS BIGINT) % 3 = 0) AS near FROM lot_numbers GROUP BY lot_id)
SELECT l.lot_id, row_number() OVER (ORDER BY NOT coalesce(n.near, false), l.lot_id) AS position FROM lots l LEFT JOIN n ON l.lot_id = n.lot_id WHERE l.type_code = 'ZK'""")
def card_queue(t):
    """Cards to fetch: lots of the surveyed districts first."""
    seen = t("surveys").where("survey_id % 3 = 0").select("survey_id")
    near = t("lot_numbers").select("lot_id", F.floor(F.col("k") / 200).alias("survey_id")).join(seen, "survey_id", "left_semi").select("lot_id").distinct().withColumn("near", F.lit(True))
    q = t("lots").where("type_code = 'ZK'").select("lot_id").join(near, "lot_id", "left").select("lot_id", F.coalesce("near", F.lit(False)).alias("near"))
    return global_rank(q, [F.desc("near"), F.col("lot_id")]).select("lot_id", "position")


_PRIO = "CASE doc_id % 6 WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 4 END"


@query("w07_read_queue", f"SELECT doc_id, row_number() OVER (ORDER BY {_PRIO}, doc_id) AS position FROM catalog WHERE state = 'pending'")
def read_queue(t):
    q = t("catalog").where("state = 'pending'").select("doc_id", X.kind_rank(X.document_kind(F.col("title"))).alias("p"))
    return global_rank(q, [F.col("p"), F.col("doc_id")]).select("doc_id", "position")


@query("w08_recognition_queue", f"""
SELECT p.doc_id, p.page, row_number() OVER (ORDER BY {_PRIO.replace('doc_id', 'p.doc_id')}, p.doc_id, p.page) AS position FROM doc_pages p WHERE length(regexp_replace(text, '\\s', '', 'g')) < 20 AND NOT (p.doc_id % 3 = 0)""")
def recognition_queue(t):
    """Sparse pages nobody has read with the current algorithm."""
    observed = t("documents").where("doc_id % 3 = 0").select("doc_id", F.lit(3).cast("bigint").alias("page")).unionByName(t("documents").where("doc_id % 3 = 0").select("doc_id", F.lit(1).cast("bigint").alias("page")))
    kind = t("catalog").select("doc_id", X.kind_rank(X.document_kind(F.col("title"))).alias("p"))
    q = t("doc_pages").where(X.sparse(F.col("text"))).select("doc_id", "page").join(observed, ["doc_id", "page"], "left_anti").join(kind, "doc_id")
    return global_rank(q, [F.col("p"), F.col("doc_id"), F.col("page")]).select("doc_id", "page", "position")


@query("w09_scheme_queue", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id % 6 NOT IN (3, 4), lang = 'es' OR lang = 'de', doc_id) AS position FROM catalog WHERE state = 'read' AND (doc_id % 4 = 0 OR doc_id % 7 = 0)""")
def scheme_queue(t):
    """Documents with a new digest or an outdated algorithm; planning and coordinate pages first."""
    k = F.col("doc_id")
    prior = t("catalog").where(k % 4 != 0).select("doc_id", F.when(k % 7 == 0, "v3").otherwise("v4").alias("algorithm"))
    q = t("catalog").where("state = 'read'").join(prior, "doc_id", "left").where(F.col("algorithm").isNull() | (F.col("algorithm") != "v4"))
    q = q.select("doc_id", (X.document_kind(F.col("title")) != "planning").alias("a"), F.col("lang").isin("es", "de").alias("b"))
    return global_rank(q, [F.col("a"), F.col("b"), F.col("doc_id")]).select("doc_id", "position")


@query("w10_render_queue", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id % 3 <> 0, lang <> 'fr', printf('%04d-%02d-%02d', 2015 + doc_id % 10, 1 + doc_id % 12, 1 + doc_id % 28) DESC, doc_id) AS position FROM documents""")
def render_queue(t):
    """Map pages: matches in the area, then any match, then the newest act."""
    act = F.concat_ws("-", (F.lit(2015) + F.col("doc_id") % 10).cast("string"), F.lpad((F.lit(1) + F.col("doc_id") % 12).cast("string"), 2, "0"), F.lpad((F.lit(1) + F.col("doc_id") % 28).cast("string"), 2, "0"))
    q = t("documents").select("doc_id", (F.col("doc_id") % 3 == 0).alias("area"), (F.col("lang") == "fr").alias("match"), act.alias("act"))
    return global_rank(q, [F.desc("area"), F.desc("match"), F.desc("act"), F.col("doc_id")]).select("doc_id", "position")


@query("w11_reprocess_queue", """
SELECT doc_id, url FROM catalog WHERE state = 'read' AND doc_id % 5 IN (0, 3) AND doc_id % 2 = 0""")
def reprocess_queue(t):
    """Read PDFs whose recorded algorithm is not the current one."""
    algorithm = F.when(F.col("doc_id") % 2 == 0, "text-v2").otherwise("text-v3")
    return t("catalog").where((F.col("state") == "read") & (X.extension(X.url_part(F.col("url"), "PATH")) == "pdf") & (algorithm != "text-v3")).select("doc_id", "url")


@query("w12_continuation_queue", """
SELECT file_id, file_name, row_number() OVER (ORDER BY declared_size, file_id, file_name) AS position FROM (SELECT DISTINCT file_id, file_name, declared_size FROM attachments WHERE file_name LIKE '%.pdf' AND declared_size > 8388608 AND declared_size <= 16777216)""")
def continuation_queue(t):
    """Files too long for the short reading but within the extended one, smallest first."""
    q = descriptors(t).where("format = 'pdf' AND declared_size > 8388608").where(F.col("declared_size") <= size_limit(F.col("format"))).select("file_id", "file_name", "declared_size").distinct()
    return global_rank(q, [F.col("declared_size"), F.col("file_id"), F.col("file_name")]).select("file_id", "file_name", "position")


@query("w13_archive_queue", """
WITH a AS (SELECT DISTINCT file_id, file_name FROM attachments WHERE file_name LIKE '%.zip' AND NOT inactive), o AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'done' WHEN p_size % 3 = 1 THEN 'error' END AS st FROM part)
SELECT file_id, file_name, row_number() OVER (ORDER BY coalesce(st, '') <> 'error', file_id, file_name) AS position FROM a LEFT JOIN o ON a.file_id = o.p_partkey WHERE coalesce(st, '') <> 'done'""")
def archive_queue(t):
    """Archives without an accepted record; errors come first on a retry."""
    s = F.col("p_size") % 3
    seen = t("part").select(F.col("p_partkey").alias("file_id"), F.when(s == 0, "done").when(s == 1, "error").alias("st"))
    q = descriptors(t).where("format = 'zip' AND NOT inactive").select("file_id", "file_name").distinct().join(seen, "file_id", "left").where("coalesce(st, '') <> 'done'")
    return global_rank(q.withColumn("e", F.coalesce("st", F.lit("")) != "error"), [F.col("e"), F.col("file_id"), F.col("file_name")]).select("file_id", "file_name", "position")


@query("w14_version_chain", """
WITH v AS (SELECT user_id AS key, event_id AS version, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events)
SELECT key, version, parent, age FROM v WHERE age <= 10""")
def version_chain(t):
    """The ten newest versions of a key, each with the one before it."""
    e = with_neighbours(t("events").select("user_id", "ts", "event_id"), ["user_id"], [F.col("ts"), F.col("event_id")], ["event_id"])
    # row_number under a small limit is cut per task before the shuffle
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    top = e.withColumn("age", F.row_number().over(w)).where("age <= 10")
    return top.select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.col("prev_event_id").alias("parent"), F.col("age").cast("bigint").alias("age"))


@query("w15_contiguous_windows", """
WITH w AS (SELECT conv_id, turn, turn + CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 1 ELSE 0 END AS start FROM conversations), l AS (SELECT conv_id, start, lag(start + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM w)
SELECT conv_id, bool_and(start = coalesce(expected, 0)) AS contiguous FROM l GROUP BY conv_id""")
def contiguous_windows(t):
    """Each window starts where the one before it ended."""
    start = F.col("turn") + F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), 1).otherwise(0)
    w = with_neighbours(t("conversations").select("conv_id", "turn", start.alias("start")), ["conv_id"], [F.col("turn")], ["start"])
    return w.groupBy("conv_id").agg(F.bool_and(F.col("start") == F.coalesce(F.col("prev_start") + 1, F.lit(0))).alias("contiguous"))


@query("w16_next_window", "SELECT conv_id, 1 + count(*) AS next_start FROM conversations GROUP BY conv_id")
def next_window(t):
    return t("conversations").groupBy("conv_id").agg((F.count("*") + 1).alias("next_start"))


@query("w17_page_search", """
WITH m AS (SELECT survey_id, doc_id, page FROM doc_pages WHERE page = 2 AND doc_id % 4 = 0 AND doc_id % 5 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY doc_id, page) AS n, count(*) OVER (PARTITION BY survey_id) AS total FROM m)
SELECT survey_id, doc_id, page, total AS total_matches, CASE WHEN total > 10 + 5 THEN 15 END AS next_offset FROM r WHERE n > 5 AND n <= 5 + 10""")
def page_search(t, zone: str = "Ж1", query_text: str = "участок", offset: int = 5, size: int = 10):
    """One page of text hits with the total and where the next page starts; a sub-zone is not its parent."""
    # the plain text test first: it is the cheaper one and spares most pages the zone pattern
    m = t("doc_pages").where(X.folded(F.col("text")).contains(" ".join(query_text.split()).lower())).where(F.array_contains(X.zone_codes(F.col("text")), zone)).select("survey_id", "doc_id", "page")
    total = m.groupBy("survey_id").agg(F.count("*").alias("total_matches"))
    r = grouped_rank(m, ["survey_id"], [F.col("doc_id"), F.col("page")]).where((F.col("position") > offset) & (F.col("position") <= offset + size))
    return r.join(total, "survey_id").select("survey_id", "doc_id", "page", "total_matches", F.when(F.col("total_matches") > offset + size, F.lit(offset + size)).alias("next_offset"))


@query("w18_bounded_evidence", """
WITH r AS (SELECT l_suppkey AS k, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)
SELECT k, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY n) AS shown, max(total) - count(*) AS omitted FROM r WHERE n <= 20 GROUP BY k""")
def bounded_evidence(t, shown: int = 20):
    """The first twenty pieces of evidence as a report shows them, and how many it leaves out."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey"]
    w = Window.partitionBy("l_suppkey").orderBy(*cols)  # a small limit is applied per task before the shuffle
    top = t("lineitem").select("l_suppkey", *cols).withColumn("n", F.row_number().over(w)).where(F.col("n") <= shown)
    s = top.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("n", "l_orderkey"))).alias("s"))
    n = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("total"))
    return s.join(n, "l_suppkey").select(F.col("l_suppkey").alias("k"), F.array_join(F.transform("s", lambda x: x["l_orderkey"].cast("string")), ",").alias("shown"), (F.col("total") - F.size("s")).alias("omitted"))


@query("w20_act_order", "SELECT doc_id, row_number() OVER (ORDER BY printf('%04d-%02d-%02d', 2015 + doc_id % 10, 1 + doc_id % 12, 1 + doc_id % 28), doc_id) AS position FROM documents")
def act_order(t):
    from groundsift.plans.joins import acts

    return global_rank(acts(t).select("doc_id", "date"), [F.col("date"), F.col("doc_id")]).select("doc_id", "position")


@query("w21_watch_list", """
WITH w AS (SELECT user_id AS id, arg_max(event_id, (ts, event_id)) AS result_id, count(*) - 1 AS history, arg_max(event_type, (ts, event_id)) AS et FROM events GROUP BY user_id) SELECT id, result_id, history, et IN ('error', 'signup') AS stale FROM w""")
def watch_list(t):
    """Latest watched version per candidate, its history kept; stale when its inputs are no longer current."""
    g = t("events").groupBy(F.col("user_id").alias("id")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"), F.count("*").alias("n"))
    current = t.spark.createDataFrame([("view",), ("click",), ("purchase",)], "event_type string")
    j = g.select("id", F.col("m.event_id").alias("result_id"), (F.col("n") - 1).alias("history"), F.col("m.event_type").alias("event_type"))
    return j.join(F.broadcast(current.withColumn("ok", F.lit(True))), "event_type", "left").select("id", "result_id", "history", F.col("ok").isNull().alias("stale"))


@query("r08_page_of_offset", """
WITH s AS (SELECT doc_id, page, length(text) + 1 AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM doc_pages), m AS (SELECT doc_id, max(start + n) AS total FROM s GROUP BY doc_id)
SELECT m.doc_id, s.page FROM m JOIN s ON m.doc_id = s.doc_id AND floor(m.total * 3 / 4) >= s.start AND floor(m.total * 3 / 4) < s.start + s.n""")
def page_of_offset(t):
    """Page that holds a text offset: running lengths, then the last start not after it."""
    s = running_total(t("doc_pages").select("doc_id", "page", (F.length("text") + 1).alias("n")), ["doc_id"], [F.col("page")], "n", "start")
    total = t("doc_pages").groupBy("doc_id").agg(F.floor(F.sum(F.length("text") + 1) * 3 / 4).alias("offset"))
    return s.join(total, "doc_id").where((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("start") + F.col("n"))).select("doc_id", "page")
