"""F-series: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsift.functions import text as X
from groundsift.operators.jsontree import has_key
from groundsift.registry import query


@query("f01_canonical_numbers", """
SELECT k, concat('90:12:', CAST(survey_id AS VARCHAR), ':', CAST(k AS VARCHAR)) AS number FROM parcels""")
def canonical_numbers(t):
    return t("parcels").select("k", X.canonical(F.col("cad_num")).alias("number"))


@query("f02_number_extraction", """
SELECT doc_id, CASE WHEN page = 2 THEN concat('90:12:', CAST(survey_id AS VARCHAR), ':', CAST(doc_id * 2 AS VARCHAR), ',90:12:', CAST(survey_id AS VARCHAR), ':', CAST(doc_id * 2 + 1 AS VARCHAR))
  WHEN text LIKE 'СК-63%' THEN concat('90:12:', CAST(survey_id AS VARCHAR), ':', CAST(doc_id * 2 AS VARCHAR)) ELSE '' END AS numbers, page FROM doc_pages WHERE page > 1""")
def number_extraction(t):
    """Digit and colon neighbours rule a match out; a decoy of five tokens is added to every text."""
    text = F.concat("text", F.lit(" 1:90:12:1:5 90:12:3:4:5 190:12:3:4"))
    return t("doc_pages").where("page > 1").select("doc_id", "page", F.array_join(X.numbers(text), ",").alias("numbers"))


@query("f03_spaced_numbers", """
SELECT k, concat('90:12:', CAST(survey_id AS VARCHAR), ':', CAST(k AS VARCHAR)) AS numbers FROM parcels""")
def spaced_numbers(t):
    return t("parcels").select("k", F.array_join(X.spaced_numbers(F.concat(F.lit("уч. "), F.replace(F.col("cad_num"), F.lit(":"), F.lit(" : ")), F.lit("; O:12:1:1"))), ",").alias("numbers"))


_DATE = "printf('%04d-%02d-%02d', 2015 + doc_id % 10, 1 + doc_id % 12, 1 + doc_id % 28)"


@query("f04_act_identity", f"SELECT doc_id, {_DATE} AS date, concat(CAST(doc_id % 97 AS VARCHAR), '-п') AS number FROM documents")
def act_identities(t):
    months = F.array(*[F.lit(m) for m in X.MONTHS])
    text = F.concat(F.lit("решение от "), (F.lit(1) + F.col("doc_id") % 28).cast("string"), F.lit("  "), F.get(months, (F.col("doc_id") % 12).cast("int")),
                    F.lit(" "), (F.lit(2015) + F.col("doc_id") % 10).cast("string"), F.lit(" года № "), (F.col("doc_id") % 97).cast("string"), F.lit(" – п"))
    return t("documents").select("doc_id", X.act_identity(text).alias("a")).select("doc_id", "a.date", "a.number")


# Words that open an operative paragraph and what they do.
ACTIONS = (("Отменить", "cancel_reference"), ("Утвердить", "approve_text"), ("Внести", "amend_reference"))
# What opens and what ends the operative part, where acts are read for their evidence.
EVIDENCE_OPENS, EVIDENCE_ENDS = ("ПОСТАНОВЛЯЕТ", "решил[аи]?"), ("Приложение", "Председатель", "Временно исполняющий", "Глава администрации")
# The same where orders of the administration are read for cancellations.
ORDER_OPENS, ORDER_ENDS = ("ПОСТАНОВЛЯЮ",), ("Глава администрации", "Приложение", "УТВЕРЖДЕН")


def operative_paragraphs(full, opens, ends):
    """Numbered paragraphs of the operative part, line ends kept; NULL without an opening word.

    Lines are numbered by how many paragraph numbers came before; a paragraph
    is the lines of one number.
    """
    part = F.get(F.split(full, rf"(?iu)(?:{'|'.join(opens)})\s*:", 2), F.lit(1))
    lines = F.split(part, r"\n")
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(rf"(?iu)^\s*(?:{'|'.join(ends)})(?![\p{{L}}])")), F.lit(True)).cast("int")
    kept = F.when(stop > 0, F.slice(lines, F.lit(1), stop - 1)).otherwise(lines)
    numbered = F.aggregate(kept, F.array().cast("array<string>"), lambda out, x: (
        F.when(x.rlike(r"^\s*\d{1,2}\.(?!\d)"), F.concat(out, F.array(F.regexp_replace(x, r"^\s*\d{1,2}\.\s*", ""))))
        .when(F.size(out) > 0, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), F.lit("\n"), x))))
        .otherwise(out)))
    return F.filter(numbered, lambda p: F.trim(p) != "")


def evidence_paragraphs(full):
    return F.coalesce(F.transform(operative_paragraphs(full, EVIDENCE_OPENS, EVIDENCE_ENDS), X.squash), F.array().cast("array<string>"))


def paragraph_action(p):
    out = None
    for word, action in ACTIONS:
        hit = p.rlike(rf"(?iu)^{word}(?![\p{{L}}])")
        out = F.when(hit, action) if out is None else out.when(hit, action)
    return out


def act_texts(t):
    """All pages; the heading page of each document goes on with an operative part made from the document key."""
    k = F.col("doc_id")
    verb = F.when(k % 3 == 0, "Отменить").when(k % 3 == 1, "Внести изменения в").otherwise("Утвердить")
    ref = F.concat(F.lit(" решение от "), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(".0"), (k % 9 + 1).cast("string"), F.lit(".2014 № "), (k % 50).cast("string"))
    tail = F.concat(F.lit("\nрешил:\n1. "), verb, ref, F.lit(".\n2. "), F.when(k % 7 == 0, "Отменить прежнее решение.").otherwise("Контроль оставить за собой."), F.lit("\nПредседатель"))
    return t("doc_pages").select("doc_id", "page", "text", F.when(F.col("page") == 2, F.concat("text", tail)).otherwise(F.col("text")).alias("full"))


@query("f05_act_evidence", f"""
SELECT doc_id, CAST(2 AS BIGINT) AS page, 'act_text' AS document_role, {_DATE} AS date,
  CASE WHEN doc_id % 7 = 0 AND doc_id % 3 <> 0 THEN 'multiple_text_actions' WHEN doc_id % 3 = 0 THEN 'cancel_reference' WHEN doc_id % 3 = 1 THEN 'amend_reference' ELSE 'approve_text' END AS action,
  CASE WHEN doc_id % 3 < 2 THEN concat(printf('2014-%02d-%02d', doc_id % 9 + 1, doc_id % 28 + 1), '/', CAST(doc_id % 50 AS VARCHAR)) ELSE '' END AS refs
FROM documents UNION ALL SELECT doc_id, page, 'planning_document', NULL, 'unknown', '' FROM doc_pages WHERE page <> 2""")
def act_evidence(t):
    """Role, own identity, action and cited acts, from operative paragraphs only."""
    a = act_texts(t).withColumn("p", evidence_paragraphs(F.col("full")))
    acts = F.filter(F.transform("p", paragraph_action), lambda x: x.isNotNull())
    refs = F.filter(F.transform(F.filter("p", lambda p: paragraph_action(p).isin("cancel_reference", "amend_reference")), X.act_identity), lambda x: x.isNotNull())
    a = a.select("doc_id", "page", X.own_act(F.col("text")).alias("own"), acts.alias("acts"), F.transform(refs, lambda r: F.concat_ws("/", r["date"], r["number"])).alias("refs"))
    distinct = F.size(F.array_distinct("acts"))
    return a.select("doc_id", "page", F.when(F.col("own").isNotNull(), "act_text").otherwise("planning_document").alias("document_role"), F.col("own.date").alias("date"),
                    F.when(distinct == 1, F.get("acts", F.lit(0))).when(distinct > 1, "multiple_text_actions").otherwise("unknown").alias("action"),
                    F.array_join("refs", ",").alias("refs"))


@query("f06_listing_conflicts", f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'act_identity' ELSE '' END || CASE WHEN doc_id % 4 = 0 AND doc_id % 5 = 0 THEN ',' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN 'draft_title_act_text' ELSE '' END AS conflicts, CAST(2 AS BIGINT) AS page FROM documents UNION ALL SELECT doc_id, '', page FROM doc_pages WHERE page <> 2""")
def listing_conflicts(t):
    """Title against document: other identity, or a draft title on the text of an act."""
    k = F.col("doc_id")
    number = F.when(k % 4 == 0, (k % 97 + 1).cast("string")).otherwise((k % 97).cast("string"))
    date = F.concat_ws(".", F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), (k % 10 + 2015).cast("string"))
    title = F.concat(F.lit("№ "), number, F.lit(" от "), date)
    draft = F.when(k % 5 == 0, "Проект решения").otherwise("Решение")
    listed = X.listing_act(title)
    own = X.own_act(F.col("text"))
    kinds = F.filter(F.array(F.when(listed.isNotNull() & own.isNotNull() & (listed != own), "act_identity"),
                             F.when(F.lower(draft).startswith("проект") & own.isNotNull(), "draft_title_act_text")), lambda c: c.isNotNull())
    return t("doc_pages").select("doc_id", F.array_join(kinds, ",").alias("conflicts"), "page")


@query("f07_cancellation_relations", """
SELECT doc_id, printf('2014-%02d-%02d', doc_id % 9 + 1, doc_id % 28 + 1) AS date, CAST(doc_id % 50 AS VARCHAR) AS number FROM documents WHERE lang <> 'en'""")
def cancellation_relations(t):
    """Acts declared void in numbered paragraphs; quoted titles name no further targets."""
    k = F.col("doc_id")
    ref = F.concat(F.lit(" от "), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(".0"), (k % 9 + 1).cast("string"), F.lit(".2014 № "), (k % 50).cast("string"))
    line = F.when(F.col("lang") != "en", F.concat(F.lit("Признать утратившим силу постановление"), ref, F.lit(" «О порядке от 01.01.2001 № 9»"))).otherwise("Разместить решение от 01.02.2013 № 4")
    full = F.concat(F.lit("ПОСТАНОВЛЯЮ:\n1. "), line, F.lit("\n2. Контроль.\nГлава администрации"))
    paras = F.filter(operative_paragraphs(full, ORDER_OPENS, ORDER_ENDS), lambda p: X.squash(p).rlike(r"(?iu)^Признать\s+утратившим\s*и?\s+силу(?![\p{L}])"))
    targets = F.array_distinct(F.filter(F.transform(paras, lambda p: X.act_identity(F.get(F.split(p, r"[«\"]", 2), F.lit(0)))), lambda x: x.isNotNull()))
    return t("documents").select("doc_id", F.explode(targets).alias("r")).select("doc_id", "r.date", "r.number")


@query("f08_number_literals", "SELECT o_orderkey, o_totalprice AS plain, o_totalprice AS spaced FROM orders WHERE o_totalprice >= 100000")
def number_literals(t):
    """Decimal comma and blank thousands read back to the number they print."""
    o = t("orders").where("o_totalprice >= 100000")
    d = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    whole = F.substring_index(d, ".", 1)
    spaced = F.concat(F.expr("substring(cast(cast(o_totalprice as decimal(12,2)) as string), 1, length(cast(cast(o_totalprice as decimal(12,2)) as string)) - 6)"), F.lit(" "),
                      F.substring(whole, -3, 3), F.lit(","), F.substring_index(d, ".", -1))
    return o.select("o_orderkey", X.literal_number(F.translate(d, ".", ",")).alias("plain"), X.literal_number(spaced).alias("spaced"))


@query("f09_zone_codes", """
SELECT doc_id, concat('Ж', CAST(1 + doc_id % 4 AS VARCHAR), CASE WHEN doc_id % 5 = 0 THEN '.1' ELSE '' END, ',СХ2') AS zones, CAST(2 AS BIGINT) AS page FROM documents UNION ALL SELECT doc_id, '', page FROM doc_pages WHERE page <> 2""")
def zone_codes(t):
    return t("doc_pages").select("doc_id", F.array_join(X.zone_codes(F.col("text")), ",").alias("zones"), "page")


@query("f10_counts_or_null", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal = floor(c_acctbal) THEN CAST(c_acctbal AS BIGINT) END AS counted FROM customer")
def counts_or_null(t):
    return t("customer").select("c_custkey", X.count_or_null(F.col("c_acctbal")).alias("counted"))


@query("f11_truncation", "SELECT doc_id, length(substring(coalesce(text, ''), 1, 500)) AS n, substring(text, 1, 30) AS head FROM documents")
def truncation(t):
    return t("documents").select("doc_id", F.length(X.clipped(F.col("text"), 500)).cast("bigint").alias("n"), X.clipped(F.col("text"), 30).alias("head"))


@query("f12_folded_search", "SELECT doc_id FROM documents WHERE contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'the of')")
def folded_search(t, text: str = "the   OF"):
    wanted = " ".join(text.split()).lower()
    return t("documents").where(X.folded(F.col("text")).contains(wanted)).select("doc_id")


@query("f13_content_digest", "SELECT doc_id, sha256(text) AS sha256, substring(sha256(concat('{\"doc\":', CAST(doc_id AS VARCHAR), ',\"lang\":\"', lang, '\"}')), 1, 20) AS version FROM documents")
def content_digest(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), X.digest(F.col("doc_id").alias("doc"), F.col("lang"), length=20).alias("version"))


@query("f14_aware_timestamps", "SELECT lot_id, deadline LIKE '%Z' AS aware FROM lots")
def aware_timestamps(t):
    return t("lots").select("lot_id", X.aware_timestamp(F.col("deadline")).isNotNull().alias("aware"))


@query("f15_rounded_metrics", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 1) AS mean FROM lineitem GROUP BY ALL")
def rounded_metrics(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_quantity"), 1).alias("mean"))


# Keys that no imported answer may hold.
FORBIDDEN_KEYS = ("authorization", "cookie", "cookies", "headers", "requestheaders", "responseheaders", "access_token", "refresh_token",
                  "accesstoken", "refreshtoken", "password", "token", "set-cookie")


@query("f16_forbidden_keys", "SELECT event_id, event_id % 7 <> 5 AS readable, event_id % 7 IN (0, 1, 3) AS forbidden FROM events")
def forbidden_keys(t):
    """Credential keys anywhere in a JSON tree: escaped ones, deep ones; not words in values, longer keys or broken texts."""
    k = F.col("event_id") % 7
    body = (F.when(k == 0, F.concat(F.lit('{"a":[{"b":'), "props", F.lit(',"Access_Token":"x"}]}'))).when(k == 1, F.concat(F.lit('{"a":{"\\u0074oken":'), "props", F.lit("}}")))
            .when(k == 2, F.concat(F.lit('{"a":"\\"token\\":1","note":"cookie","b":'), "props", F.lit("}")))
            .when(k == 3, F.concat(F.lit('{"a":[' * 10), F.lit('{"Set-Cookie":'), "props", F.lit("}"), F.lit("]}" * 10)))
            .when(k == 4, F.concat(F.lit('{"tokens":1,"my_password_hint":[2,{"cook":3}],"b":'), "props", F.lit("}")))
            .when(k == 5, F.concat(F.lit('{"token":'), "props")).otherwise(F.concat(F.lit("["), "props", F.lit(',"token"]'))))
    return has_key(t("events").select("event_id", body.alias("body")), "event_id", F.col("body"), FORBIDDEN_KEYS)


@query("f17_path_templates", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/api/{id}/items' ELSE '/api/v1/items' END AS path FROM pages""")
def path_templates(t):
    seg = F.when(F.col("page_id") % 3 == 0, F.substring(F.sha2("url", 256), 1, 32)).otherwise("v1")
    return t("pages").select("page_id", X.path_template(F.concat(F.lit("/api/"), seg, F.lit("/items"))).alias("path"))


# Workflow stages and their labels.
WORKFLOWS = {"review": "Проверка", "working": "В разработке", "ready": "ПОДАЧА", "submitted": "ОЖИДАНИЕ", "auction": "АУКЦИОН",
             "direct": "БЕЗ ТОРГОВ", "refused": "ОТКАЗ"}


@query("f18_workflow_labels", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'ПОДАЧА' WHEN '2-HIGH' THEN 'ОЖИДАНИЕ' WHEN '3-MEDIUM' THEN 'АУКЦИОН' ELSE 'Проверка' END AS stage FROM orders""")
def workflow_labels(t):
    labels = F.create_map(*[F.lit(x) for kv in WORKFLOWS.items() for x in kv])
    key = F.when(F.col("o_orderpriority") == "1-URGENT", "ready").when(F.col("o_orderpriority") == "2-HIGH", "submitted").when(F.col("o_orderpriority") == "3-MEDIUM", "auction").otherwise("review")
    return t("orders").select("o_orderkey", F.element_at(labels, key).alias("stage"))


def update_error(result, source, note, date, workflow, reference, blockers, today):
    """First rule a check update breaks, NULL when it may be stored."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    d = F.try_to_date(date, "yyyy-MM-dd")
    decided = result != "unknown"
    return (F.when(~result.isin("unknown", "pass", "fail"), "unknown result").when(decided & (blank(source) | blank(note)), "source and note required")
            .when(decided & d.isNull(), "bad date").when(decided & (d > today), "date in the future").when(~workflow.isin(*WORKFLOWS), "unknown stage")
            .when((workflow == "ready") & (blockers > 0), "package not ready").when(workflow.isin("submitted", "auction", "direct", "refused") & blank(reference), "reference required"))


@query("f19_update_gate", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' AND o_custkey % 7 = 0 THEN 'source and note required' WHEN o_orderstatus <> 'P' AND o_orderdate > TIMESTAMP '2000-06-15' THEN 'date in the future'
  WHEN o_orderpriority = '1-URGENT' AND o_custkey % 3 > 0 THEN 'package not ready' WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 2 = 0 THEN 'reference required' END AS error FROM orders""")
def update_gate(t):
    result = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "fail").otherwise("unknown")
    stage = F.when(F.col("o_orderpriority") == "1-URGENT", "ready").when(F.col("o_orderpriority") == "2-HIGH", "submitted").otherwise("review")
    return t("orders").select("o_orderkey", update_error(
        result, F.when(F.col("o_custkey") % 7 == 0, " ").otherwise("реестр"), F.lit("сверено"), F.substring(F.col("o_orderdate").cast("string"), 1, 10), stage,
        F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("№ 5"), F.col("o_custkey") % 3, F.lit("2000-06-15").cast("date")).alias("error"))


@query("f20_file_priority", """
SELECT lot_id, ord, file_id, CASE WHEN type_code = 'Notice_Document' OR file_name LIKE 'Схема%' THEN 0 WHEN type_code = 'Basis_for_sale' OR scope = 'lot' THEN 1 ELSE 3 END AS priority FROM attachments""")
def file_priorities(t):
    return t("attachments").select("lot_id", "ord", "file_id", file_priority().alias("priority"))


def file_priority():
    name = F.lower("file_name")
    return (F.when((F.col("type_code") == "Notice_Document") | name.rlike("схем|кадастр|межеван|егрн"), 0)
            .when((F.col("type_code") == "Basis_for_sale") | (F.col("scope") == "lot"), 1)
            .when(F.col("type_code").isin("Application_Form", "Draft_Contract") | name.rlike("квитанц|задат|договор|заявк"), 3).otherwise(2))


@query("f22_sheet_marks", "SELECT doc_id, CAST(1 + doc_id % 3 AS INTEGER) AS sheet, CAST(3 AS INTEGER) AS total FROM documents")
def sheet_marks(t):
    text = F.concat(F.lit("Лист №"), (F.lit(1) + F.col("doc_id") % 3).cast("string"), F.lit(" раздела 3.2\nВсего листов раздела 3.2: 3"))
    return t("documents").select("doc_id", X.sheet_mark(text).alias("m")).select("doc_id", "m.sheet", "m.total")
