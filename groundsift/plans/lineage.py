"""L-series: identities, staleness, recorded evidence, recalculation; and the incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundsift.functions import text as X
from groundsift.plans.joins import BOX
from groundsift.registry import query
from groundsift.session import scratch_folder
from groundsift.sources.sinks import content_id
from groundsift.streaming import lookups, observations

VERSION = 16


def input_identities(t):
    """Content address of every input layer of every window, long form."""
    out = None
    for name in ("parcels", "buildings", "zones", "restrictions"):
        c = content_id(t(name), ["survey_id"], ["id", *BOX]).select("survey_id", F.lit(name).alias("input"), "version", "rows")
        out = c if out is None else out.unionByName(c)
    return out


@query("l01_input_identities", """
SELECT survey_id, 'parcels' AS input, count(*) AS rows, 20 AS digits FROM parcels GROUP BY survey_id UNION ALL SELECT survey_id, 'buildings', count(*), 20 FROM buildings GROUP BY survey_id
UNION ALL SELECT survey_id, 'zones', count(*), 20 FROM zones GROUP BY survey_id UNION ALL SELECT survey_id, 'restrictions', count(*), 20 FROM restrictions GROUP BY survey_id""")
def identities(t):
    return input_identities(t).select("survey_id", "input", "rows", F.length("version").alias("digits"))


@query("l02_stale_results", """
SELECT survey_id, survey_id % 4 = 1 OR survey_id % 4 = 2 AS stale FROM surveys""")
def stale_results(t):
    """A result is stale when its calculation version or any input identity differs; a missing input counts."""
    now = input_identities(t).select("survey_id", "input", "version")
    k = F.col("survey_id") % 4
    saved = now.select("survey_id", "input", F.when((k == 1) & (F.col("input") == "zones"), "old").otherwise(F.col("version")).alias("saved"),
                       F.when(k == 2, VERSION - 1).otherwise(VERSION).alias("calculation"))
    j = saved.join(now, ["survey_id", "input"], "full")
    return j.groupBy("survey_id").agg((F.bool_or(~F.col("saved").eqNullSafe(F.col("version"))) | F.bool_or(F.coalesce(F.col("calculation"), F.lit(0)) != VERSION)).alias("stale"))


@query("l03_survey_signature", "SELECT survey_id, survey_id % 3 <> 1 AS same_after_reorder, survey_id % 2 = 0 AS same_after_move FROM surveys")
def survey_signature(t):
    """Only what geometry depends on enters the signature: order and labels do not; a repeated object, in every third window, and a moved one, in every other, do."""
    p = t("parcels")
    a = content_id(p, ["survey_id"], ["id", *BOX]).select("survey_id", F.col("version").alias("a"))
    again = p.where("survey_id % 3 = 1 AND k % 200 = 0")
    b = content_id(p.unionByName(again).orderBy(F.desc("k")).withColumn("p_name", F.lit("renamed")), ["survey_id"], ["id", *BOX]).select("survey_id", F.col("version").alias("b"))
    c = content_id(p.withColumn("x1", F.col("x1") + F.when((F.col("k") % 200 == 0) & (F.col("survey_id") % 2 == 1), 1).otherwise(0)), ["survey_id"], ["id", *BOX]).select("survey_id", F.col("version").alias("c"))
    return a.join(b, "survey_id").join(c, "survey_id").select("survey_id", (F.col("a") == F.col("b")).alias("same_after_reorder"), (F.col("a") == F.col("c")).alias("same_after_move"))


@query("l04_search_identity", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_custkey END AS source_id, o_orderkey % 3 > 0 OR o_orderkey = o_custkey AS same_search FROM orders")
def search_identity(t):
    """Geometry-only revisions keep the identity of the search they came from."""
    source = F.coalesce(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")), F.col("o_orderkey"))
    return t("orders").select("o_orderkey", source.alias("source_id"), source.eqNullSafe(F.col("o_custkey")).alias("same_search"))


@query("l05_current_drafts", """
SELECT doc_id, page, CASE WHEN doc_id % 4 = 0 THEN 'stale' ELSE 'current' END AS review FROM doc_pages WHERE page = 1""")
def current_drafts(t):
    """A review holds only for the draft it was made on."""
    fp = lambda text: F.sha2(F.to_json(F.struct("doc_id", "page", text.alias("t"))), 256)
    p = t("doc_pages").where("page = 1")
    reviews = p.select("doc_id", "page", fp(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))).alias("reviewed"))
    return p.select("doc_id", "page", fp(F.col("text")).alias("draft")).join(reviews, ["doc_id", "page"]).select("doc_id", "page", F.when(F.col("draft") == F.col("reviewed"), "current").otherwise("stale").alias("review"))


@query("l06_fingerprint_gate", "SELECT survey_id, survey_id % 2 = 0 AS may_publish FROM surveys")
def fingerprint_gate(t):
    """Results are published only if the layers are still the ones they were computed from."""
    now = content_id(t("parcels"), ["survey_id"], ["id", *BOX]).select("survey_id", F.col("version").alias("now"))
    before = content_id(t("parcels").where("NOT (survey_id % 2 = 1 AND k % 200 = 5)"), ["survey_id"], ["id", *BOX]).select("survey_id", F.col("version").alias("was"))
    return now.join(before, "survey_id").select("survey_id", (F.col("now") == F.col("was")).alias("may_publish"))


@query("l07_recorded_members", """
WITH m AS (SELECT lot_id, count(*) AS n, CAST(sum(declared_size) AS BIGINT) AS bytes, count(*) FILTER (WHERE declared_size > 19000000) AS big FROM attachments GROUP BY lot_id)
SELECT lot_id, n AS members, CASE WHEN lot_id % 9 = 0 THEN 'count differs' WHEN lot_id % 9 = 1 THEN 'bytes differ' WHEN big > 0 THEN 'member too large' END AS violation FROM m""")
def recorded_members(t):
    """A recorded archive reading counts only if its counters, sizes and limits agree with its members."""
    m = t("attachments").groupBy("lot_id").agg(F.count("*").alias("n"), F.sum("declared_size").alias("bytes"), F.count_if(F.col("declared_size") > 19_000_000).alias("big"))
    k = F.col("lot_id") % 9
    rec = m.select("lot_id", (F.col("n") + F.when(k == 0, 1).otherwise(0)).alias("rn"), (F.col("bytes") + F.when(k == 1, 1).otherwise(0)).alias("rb"))
    why = F.when(F.col("n") != F.col("rn"), "count differs").when(F.col("bytes") != F.col("rb"), "bytes differ").when(F.col("big") > 0, "member too large")
    return m.join(rec, "lot_id").select("lot_id", F.col("n").alias("members"), why.alias("violation"))


@query("l08_lookup_states", """
WITH n AS (SELECT DISTINCT k FROM lot_numbers)
SELECT n.k, CASE WHEN n.k % 11 = 0 THEN 'error' WHEN n.k % 11 = 1 THEN 'not_returned' WHEN n.k % 11 = 2 THEN 'rejected' WHEN o.k IS NOT NULL THEN 'received' ELSE 'not_found' END AS state, NOT (n.k % 11 > 2 AND o.k IS NOT NULL) AS retry FROM n LEFT JOIN (SELECT DISTINCT k FROM offers) o ON n.k = o.k""")
def lookup_states(t):
    """What each number lookup came to, and whether a retry run takes it up again."""
    n = t("lot_numbers").select("k").distinct().join(t("offers").select("k", F.lit(True).alias("hit")).distinct(), "k", "left")
    s = F.col("k") % 11
    status = F.when(s == 0, 500).when(s == 1, 404).otherwise(200)
    valid = s != 2
    state = F.when(status == 404, "not_returned").when(status != 200, "error").when(~valid, "rejected").when(F.col("hit"), "received").otherwise("not_found")
    return n.select("k", state.alias("state"), (state != "received").alias("retry"))


_ANSWERS = """a AS (SELECT user_id AS number, event_id AS answer, CASE event_type WHEN 'view' THEN 'received' WHEN 'click' THEN 'not_found' WHEN 'signup' THEN 'not_returned' WHEN 'purchase' THEN 'rejected' ELSE 'error' END AS state,
  event_id % 3 = 0 AS retry FROM events)"""


@query("l08_u06_lookup_runs", f"""
WITH {_ANSWERS}, g AS (SELECT number, list({{'state': state, 'answer': answer, 'counted': CAST(1 AS BIGINT), 'retry': retry}} ORDER BY answer) AS l FROM a GROUP BY number),
r AS (SELECT number, list_reduce(l, lambda s, x: CASE WHEN s.state = 'error' OR (s.state <> 'received' AND x.retry) THEN {{'state': x.state, 'answer': x.answer, 'counted': s.counted + 1, 'retry': x.retry}} ELSE s END) AS m FROM g)
SELECT number, m.state AS state, m.answer AS answer, m.counted AS counted, m.state <> 'received' AS open FROM r""")
def lookup_runs(t):
    """Answers that land in two halves and are taken in by two runs of one checkpoint; then the first half lands once more and a third run takes nothing from it."""
    kind = F.col("event_type")
    state = F.when(kind == "view", "received").when(kind == "click", "not_found").when(kind == "signup", "not_returned").when(kind == "purchase", "rejected").otherwise("error")
    answers = t("events").select(F.col("user_id").cast("long").alias("number"), F.col("event_id").cast("long").alias("answer"), state.alias("state"), (F.col("event_id") % 3 == 0).alias("retry"))
    middle = t("events").agg(F.expr("approx_percentile(event_id, 0.5)").alias("m")).first()["m"]
    work = scratch_folder(t.spark, "lookups")
    first = answers.where(F.col("answer") <= F.lit(middle))
    for landed in (first, answers.where(F.col("answer") > F.lit(middle)), first):
        landed.write.mode("append").parquet(f"{work}/landed")
        lookups.run(t.spark, f"{work}/landed", answers.schema, f"{work}/states", f"{work}/checkpoint")
    return lookups.current(t.spark, f"{work}/states")


@query("l10_rematch", """
WITH s AS (SELECT survey_id, wx0 + 400 AS a, wy0 + 400 AS b, wx1 - 400 AS c, wy1 - 400 AS d FROM surveys)
SELECT l.lot_id, count(DISTINCT CASE WHEN least(p.x1, s.c) > greatest(p.x0, s.a) AND least(p.y1, s.d) > greatest(p.y0, s.b) THEN p.k END) AS matched FROM lots l JOIN s ON l.survey_id = s.survey_id JOIN lot_numbers n ON l.lot_id = n.lot_id JOIN parcels p ON n.k = p.k GROUP BY l.lot_id""")
def rematch(t, inset: float = 400.0):
    """Saved lots against a changed window; nothing is observed anew."""
    geo = t("parcels").select(X.canonical(F.col("cad_num")).alias("number"), "k", *BOX)
    lots = t("lots").select("lot_id", "survey_id").join(t("surveys"), "survey_id")
    j = lots.join(t("lot_numbers").select("lot_id", X.canonical(F.col("cad_num")).alias("number")).distinct(), "lot_id").join(geo, "number")
    hit = (F.least("x1", F.col("wx1") - inset) > F.greatest("x0", F.col("wx0") + inset)) & (F.least("y1", F.col("wy1") - inset) > F.greatest("y0", F.col("wy0") + inset))
    return j.groupBy("lot_id").agg(F.count_distinct(F.when(hit, F.col("k"))).alias("matched"))


@query("i01_observation_ingest", """
WITH last AS (SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS et FROM events GROUP BY user_id), good AS (SELECT user_id AS key, arg_max(value, (ts, event_id)) AS v, max(ts) AS at FROM events WHERE event_type <> 'error' AND value > 0 GROUP BY user_id)
SELECT l.key, CASE WHEN l.et <> 'error' THEN 'received' WHEN g.key IS NOT NULL THEN 'retained' ELSE 'error' END AS state, strftime(g.at, '%Y-%m-%d %H:%M:%S') AS received_at, g.v AS value FROM last l LEFT JOIN good g ON l.key = g.key""")
def observation_ingest(t):
    """Landed event files through the incremental ingest, then the folded state."""
    work = scratch_folder(t.spark, "observations")
    observations.ingest(t.spark, t.folder, t("events").schema, "events.parquet", f"{work}/deltas", f"{work}/checkpoint")
    return observations.current(t.spark, f"{work}/deltas")
