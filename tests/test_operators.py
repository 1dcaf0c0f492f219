"""Joins, ranks, components, sinks and streaming on small and skewed inputs."""

import os
import sys
import json
import random

import pytest
from pyspark.sql import functions as F

from groundsift.functions import text as X
from groundsift.operators.components import connected_components
from groundsift.operators.knn import knn_join
from groundsift.operators.overlap import box_union_area
from groundsift.operators.ranking import global_rank, grouped_rank, running_total, with_neighbours
from groundsift.operators.tiles import box_overlap, distance_join, tile_join
from groundsift.sources import listings, sinks
from groundsift.streaming import observations

BOXES = "survey_id long, id string, x0 double, y0 double, x1 double, y1 double"


def boxes(seed, n, tag, hot=0):
    rnd, out = random.Random(seed), []
    for i in range(n):
        x, y = rnd.randint(-600, 600), rnd.randint(-600, 600)
        out.append((i % 2, f"{tag}{i}", float(x), float(y), float(x + rnd.randint(1, 300)), float(y + rnd.randint(1, 90))))
    return out + [(0, f"{tag}h{i}", 7.0, 7.0, 9.0, 9.0) for i in range(hot)]


def overlap(a, b):
    return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))


def distance(a, b):
    return (max(0, b[2] - a[4], a[2] - b[4]) ** 2 + max(0, b[3] - a[5], a[3] - b[5]) ** 2) ** 0.5


def test_tile_join_keeps_every_pair_once(spark):
    a, b = boxes(1, 60, "a", hot=30), boxes(2, 60, "b", hot=30)
    got = tile_join(spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES), side=64.0).withColumn("v", box_overlap()).collect()
    want = {(p[1], q[1]): overlap(p, q) for p in a for q in b if p[0] == q[0] and overlap(p, q) > 0}
    assert len(got) == len(want) and {(r["id"], r["r_id"]): r["v"] for r in got} == want


def test_touching_boxes_join_only_when_asked(spark):
    a = spark.createDataFrame([(1, "a", 0.0, 0.0, 10.0, 10.0)], BOXES)
    b = spark.createDataFrame([(1, "b", 10.0, 0.0, 20.0, 10.0)], BOXES)
    assert tile_join(a, b).count() == 0 and tile_join(a, b, touch=True).count() == 1


def test_distance_join(spark):
    a, b = boxes(3, 40, "a"), boxes(4, 40, "b")
    got = {(r["id"], r["r_id"]) for r in distance_join(spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES), 45.0, side=70.0).collect()}
    assert got == {(p[1], q[1]) for p in a for q in b if p[0] == q[0] and distance(p, q) <= 45}


def test_knn_with_ties_and_a_hot_spot(spark):
    a, b = boxes(5, 25, "a"), boxes(6, 40, "b", hot=40)
    got = {}
    for r in knn_join(spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES), 5, side=30.0).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["r_id"]))
    for p in a:
        want = [q[1] for q in sorted((q for q in b if q[0] == p[0]), key=lambda q: (distance(p, q), q[1]))[:5]]
        assert [i for _, i in sorted(got[p[1]])] == want


def test_knn_gives_what_there_is(spark):
    a = spark.createDataFrame([(1, "a", 0.0, 0.0, 1.0, 1.0), (2, "z", 0.0, 0.0, 1.0, 1.0)], BOXES)
    b = spark.createDataFrame([(1, "b", 900.0, 0.0, 901.0, 1.0)], BOXES)
    assert [(r["id"], r["r_id"]) for r in knn_join(a, b, 5, side=10.0).collect()] == [("a", "b")]


def test_components_of_paths_and_stars(spark):
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(120)] + [("hub", f"s{i:03}") for i in range(200)] + [("x", "y")]
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len(got) == len(nodes) and got["p120"] == "p000" and got["s199"] == "hub" and got["y"] == "x" and got["alone"] == "alone"


def test_union_area_of_boxes(spark):
    b = boxes(7, 40, "b", hot=20)
    got = {r["survey_id"]: r["union_m2"] for r in box_union_area(spark.createDataFrame(b, BOXES), ["survey_id"]).collect()}
    for s in (0, 1):
        mine = [q for q in b if q[0] == s]
        cells = {(x, y) for q in mine for x in range(int(q[2]), int(q[4])) for y in range(int(q[3]), int(q[5]))}
        assert got[s] == len(cells)


def test_ranks_neighbours_and_totals_under_skew(spark):
    rnd = random.Random(8)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", rnd.randint(0, 20), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    order = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert {r["id"]: r["position"] for r in global_rank(df, [F.desc("v"), F.col("id")]).collect()} == {r[2]: i + 1 for i, r in enumerate(order)}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    want = {r[2]: i + 1 for g in groups.values() for i, r in enumerate(g)}
    assert {r["id"]: r["position"] for r in grouped_rank(df, ["g"], [F.col("v"), F.col("id")]).collect()} == want
    prev = {r[2]: (g[i - 1][2] if i else None) for g in groups.values() for i, r in enumerate(g)}
    assert {r["id"]: r["prev_id"] for r in with_neighbours(df, ["g"], [F.col("v"), F.col("id")], ["id"]).collect()} == prev
    before = {r[2]: sum(q[1] for q in g[:i]) for g in groups.values() for i, r in enumerate(g)}
    assert {r["id"]: r["s"] for r in running_total(df, ["g"], [F.col("v"), F.col("id")], "v", "s", block=16).collect()} == before


def test_version_round_trip_and_tampering(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "k long, s string, v double")
    all_cols = lambda d: sinks.content_id(d.withColumn("_all", F.lit(1)), ["_all"], ["k", "s", "v"]).first()["version"]
    version = all_cols(df)
    assert all_cols(df.orderBy(F.desc("k")).repartition(3)) == version and all_cols(df.where("k = 1")) != version
    sinks.write_version(df, str(tmp_path), version)
    assert sinks.load_version(spark, str(tmp_path), version).count() == 2
    with pytest.raises(Exception):
        sinks.write_version(df, str(tmp_path), version)
    df.where("k = 1").write.mode("overwrite").parquet(f"{tmp_path}/version={version}")
    with pytest.raises(ValueError):
        sinks.load_version(spark, str(tmp_path), version)


def test_geojson_and_csv_files(spark, tmp_path):
    df = spark.createDataFrame([("a", [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]], "=1")], "id string, g array<array<array<struct<x:double,y:double>>>>, note string")
    sinks.write_features(sinks.feature_lines(df, "id", F.col("g"), ["id", "note"]), f"{tmp_path}/f")
    f = json.loads(spark.read.text(f"{tmp_path}/f").first()[0])
    assert f["geometry"] == {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]} and f["properties"]["note"] == "=1"
    sinks.write_csv(df.select("id", "note"), f"{tmp_path}/c")
    assert spark.read.option("sep", ";").option("header", True).csv(f"{tmp_path}/c").first()["note"] == "'=1"


def test_layer_file_scan(spark, tmp_path):
    from groundsift.sources.features import normalize, parse_geometry, read_layers

    fc = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "1", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [9, 0], [9, 9], [0, 0]]]}, "properties": {"category": 5}}]}
    (tmp_path / "a.json").write_text(json.dumps(fc))
    rows = read_layers(spark, str(tmp_path / "a.json")).select(F.lit("a").alias("response"), F.col("feature.properties.category").alias("category"), F.col("feature.id").alias("fid"), F.lit("EPSG:3857").alias("crs"),
                                                               parse_geometry(F.col("feature.geometry.type"), F.to_json("feature.geometry.coordinates")).alias("geom"))
    r = normalize(rows).first()
    assert r["reason"] is None and r["key"] == "5:1"


def test_ingest_keeps_the_last_good_date(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    def land(name, rows):
        spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    from pyspark.sql.types import _parse_datatype_string
    run = lambda: observations.ingest(spark, f"{tmp_path}/in/*", _parse_datatype_string(schema), "*.parquet", f"{tmp_path}/out", f"{tmp_path}/cp")
    land("a", [(1, "2024-01-01 00:00:00", 7, "view", 3.0), (2, "2024-01-01 00:00:00", 8, "error", None)])
    run()
    land("b", [(3, "2024-01-02 00:00:00", 7, "error", None), (4, "2024-01-02 00:00:00", 9, "view", 0.0)])
    run()
    run()  # nothing new has landed
    got = {r["key"]: (r["state"], r["received_at"]) for r in observations.current(spark, f"{tmp_path}/out").collect()}
    assert got == {7: ("retained", "2024-01-01 00:00:00"), 8: ("error", None), 9: ("received", None)}
    observations.compact(spark, f"{tmp_path}/out", f"{tmp_path}/compact")
    assert observations.current(spark, f"{tmp_path}/compact").count() == 3


def test_listing_links(spark):
    html = ("<nav><a href='/n'>nav</a></nav><article><nav><a href='/in'>in</a></nav><script>'<a href=\"/s\">s</a>'</script>"
            "<ul><li><a href='a.pdf'> Первый   документ </a> Дата публикации: 01.02.2024</li>"
            "<li><a href='b.pdf'>Второй</a> Дата публикации 01.02.2024 Дата опубликования: 02.02.2024</li></ul><a href='/c'></a><a href='/d'>Сессия 5</a></article><a href='/out'>out</a>")
    pages = spark.createDataFrame([(1, "https://h.example.org/x/", html), (2, "https://h.example.org/y/", "<p><a href='q'>q</a></p>")], "page_id long, url string, html string")
    got = {(r["url"], r["title"], r["publication_date"]) for r in listings.extract_links(pages).collect()}
    assert got == {("https://h.example.org/x/a.pdf", "Первый документ", "01.02.2024"), ("https://h.example.org/x/b.pdf", "Второй", None), ("https://h.example.org/d", "Сессия 5", None)}
    assert [r["url"] for r in listings.sessions(listings.extract_links(pages)).collect()] == ["https://h.example.org/d"]


@pytest.mark.parametrize("text,want", [
    ("от 05.03.2024 № 12-п", ("2024-03-05", "12-п")), ("решение от 5 марта 2024 года № 7 – б", ("2024-03-05", "7-б")),
    ("от 31.02.2024 № 1", None), ("№ 5", None), ("5. мая 2021 г. № 9", ("2021-05-05", "9")),
])
def test_act_identity(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(X.act_identity(F.col("t")).alias("a")).first()["a"]
    assert (tuple(r) if r else None) == want


def test_text_rules(spark):
    one = lambda text, fn: spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]
    assert one("зоны Ж1.1, Ж1 и СХ2; (И) БЖ1", X.zone_codes) == ["Ж1", "Ж1.1", "И", "СХ2"]
    assert one("90:12:0001:007 1:90:12:1:5 90:12:1:2:3", X.numbers) == ["90:12:1:7"]
    assert one("РЕШЕНИЕ\nО внесении изменений в решение от 01.01.2020 № 5", X.own_act) is None
    assert tuple(one("РЕШЕНИЕ\nот 02.01.2020 № 6\nО внесении изменений в решение от 01.01.2020 № 5", X.own_act)) == ("2020-01-02", "6")
    assert one("О внесении изменений в решение от 01.01.2020 № 5", X.listing_act) is None
    assert one("2024-01-01T00:00:00", X.aware_timestamp) is None and one("2024-01-01T00:00:00+03:00", X.aware_timestamp) is not None
    assert one("12 345,67", X.literal_number) == 12345.67 and one("4O5,1", X.literal_number) is None
    assert one("https://u@docs.example.org/a", lambda c: X.trusted_link(c, ["docs.example.org"])) is False
    assert one("https://docs.example.org:8443/a", lambda c: X.trusted_link(c, ["docs.example.org"])) is False
    assert one("https://docs.example.org/a", lambda c: X.trusted_link(c, ["docs.example.org"])) is True


def test_group_ranks_keep_null_groups_and_hot_ones(spark):
    from groundsift.operators.ranking import grouped_rank, running_total, with_neighbours

    rows = [("hot", i) for i in range(500)] + [(None, i) for i in range(40)] + [(f"g{i}", 1) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    got = grouped_rank(df, ["g"], ["v"]).collect()
    assert len(got) == len(rows) and all(r.position == (r.v + 1 if r.g in ("hot", None) else 1) for r in got)
    near = with_neighbours(df, ["g"], ["v"], ["v"]).where("g is null").orderBy("v").collect()
    assert [r.prev_v for r in near] == [None, *range(39)]
    total = {r.v: r.t for r in running_total(df, ["g"], ["v"], "v", "t", block=16).where("g is null").collect()}
    assert all(total[i] == i * (i - 1) // 2 for i in range(40))


def test_nearest_reaches_any_distance(spark):
    from groundsift.operators.knn import knn_join

    left = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0)], "survey_id long, id long, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame([(1, 7, 11.0, 0.0, 12.0, 1.0), (1, 8, 1.5e6, 0.0, 1.5e6 + 1, 1.0)], left.schema)
    got = knn_join(left, right, 2).orderBy("rank").collect()
    assert [(r.r_id, r.distance_m) for r in got] == [(7, 10.0), (8, 1.5e6 - 1)]


def test_listing_tokens_follow_the_rules():
    from groundsift.sources.listings import page_links

    html = """<a href=/out>out</a><!-- <article> --><article><nav><a href=/n>nav</a></nav><script>if (a<b) '<a href=x>'</script>
      <a href="/one&amp;two"> One <b>two</b> &amp; </a><ul><li>Дата публикации: 01.02.2024 <a href='/in'>In</a>
      <ul><li><a href=/deep>Deep</a> Дата опубликования 03.02.2024 Дата публикации 04.02.2024</li></ul></li></ul><a href=/empty> </a></article></nav>"""
    got = page_links([html, None, "<p>no article <a href=x>y</a>", "<article><li><a href=/z>Z</a> Дата публикации 05.05.2020</li></article>"])
    assert [tuple(r) for r in got[["page", "href", "title", "publication_date", "articles"]].itertuples(index=False)] == [
        (0, "/one&two", "One two &", None, 1), (0, "/in", "In", "01.02.2024", 1), (0, "/deep", "Deep", None, 1), (3, "/z", "Z", "05.05.2020", 1)]


def test_paragraphs_by_operator(spark):
    from pyspark.sql import functions as F

    from groundsift.plans import scalars as S

    text = "РЕШЕНИЕ\nрешил:\n1. Отменить решение от 01.02.2014 № 5\nв части.\n12. Утвердить.\nПредседатель\n3. Нет"
    row = spark.createDataFrame([(text,)], "t string").select(
        S.evidence_paragraphs(F.col("t")).alias("a"), S.operative_paragraphs(F.col("t"), S.ORDER_OPENS, S.ORDER_ENDS).alias("b")).first()
    assert row.a == ["Отменить решение от 01.02.2014 № 5 в части.", "Утвердить."] and row.b is None


def test_written_steps_leave_no_shuffle_files(tmp_path):
    """In a session of its own process: a step that is written drops its shuffles at once and leaves the caller's setting alone."""
    import subprocess
    import textwrap

    code = textwrap.dedent(f"""
        import glob
        from pyspark.sql import SparkSession, functions as F
        from groundsift.session import CLEANUP_CONF, cut
        spark = (SparkSession.builder.master("local[2]").config("spark.local.dir", "{tmp_path}/local").config("spark.checkpoint.dir", "{tmp_path}/kept")
                 .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate())
        before = spark.conf.get(CLEANUP_CONF, None)
        df = cut(spark.range(100000).withColumn("x", F.rand(1)).repartition(3, "x"))
        left = glob.glob("{tmp_path}/local/**/shuffle_*", recursive=True)
        assert not left and df.count() == 100000 and spark.conf.get(CLEANUP_CONF, None) == before, left
    """)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120)


def test_links_are_read_a_few_pages_at_a_time(spark, monkeypatch):
    """A thousand pages of one batch never become one table of tags, and no link is lost or moved to another page."""
    from groundsift.sources import listings

    assert [p for s, t in listings._portions([None, "x" * (2 * listings.READ_CHARS), "", *["y"] * 1000]) for p in range(s, t)] == list(range(1003))
    assert all(t - s <= listings.READ_PAGES for s, t in listings._portions(["y"] * 1000)) and not list(listings._portions([]))
    rows = [(i, "https://a.example/", f"<article><a href='/d/{i}'>Title {i}</a></article>") for i in range(1000)]
    got = listings.extract_links(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    assert {(r.page_id, r.url, r.title) for r in got.collect()} == {(i, f"https://a.example/d/{i}", f"Title {i}") for i in range(1000)}


def test_ring_rules_shuffle_once(spark):
    """The ends of a ring need no second pass over its points and no join."""
    from groundsift.operators import rings

    p = spark.createDataFrame([(1, n, str(n), float(n), float(n * n), n) for n in range(4)], "doc_id long, ord int, point string, x double, y double, page int")
    g = rings.check_rings(p, ["doc_id"], consecutive=True)
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and g.first().points == 4


def test_rows_of_pages_without_a_group_call_each(spark):
    """Row numbers of many pages, a null page among them, as a plain scan of each page gives them; no page is a Python call of its own."""
    from groundsift.operators import layout

    rng = random.Random(2)
    words = [(None if k == 0 else k, i, rng.choice([0.1, 0.11, 0.2, 0.5]) + rng.random() / 100) for k in range(30) for i in range(rng.randint(1, 20))]
    df = spark.createDataFrame([(k, i, y, y + 0.02) for k, i, y in words], "k int, i int, y0 double, y1 double")
    got = layout.visual_rows(df, ["k"])
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for k in {w[0] for w in words}:
        start, n = None, 0
        for c, i in sorted(((y + (y + 0.02)) / 2, i) for kk, i, y in words if kk == k):
            if start is None or c - start > 0.02 * 0.55:
                start, n = c, n + 1
            want[k, i] = n
    assert {(r.k, r.i): r.row for r in got.collect()} == want
