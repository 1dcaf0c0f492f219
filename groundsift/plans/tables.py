"""R-series: coordinate tables and scanned layouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundsift.functions import text as X
from groundsift.operators import layout as L
from groundsift.operators import rings as R
from groundsift.registry import query
from groundsift.session import cut, spread, unsent


def scheme_pages(t):
    """Three pages with one X/Y table per parcel: box corners, page footers in between, some open, some with a repeated or moved point.

    p_size decides: 1 open, 2 closing point moved, 3 repeated place, 4 broken row, 5 one more row after closure, otherwise sound.
    """
    n = lambda c: F.translate((F.col(c) + 100000).cast("decimal(12,2)").cast("string"), ".", ",")
    s = F.col("p_size")
    row = lambda label, x, y: F.concat(F.lit(f"\n{label} "), n(x), F.lit(" "), n(y))
    last = F.when(s == 1, "").when(s == 2, row("н1", "x1", "y1")).when(s == 5, F.concat(row("н1", "x0", "y0"), row("н9", "x1", "y1"))).otherwise(row("н1", "x0", "y0"))
    third = F.when(s == 3, row("н3", "x1", "y0")).when(s == 4, "\nн3 1O0,00 2").otherwise(row("н3", "x1", "y1"))
    head = F.concat(F.lit("Обозначение земельного участка :ЗУ"), (F.col("k") % 90 + 1).cast("string"), F.lit("\nКоординаты, м\nX   Y"))
    bodies = F.array(F.concat(head, row("н1", "x0", "y0"), row("н2", "x1", "y0"), F.lit("\nЛист")), F.concat(F.lit("1234-ПМТ\nЛист № докум. Подп. Дата Изм"), third, row("н4", "x0", "y1"), F.lit("\n\n")),
                     F.concat(F.lit("1234-ПМТ"), last, F.lit("\nКонец таблицы")))
    return t("parcels").select(F.col("k").alias("doc_id"), F.posexplode(bodies).alias("i", "text")).select("doc_id", (F.col("i") + 5).cast("bigint").alias("page"), "text")


@query("r01_table_points", """
SELECT k AS doc_id, concat(':ЗУ', CAST(k % 90 + 1 AS VARCHAR)) AS label, count(*) AS points, round(sum(x), 2) AS sum_x, count(DISTINCT page) AS pages FROM (
 SELECT k, x0 + 100000 AS x, p_size, 1 AS o, 5 AS page FROM parcels UNION ALL SELECT k, x1 + 100000, p_size, 2, 5 FROM parcels UNION ALL SELECT k, x1 + 100000, p_size, 3, 6 FROM parcels UNION ALL SELECT k, x0 + 100000, p_size, 4, 6 FROM parcels
 UNION ALL SELECT k, CASE WHEN p_size = 2 THEN x1 ELSE x0 END + 100000, p_size, 5, 7 FROM parcels WHERE p_size <> 1) WHERE p_size <> 4 OR o < 3 GROUP BY k""")
def table_points(t):
    """Rows of tables that go over page ends."""
    p, _ = R.table_points(scheme_pages(t))
    return p.groupBy("doc_id", "label").agg(F.count("*").alias("points"), F.round(F.sum("x"), 2).alias("sum_x"), F.count_distinct("page").alias("pages"))


@query("r01_broken_rows", """
SELECT k AS doc_id, CASE WHEN p_size = 4 THEN 6 ELSE 7 END AS page, CASE WHEN p_size = 4 THEN 'not a point row' ELSE 'row after closure' END AS reason FROM parcels WHERE p_size IN (4, 5)""")
def broken_rows(t):
    """Lines that stop a table short of its end, and rows that come after it."""
    _, broken = R.table_points(scheme_pages(t))
    return broken.select("doc_id", F.col("page").cast("int").alias("page"), "reason")


@query("r04_ring_rules", """
SELECT k AS doc_id, CASE p_size WHEN 1 THEN 'not closed' WHEN 2 THEN 'closing point moved,not closed' WHEN 3 THEN 'repeated place' WHEN 4 THEN 'not closed,fewer than three vertices' ELSE '' END AS issues,
 CASE WHEN p_size <= 4 THEN 'rejected' ELSE 'review_required' END AS state, CASE WHEN p_size > 4 THEN (x1 - x0) * (y1 - y0) END AS local_area_m2 FROM parcels""")
def ring_rules(t):
    """Explicit closure, distinct labels and places, three vertices, no self-intersection."""
    p, _ = R.table_points(scheme_pages(t))
    return R.check_rings(p, ["doc_id", "label", "label_no"]).select("doc_id", F.array_join("issues", ",").alias("issues"), "state", "local_area_m2")


@query("r02_consecutive_rings", """
SELECT l_orderkey AS doc_id, count(*) AS points, bool_or(coalesce(jump, false)) AS out_of_order, bool_or(coalesce(skip, false)) AS page_skipped FROM (
 SELECT l_orderkey, l_linenumber <> lag(l_linenumber) OVER w + 1 AS jump, l_linenumber > lag(l_linenumber) OVER w + 1 AS skip FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) GROUP BY l_orderkey""")
def consecutive_rings(t):
    """Rows of a section in sheet order: numbers rise by one, no page is left out."""
    d = spread(t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")), "doc_id").distinct()  # two numbers a row are all that is shuffled
    p = d.select("doc_id", F.col("n").alias("ord"), F.col("n").cast("string").alias("point"), F.cos(F.col("n").cast("double")).alias("x"), F.sin(F.col("n").cast("double")).alias("y"), F.col("n").alias("page"))
    g = R.check_rings(p, ["doc_id"], consecutive=True)
    return g.select("doc_id", "points", F.array_contains("issues", "row numbers out of order").alias("out_of_order"), F.array_contains("issues", "page skipped").alias("page_skipped"))


def component_pages(t):
    """A component over two pages, with its stated area; one in seven has another row after its closure."""
    n = lambda c: F.translate((F.col(c) + 100000).cast("decimal(12,2)").cast("string"), ".", ",")
    row = lambda label, x, y: F.concat(F.lit(f"\n{label} "), n(x), F.lit(" "), n(y))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) + F.when(F.col("p_size") % 4 == 0, 5).otherwise(0)
    head = F.concat(F.lit("Номер контура многоконтурного земельного участка :ЗУ"), (F.col("k") % 50 + 1).cast("string"), F.lit("("), (F.col("p_size") % 9 + 1).cast("string"),
                    F.lit(")\nПлощадь контура многоконтурного земельного участка "), F.translate(area.cast("decimal(12,1)").cast("string"), ".", ","), F.lit(" кв. м\nX Y"))
    bodies = F.array(F.concat(head, row("н1", "x0", "y0"), row("н2", "x1", "y0"), row("н3", "x1", "y1"), F.lit("\n17\nИзм Лист № докум. Подп. Дата")),
                     F.concat(F.lit("18"), row("н4", "x0", "y1"), row("н1", "x0", "y0"), F.when(F.col("p_size") % 7 == 3, row("н7", "x0", "y1")).otherwise("")))
    return t("parcels").select(F.col("k").alias("doc_id"), F.posexplode(bodies).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("page"), "text")


@query("r03_r07_components", """
SELECT k AS doc_id, concat(':ЗУ', CAST(k % 50 + 1 AS VARCHAR)) AS parent, CAST(p_size % 9 + 1 AS INTEGER) AS component, (x1 - x0) * (y1 - y0) AS local_area_m2, p_size % 4 = 0 AS stated_area_disagrees,
  CASE WHEN p_size % 7 = 3 THEN 'rejected' ELSE 'review_required' END AS state FROM parcels""")
def components(t):
    """Named components with their stated areas, compared within the printed decimals; a row after closure rejects one."""
    pages = component_pages(t)
    heads = R.page_lines(pages).where(F.col("text").rlike(R.COMPONENT)).select("doc_id", F.upper(F.regexp_extract("text", R.COMPONENT, 1)).alias("parent"), F.regexp_extract("text", R.COMPONENT, 2).cast("int").alias("component"))
    stated = R.page_lines(pages).where(F.col("text").rlike(R.STATED)).select("doc_id", F.regexp_extract("text", R.STATED, 1).alias("stated"))
    p, broken = R.table_points(pages, heading=R.COMPONENT, footer=R.COMPONENT_FOOTER)
    g = R.check_rings(p, ["doc_id", "label", "label_no"])
    late = broken.where("reason = 'row after closure'").select("doc_id", F.lit(True).alias("late")).distinct()
    j = g.join(unsent(heads), "doc_id").join(unsent(stated), "doc_id").join(unsent(late), "doc_id", "left")
    return j.select("doc_id", "parent", "component", "local_area_m2", R.stated_area_disagrees(F.col("local_area_m2"), F.col("stated")).alias("stated_area_disagrees"),
                    F.when(F.col("late"), "rejected").otherwise(F.col("state")).alias("state"))


@query("r06_transcriptions", """
WITH p AS (SELECT k AS doc_id, p_size, k % 6 AS slip, CASE p_size WHEN 1 THEN 4 WHEN 4 THEN 2 ELSE 5 END AS n FROM parcels)
SELECT doc_id, CAST(n + CASE slip WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS typed_rows, CAST(CASE WHEN slip IN (1, 2, 3) THEN 1 ELSE 0 END AS BIGINT) AS differing,
  slip IN (0, 1, 4, 5) AND p_size NOT IN (1, 2, 3, 4) AS ring_holds, slip IN (0, 4, 5) AND p_size NOT IN (1, 2, 3, 4) AS accepted FROM p""")
def transcriptions(t):
    """Typed rows against drafted ones, ordinal by ordinal, and the ring rules on what was typed; one in six has a slip in a number, a row left out or one too many."""
    keys, slip = ["doc_id", "label", "label_no"], F.col("doc_id") % 6
    draft, _ = R.table_points(scheme_pages(t))
    draft = cut(draft)
    rows = draft.join(unsent(draft.groupBy(*keys).agg(F.max("ord").alias("n"))), keys)
    typed = rows.where(~((slip == 2) & (F.col("ord") == F.col("n")))).select(*keys, "ord", "point", (F.col("x") + F.when((slip == 1) & (F.col("ord") == 2), 1).otherwise(0)).alias("x"), "y", "page")
    typed = typed.unionByName(rows.where((slip == 3) & (F.col("ord") == F.col("n"))).select(*keys, (F.col("ord") + 1).alias("ord"), F.lit("н8").alias("point"), "x", (F.col("y") + 7).alias("y"), "page"))
    place = [*keys, "ord"]
    j = draft.select(*place, F.struct("point", "x", "y").alias("drafted")).join(unsent(typed.select(*place, F.struct("point", "x", "y").alias("written"))), place, "full")
    found = j.groupBy(*keys).agg(F.count("written").alias("typed_rows"), F.count_if(~F.col("drafted").eqNullSafe(F.col("written"))).alias("differing"))
    rules = R.check_rings(typed, keys).select(*keys, (F.col("state") == "review_required").alias("ring_holds"))
    return found.join(unsent(rules), keys).select("doc_id", "typed_rows", "differing", "ring_holds", ((F.col("differing") == 0) & F.col("ring_holds")).alias("accepted"))


# Wording of statements about a parent parcel, a division and a quarter.
_CAD = r"\d{1,2}:\d{1,2}:\d{1,10}:\d{1,10}"
STATEMENTS = {
    "origin": rf"(?iu)в\s+границах\s+земельного\s+участка\s+с\s+кадастровым\s+номером\s+({_CAD})\s+площадью\s+(\d{{1,9}}(?:[,.]\d{{1,2}})?)\s+кв\.?\s*м(?![\p{{L}}\d_])",
    "division": rf"(?iu)Путем\s+раздела\s+земельного\s+участка\s+с\s+кадастровым\s+номе[\s-]*ром\s+({_CAD})\s+с\s+сохранением\s+исходного",
    "quarter": r"(?iu)кадастров[\s-]*[а-яё]*\s+квартал[а-яё]*\s+(\d{1,2}:\d{1,2}:\d{1,10})(?![:\d])",
}
#: characters of the next page that a statement may run on into
_RUN_ON = 400


def statement_pages(t):
    """All pages; page 2 goes on with statements, the last of which may run over to page 3."""
    k, quarter = F.col("doc_id"), F.col("survey_id").cast("string")
    number = F.concat(F.lit("90:12:"), quarter, F.lit(":"), (k * 2).cast("string"))
    more = F.concat(F.lit("\nкадастровый квартал 90:12:"), quarter, F.lit(" указан"),
                    F.when(k % 2 == 0, F.concat(F.lit("\nРасположен в границах земельного участка с кадастровым номером "), number, F.lit(" площадью 1234,5 кв.м, далее"))).otherwise(""),
                    F.when(k % 3 == 0, F.lit("\nПутем раздела земельного участка с кадастровым номе-")).otherwise(""))
    head = F.when(k % 3 == 0, F.concat(F.lit("ром "), number, F.lit(" с сохранением исходного\n"))).otherwise("")
    return t("doc_pages").select("doc_id", "page", F.when(F.col("page") == 2, F.concat("text", more)).when(F.col("page") == 3, F.concat(head, F.col("text"))).otherwise(F.col("text")).alias("text"))


@query("r09_statements", """
WITH d AS (SELECT doc_id, concat('90:12:', CAST(CAST(floor(doc_id / 100.0) AS BIGINT) AS VARCHAR)) AS q FROM documents)
SELECT doc_id, 'quarter' AS kind, q AS number, CAST(NULL AS DOUBLE) AS stated_area_m2, CAST(2 AS BIGINT) AS page, concat('кадастровый квартал ', q) AS excerpt FROM d
UNION ALL SELECT doc_id, 'origin', concat(q, ':', CAST(doc_id * 2 AS VARCHAR)), 1234.5, 2, concat('в границах земельного участка с кадастровым номером ', q, ':', CAST(doc_id * 2 AS VARCHAR), ' площадью 1234,5 кв.м') FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'division', concat(q, ':', CAST(doc_id * 2 AS VARCHAR)), NULL, 2, concat('Путем раздела земельного участка с кадастровым номе-', chr(10), 'ром ', q, ':', CAST(doc_id * 2 AS VARCHAR), ' с сохранением исходного') FROM d WHERE doc_id % 3 = 0""")
def statements(t):
    """Statements of all pages with the page they begin on and their excerpt, those that run over a page end too."""
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("page"))
    p = statement_pages(t).withColumn("rest", F.substring(F.coalesce(after, F.lit("")), 1, _RUN_ON))
    both = F.concat("text", F.lit("\n"), "rest")

    def found(kind, pattern):
        every = F.regexp_extract_all(both, F.lit(pattern), F.lit(0))
        own = F.slice(every, F.lit(1), F.size(every) - F.size(F.regexp_extract_all("rest", F.lit(pattern), F.lit(0))))  # the others begin on the next page
        area = F.translate(F.regexp_extract("excerpt", pattern, 2), ",", ".").try_cast("double") if kind == "origin" else F.lit(None).cast("double")
        return p.select("doc_id", "page", F.explode(own).alias("excerpt")).select(
            "doc_id", F.lit(kind).alias("kind"), F.regexp_extract("excerpt", pattern, 1).alias("number"), area.alias("stated_area_m2"), "page", "excerpt")

    return found("quarter", STATEMENTS["quarter"]).unionByName(found("origin", STATEMENTS["origin"])).unionByName(found("division", STATEMENTS["division"]))


@query("r10_unparsed_pages", "SELECT k AS doc_id, page FROM parcels, (SELECT unnest([6, 7]) AS page) WHERE p_size = 4 OR (p_size = 5 AND page = 7)")
def unparsed_pages(t):
    """Pages with number pairs no table took up."""
    pages = scheme_pages(t)
    p, _ = R.table_points(pages)
    used = p.select("doc_id", "page", "text").distinct()
    pair = R.page_lines(pages).where(F.col("text").rlike(R.PAIR)).select("doc_id", "page", "text").distinct()
    return pair.join(unsent(used), ["doc_id", "page", "text"], "left_anti").select("doc_id", F.col("page").cast("int").alias("page")).distinct()


@query("r11_page_limit", """SELECT k AS doc_id, p_size = 1 AND k % 2 = 0 AS cut_off FROM parcels WHERE p_size <> 4""")
def page_limit(t):
    """A ring left open on the last page read may continue beyond it; it is not accepted."""
    p, _ = R.table_points(scheme_pages(t))
    g = R.check_rings(p, ["doc_id", "label", "label_no"], explicit=False).where("vertices >= 3")
    processed = F.when(F.col("doc_id") % 2 == 0, 6).otherwise(9)
    return g.select("doc_id", ((F.col("closure") != "explicit") & ~F.array_contains("issues", "closing point moved") & (F.col("last_page") == processed)).alias("cut_off"))


PAGE = ["conv_id", "turn"]


def word_boxes(t):
    """Word boxes of scanned pages: every turn is a page and every word of it a box, six to a line.

    Words of even length read as numbers; the third word of a line reaches up to the fourth.
    """
    v = t("conversations").select("conv_id", "turn", F.length("text").alias("n"), F.split("text", r"\s+").alias("v"))
    w = v.select("conv_id", "turn", "n", (F.ceil(F.size("v") / 6) * 40 + 20).alias("height"), F.posexplode("v").alias("i", "word")).where("word <> ''")
    jitter, column = (F.col("n") + F.col("i")) % 3, F.col("i") % 6
    shown = F.when(F.length("word") % 2 == 0, F.concat((F.length("word") * 11 + 10000).cast("string"), F.lit(",5"))).otherwise(F.col("word"))
    return w.select("conv_id", "turn", F.lit(1000).alias("width"), "height", "i", column.alias("place"), shown.alias("text"), (column * 150 + 20 + jitter).cast("double").alias("x"),
                    (F.floor(F.col("i") / 6) * 40 + 10 + jitter).cast("double").alias("y"), F.when(column == 2, 135.0).otherwise(80.0).alias("w"), F.lit(20.0).alias("h"))


_WORDS = """v AS (SELECT conv_id, turn, length(text) AS n, regexp_split_to_array(text, '\\s+') AS v FROM conversations),
w AS (SELECT conv_id, turn, i - 1 AS i, (i - 1) % 6 AS place, (i - 1) // 6 AS line, (n + i - 1) % 3 AS jt, v[i] AS word, ceil(len(v) / 6.0) * 40 + 20 AS height FROM (SELECT *, unnest(generate_series(1, len(v))) AS i FROM v) WHERE v[i] <> '')"""


@query("f21_word_positions", f"""WITH {_WORDS} SELECT conv_id, turn, CAST(i AS INTEGER) AS i, round((place * 150 + 20 + jt) / 1000.0, 4) AS x0, round((line * 40 + 30 + jt) / height, 4) AS y1,
  length(word) % 2 = 0 OR length(word) <= 200 AS usable FROM w""")
def word_positions(t):
    return L.normalise_words(word_boxes(t)).select("conv_id", "turn", "i", F.round("x0", 4).alias("x0"), F.round("y1", 4).alias("y1"), "usable")


def page_words(t):
    return L.normalise_words(word_boxes(t)).select("conv_id", "turn", "text", "x0", "y0", "x1", "y1")


@query("r12_visual_rows", f"WITH {_WORDS} SELECT conv_id, turn, count(DISTINCT line) AS rows, count(*) AS words FROM w GROUP BY conv_id, turn")
def visual_rows(t):
    return L.visual_rows(page_words(t), PAGE).groupBy("conv_id", "turn").agg(F.max("row").cast("bigint").alias("rows"), F.count("*").alias("words"))


_CELLS = """c AS (SELECT w.conv_id, w.turn, w.place, w.jt, n.word IS NOT NULL AS joined, length(w.word) % 2 = 0 AND coalesce(length(n.word) % 2 = 0, true) AS numeric FROM w
  LEFT JOIN w n ON w.conv_id = n.conv_id AND w.turn = n.turn AND w.place = 2 AND n.i = w.i + 1 LEFT JOIN w p ON w.conv_id = p.conv_id AND w.turn = p.turn AND w.place = 3 AND p.i = w.i - 1 WHERE p.i IS NULL)"""


@query("r13_cells", f"WITH {_WORDS}, {_CELLS} SELECT conv_id, turn, count(*) AS cells, count(*) FILTER (WHERE joined) AS joined FROM c GROUP BY conv_id, turn")
def cells(t):
    c = L.cells(L.visual_rows(page_words(t), PAGE), PAGE)
    return c.groupBy("conv_id", "turn").agg(F.count("*").alias("cells"), F.count_if(F.col("text").contains(" ")).alias("joined"))


@query("r14_column_anchors", f"""WITH {_WORDS}, {_CELLS}, g AS (SELECT conv_id, turn, place, count(*) AS n, median((place * 150 + 20 + jt) / 1000.0) AS centre FROM c WHERE numeric GROUP BY conv_id, turn, place)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY centre) AS INTEGER) AS "column", round(centre, 4) AS centre, n FROM g WHERE n >= 2""")
def column_anchors(t):
    """Columns are where cells of at least five digits, and nothing that numbers don't have, begin one below the other."""
    c = L.cells(L.visual_rows(page_words(t), PAGE), PAGE).where(L.numeric_cell(F.col("text")))
    return L.anchors(c, PAGE).select("conv_id", "turn", "column", F.round("centre", 4).alias("centre"), "n")


@query("r15_table_split", """
WITH r AS (SELECT conv_id, turn, turn * 0.02 + CASE WHEN turn >= 3 AND conv_id % 2 = 0 THEN 0.2 ELSE 0 END AS cy FROM conversations), d AS (SELECT *, cy - lag(cy) OVER (PARTITION BY conv_id ORDER BY cy) AS dd FROM r),
m AS (SELECT conv_id, coalesce(median(dd), 0.02) AS md FROM d GROUP BY conv_id) SELECT d.conv_id, d.turn, CAST(1 + sum(CASE WHEN dd > md * 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY d.conv_id ORDER BY cy) AS BIGINT) AS "table" FROM d JOIN m ON d.conv_id = m.conv_id""")
def table_split(t):
    r = t("conversations").select("conv_id", "turn", (F.col("turn") * 0.02 + F.when((F.col("turn") >= 3) & (F.col("conv_id") % 2 == 0), 0.2).otherwise(0.0)).alias("cy"))
    return L.split_tables(r, ["conv_id"]).select("conv_id", "turn", "table")


@query("r16_cell_agreement", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'column 1: differs' WHEN o_orderkey % 7 = 0 THEN 'column 1: missing' ELSE '' END AS issues FROM orders WHERE o_totalprice >= 100000""")
def cell_agreement(t):
    """Two readings of a cell: both must parse, and to the same value."""
    price = F.translate(F.col("o_totalprice").cast("decimal(12,2)").cast("string"), ".", ",")
    other = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("9"), F.substring(price, 2, 20))).when(F.col("o_orderkey") % 7 == 0, "4O5,1").otherwise(price)
    o = t("orders").where("o_totalprice >= 100000").select("o_orderkey", X.read_coordinate(price).alias("a"), X.read_coordinate(other).alias("b"))
    issue = F.when(F.col("a").isNull() | F.col("b").isNull(), "column 1: missing").when(F.col("a") != F.col("b"), "column 1: differs").otherwise("")
    return o.select("o_orderkey", issue.alias("issues"))


@query("r17_crop_bands", f"""WITH {_WORDS} SELECT conv_id, turn, CAST(place AS INTEGER) AS place, round(greatest(0, min((place * 150 + 20 + jt) / 1000.0) - 0.012), 4) AS left_edge,
  round(least(1, max((place * 150 + 20 + jt + CASE WHEN place = 2 THEN 135 ELSE 80 END) / 1000.0) + 0.012), 4) AS right_edge FROM w GROUP BY conv_id, turn, place HAVING count(*) >= 2""")
def crop_bands(t):
    """Column bands from the extents of their cells, padded, inside the page."""
    w = L.normalise_words(word_boxes(t))
    g = w.groupBy("conv_id", "turn", "place").agg(F.count("*").alias("n"), F.greatest(F.lit(0.0), F.min("x0") - 0.012).alias("l"), F.least(F.lit(1.0), F.max("x1") + 0.012).alias("r"))
    return g.where("n >= 2 AND r - l BETWEEN 0.005 AND 0.25").select("conv_id", "turn", "place", F.round("l", 4).alias("left_edge"), F.round("r", 4).alias("right_edge"))


def catalogue_lines(t):
    """Ordered catalogue lines: part label, sometimes two contours, four points and the closing row each."""
    k = F.col("k")
    ring = lambda dx: [F.concat(F.lit(f"{n} "), (F.col(x) + dx + 100000).cast("decimal(12,1)").cast("string"), F.lit(" "), (F.col(y) + 200000).cast("decimal(12,1)").cast("string")) for n, x, y in
                       (("1", "x0", "y0"), ("2", "x1", "y0"), ("3", "x1", "y1"), ("4", "x0", "y1"), ("1", "x0", "y0"))]
    two = F.array(F.concat(F.lit(":ЗУ "), (k % 900 + 1).cast("string")), F.lit("Контур 1"), *ring(0), F.lit("Контур 2"), *ring(5000))
    one = F.array(F.concat(F.lit(":ЗУ "), (k % 900 + 1).cast("string")), *ring(0))
    return t("parcels").select(k.alias("doc_id"), F.posexplode(F.when(F.col("p_size") % 2 == 0, two).otherwise(one)).alias("line", "text"), F.lit(1).alias("page"))


@query("r19_catalogue_parts", """
SELECT k AS doc_id, concat(':ЗУ', CAST(k % 900 + 1 AS VARCHAR)) AS part, c.contour, CAST(5 AS BIGINT) AS points, 'review_required' AS state, (x1 - x0) * (y1 - y0) AS local_area_m2 FROM parcels, LATERAL (SELECT unnest(CASE WHEN p_size % 2 = 0 THEN ['1', '2'] ELSE [''] END) AS contour) c""")
def catalogue_parts(t):
    """Parts and contours assembled from ordered lines, each ring under the ring rules."""
    p = R.assemble_parts(catalogue_lines(t), ["doc_id"])
    g = R.check_rings(p, ["doc_id", "part", "contour", "ring"], consecutive=True)
    return g.select("doc_id", "part", "contour", "points", "state", "local_area_m2")


@query("r20_section_columns", f"""WITH {_WORDS} SELECT conv_id, turn, CAST(i AS INTEGER) AS i, row_number() OVER (PARTITION BY conv_id, turn ORDER BY place, line) AS position FROM w WHERE line >= 1""")
def section_columns(t):
    """Words of a section in reading order: column, then downwards; the first line is the section mark, and what stands above it or in it is left out."""
    from groundsift.operators.ranking import grouped_rank

    w = L.normalise_words(word_boxes(t)).select("conv_id", "turn", "i", "x0", "y0")
    cols = L.anchors(w, PAGE, gap=0.09, least=1)
    a = L.assign_columns(w, cols, PAGE, "x0", ["i"])
    mark = w.where("i < 6").groupBy(*PAGE).agg(F.max("y0").alias("mark_y"))
    inside = a.join(mark, PAGE, "left").where(F.col("mark_y").isNull() | (F.col("y0") > F.col("mark_y")))
    return grouped_rank(inside.select("conv_id", "turn", "i", "column", "y0"), PAGE, [F.col("column"), F.col("y0"), F.col("i")]).select("conv_id", "turn", "i", "position")
