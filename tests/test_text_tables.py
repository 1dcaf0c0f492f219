"""Tables in page text against a plain reading, keys in JSON trees, and lookups over runs."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from groundsift.operators import rings as R
from groundsift.operators.jsontree import has_key, tree_keys

HEAD, AXES, FOOTERS = "Обозначение земельного участка :ЗУ{}", "X  Y", ("Лист", "1234-ПМТ", "", "Лист № докум. Подп. Дата Изм")


def plain(lines):
    """(label, table, point, page) rows and reasons of what else looked like a row; ``lines``: (page, text)."""
    rows, broken, state, label, table, seen = [], [], 0, None, 0, []
    for page, text in lines:
        text = " ".join(text.split())
        if text in FOOTERS:
            continue
        if m := re.fullmatch(r"Обозначение земельного участка (:ЗУ\d+)", text):
            state, label, table, seen = 1, m[1], table + 1, []
        elif re.fullmatch(r"X\s+Y", text):
            state = 2 if state in (1, 2) else state
        elif m := re.fullmatch(r"(н?\d+) (-?\d{1,8}(?:[,.]\d{1,3})?) (-?\d{1,8}(?:[,.]\d{1,3})?)", text):
            if state == 2 and len(seen) > 1 and seen[0] in seen[1:]:
                broken.append((table, page, "row after closure"))
            elif state == 2:
                seen.append(m[1])
                rows.append((label, table, m[1], page))
        elif state == 2:
            if re.match(r"(?:н\S*\s+\S+|\d+\s+(?:[-\d]|\S+\s+[-\d]))", text):
                broken.append((table, page, "not a point row"))
            state = 3
    return sorted(rows), sorted(broken)


def test_tables_over_pages(spark):
    r = random.Random(4)
    pages, want = [], {}
    for doc in range(40):
        lines = []
        for page in range(r.randrange(1, 7)):
            body = []
            for _ in range(r.randrange(0, 14)):
                kind = r.random()
                body.append(HEAD.format(r.randrange(3)) if kind < 0.1 else AXES if kind < 0.25 else r.choice(FOOTERS) if kind < 0.4 else "н2 1O0 5" if kind < 0.43 else "Прочий текст" if kind < 0.47
                            else f"н{r.randrange(1, 6)}  {r.randrange(100)},5 -{r.randrange(100)}")
            pages.append((doc, page * 2 + 1, "\n".join(body)))
            lines += [(page * 2 + 1, b) for b in body]
        want[doc] = plain(lines)
    points, broken = R.table_points(spark.createDataFrame(pages, "doc_id long, page long, text string").repartition(5))
    rows, bad = points.collect(), broken.collect()
    for doc, (found, late) in want.items():
        assert sorted((x.label, x.label_no, x.point, x.page) for x in rows if x.doc_id == doc) == found
        assert sorted((x.label_no, x.page, x.reason) for x in bad if x.doc_id == doc) == late
    assert {x.reason for x in bad} == {"row after closure", "not a point row"}
    empty, _ = R.table_points(spark.createDataFrame([(1, 1, None), (2, 1, "")], "doc_id long, page long, text string"))
    assert empty.count() == 0


def test_keys_anywhere_in_a_tree(spark):
    def names(x):
        if isinstance(x, dict):
            for k, v in x.items():
                yield k
                yield from names(v)
        elif isinstance(x, list):
            for v in x:
                yield from names(v)

    deep = {"end": 1}
    for i in range(25):
        deep = [deep] if i % 2 else {"n": deep}
    trees = [deep, {"a": {"b": [1, {"c": None}, [[{"токен": "x"}]]]}, "b": "b"}, [], {}, 5, "token", None, [{"a": 1}, {"a": 2}]]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(100, None), (101, "{"), (102, ""), (103, '{"\\u0061":1}')]
    df = spark.createDataFrame(rows, "id long, body string")
    got = [(x.id, x.name) for x in tree_keys(df, "id", F.col("body")).collect()]
    assert sorted(got) == sorted([(i, n) for i, t in enumerate(trees) for n in names(t)] + [(103, "a")])
    flags = {x.id: (x.readable, x.forbidden) for x in has_key(df, "id", F.col("body"), ["токен", "end", "a"]).collect()}
    assert flags[0] == flags[1] == flags[7] == flags[103] == (True, True) and flags[101] == flags[102] == flags[100] == (False, False) and flags[5] == (True, False)


def _joins(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_tables_of_pages_send_no_side_whole(spark, tmp_path):
    """Files of pages are small, what is read from them is not: no join of the line machine or the ring rules is a broadcast."""
    pages = "concat('Обозначение земельного участка :ЗУ1\nX Y\nн1 1,0 1,0\nн2 5,0 1,0\nн3 5,0 ', id % 9, ',0\nн1 1,0 1,0\nн7 2,0 2,0')"
    spark.range(300).selectExpr("id AS doc_id", "1L AS page", f"{pages} AS text").write.parquet(str(tmp_path / "pages"))
    read = spark.read.parquet(str(tmp_path / "pages"))
    lines = R.table_lines(read, ["doc_id"], R.DESIGNATION)
    points, broken = R.table_points(read)
    rings = R.check_rings(points, ["doc_id", "label", "label_no"])
    assert all("Broadcast" not in _joins(d) for d in (lines, points, broken, rings))
    assert "Expand" not in _joins(rings)  # distinct counts would send every row three times
    assert broken.count() == 300 and broken.where("reason = 'row after closure'").count() == 300
    assert {(r["vertices"], r["state"]): r["n"] for r in rings.groupBy("vertices", "state").agg(F.count("*").alias("n")).collect()} == {(3, "review_required"): 266, (3, "rejected"): 34}
