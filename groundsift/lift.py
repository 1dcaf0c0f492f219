"""Domain tables derived from the given parquet tables with plain integer arithmetic.

Each entry is SQL that Spark and an ANSI engine read alike.  The ground is a
lattice of survey windows, 2000 m square, so the number of windows grows with
the data and the density inside a window does not.  ``{part}`` and friends
stand for the base tables.
"""

from __future__ import annotations

import re

WINDOW_M = 2000
#: keys per survey window, table by table
PER_WINDOW = {"part": 200, "customer": 150, "supplier": 10, "orders": 1500, "documents": 100, "pages": 25}


def _window(key: str, table: str) -> str:
    return f"CAST(floor({key} / {PER_WINDOW[table]}.0) AS BIGINT)"


def _mix(key: str, a: int, b: int, m: int) -> str:
    """Scatter a key over 0..m-1; squares keep neighbouring keys from lining up."""
    return f"((({key} % {a}) * ({key} % {a}) * 31 + {key} * {b}) % {m})"


def _box(key: str, win: str, seeds: tuple[int, int, int, int], slots: int, width: str, height: str) -> str:
    a, b, c, d = seeds
    x = f"(({win} % 1000) * {WINDOW_M} + 20 * {_mix(key, a, b, slots)})"
    y = f"(CAST(floor({win} / 1000.0) AS BIGINT) * {WINDOW_M} + 20 * {_mix(key, c, d, slots)})"
    return (
        f"CAST({x} AS DOUBLE) AS x0, CAST({y} AS DOUBLE) AS y0, "
        f"CAST({x} + {width} AS DOUBLE) AS x1, CAST({y} + {height} AS DOUBLE) AS y1"
    )


def _number(win: str, key: str) -> str:
    """Object number with leading zeros, so that canonical form differs from the printed one."""
    return f"printf('%02d:%02d:%07d:%04d', 90, 12, {win}, {key})"


_P, _C, _S = _window("p_partkey", "part"), _window("c_custkey", "customer"), _window("s_suppkey", "supplier")
_O = _window("o_orderkey", "orders")
_L = _window("l_orderkey", "orders")
_D = _window("doc_id", "documents")
_LP = _window("l_partkey", "part")

#: mode names of the nine planning-context layers, in reading order
CONTEXT_MODES = (
    "settlements", "quarters", "schemes", "planned_parcels", "red_lines",
    "water", "forests", "protected", "heritage",
)
_MODE = "CASE c_nationkey % 9 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(CONTEXT_MODES)) + " END"

TABLES: dict[str, str] = {
    # survey windows; one row per window that holds parcels
    "surveys": f"""
        SELECT survey_id,
               CAST((survey_id % 1000) * {WINDOW_M} AS DOUBLE) AS wx0,
               CAST(CAST(floor(survey_id / 1000.0) AS BIGINT) * {WINDOW_M} AS DOUBLE) AS wy0,
               CAST((survey_id % 1000) * {WINDOW_M} + {WINDOW_M} AS DOUBLE) AS wx1,
               CAST(CAST(floor(survey_id / 1000.0) AS BIGINT) * {WINDOW_M} + {WINDOW_M} AS DOUBLE) AS wy1
        FROM (SELECT DISTINCT {_P} AS survey_id FROM {{part}}) AS w""",
    "parcels": f"""
        SELECT p_partkey AS k, {_P} AS survey_id, concat('p', CAST(p_partkey AS VARCHAR(20))) AS id,
               {_number(_P, 'p_partkey')} AS cad_num, p_type, p_brand, p_name, p_size, p_retailprice,
               {_box('p_partkey', _P, (10007, 7919, 10009, 104729), 95,
                     '20 * (4 + (p_partkey * 37) % 9)', '20 * (4 + (p_partkey * 53) % 9)')}
        FROM {{part}}""",
    "buildings": f"""
        SELECT c_custkey AS k, {_C} AS survey_id, concat('b', CAST(c_custkey AS VARCHAR(20))) AS id, c_mktsegment, c_acctbal,
               {_box('c_custkey', _C, (10037, 6151, 10039, 12289), 98,
                     '20 * (1 + (c_custkey * 13) % 2)', '20 * (1 + (c_custkey * 17) % 2)')}
        FROM {{customer}}""",
    "zones": f"""
        SELECT s_suppkey AS k, {_S} AS survey_id, concat('z', CAST(s_suppkey AS VARCHAR(20))) AS id, s_name, s_nationkey, s_acctbal,
               {_box('s_suppkey', _S, (10061, 4231, 10067, 9973), 80,
                     '20 * (15 + (s_suppkey * 7) % 16)', '20 * (15 + (s_suppkey * 11) % 16)')}
        FROM {{supplier}}""",
    "restrictions": f"""
        SELECT s_suppkey AS k, {_S} AS survey_id, concat('r', CAST(s_suppkey AS VARCHAR(20))) AS id, s_name, s_nationkey,
               {_box('s_suppkey', _S, (10069, 8123, 10079, 5557), 80,
                     '20 * (5 + (s_suppkey * 7) % 20)', '20 * (5 + (s_suppkey * 13) % 20)')}
        FROM {{supplier}}""",
    # nine planning-context layers from one table; c_nationkey names the layer
    "context": f"""
        SELECT c_custkey AS k, {_C} AS survey_id, concat('c', CAST(c_custkey AS VARCHAR(20))) AS id, {_MODE} AS mode,
               concat('90:12:', CAST({_C} AS VARCHAR(20)), CASE WHEN c_mktsegment = 'BUILDING' THEN ':0000' ELSE ':0012' END) AS quarter_num,
               c_acctbal, c_mktsegment,
               {_box('c_custkey', _C, (10091, 3121, 10093, 7877), 90,
                     '20 * (2 + (c_custkey * 29) % 10)', '20 * (2 + (c_custkey * 43) % 10)')}
        FROM {{customer}}""",
    # published plots: parcels offered without rights of others, and parcels on auction
    "offers": "SELECT * FROM ({parcels}) AS t WHERE p_type IN ('ECONOMY', 'PROMO')",
    "lots": f"""
        SELECT o_orderkey AS lot_id, {_O} AS survey_id,
               CASE o_orderstatus WHEN 'F' THEN 'PUBLISHED' WHEN 'O' THEN 'APPLICATIONS_SUBMISSION' ELSE 'SUCCEED' END AS status,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'ZK' WHEN '2-HIGH' THEN '229FZ' ELSE '178FZ' END AS type_code,
               o_orderpriority = '5-LOW' AS stopped,
               o_orderdate AS deadline_ts,
               CASE o_orderpriority
                    WHEN '4-NOT SPECIFIED' THEN substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10)
                    ELSE concat(substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10), 'T12:00:00Z') END AS deadline,
               o_totalprice AS price, o_custkey, o_orderpriority
        FROM {{orders}}""",
    # numbers named by a lot; printed form, repeated numbers possible
    "lot_numbers": f"""
        SELECT l_orderkey AS lot_id, l_partkey AS k, {_number(_LP, 'l_partkey')} AS cad_num, l_suppkey, l_linenumber
        FROM {{lineitem}}""",
    # attachments of lot cards: part is the file, one supplier brings another version of it
    "attachments": f"""
        SELECT l_orderkey AS lot_id, {_L} AS survey_id, l_partkey AS file_id, l_linenumber AS ord,
               CASE WHEN l_returnflag = 'N' THEN 'lot' ELSE 'notice' END AS scope,
               concat(CASE l_partkey % 3 WHEN 0 THEN 'Договор ' WHEN 1 THEN 'Схема ' ELSE 'Приложение ' END,
                      CAST(l_partkey AS VARCHAR(20)),
                      CASE WHEN l_suppkey = 7 THEN '-v2' ELSE '' END,
                      CASE l_partkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.jpg' ELSE '.zip' END) AS file_name,
               CAST(l_partkey * 9001 % 20000000 + 1 AS BIGINT) AS declared_size,
               l_linestatus = 'O' AND l_returnflag = 'R' AS inactive,
               CASE l_returnflag WHEN 'N' THEN 'Notice_Document' WHEN 'A' THEN 'Basis_for_sale' ELSE 'Draft_Contract' END AS type_code
        FROM {{lineitem}}""",
    # text pages: page 1 is the body, page 2 an act heading with numbers, page 3 a coordinate note or nothing
    "doc_pages": f"""
        SELECT doc_id, {_D} AS survey_id, CAST(1 AS BIGINT) AS page, text FROM {{documents}}
        UNION ALL
        SELECT doc_id, {_D} AS survey_id, CAST(2 AS BIGINT) AS page,
               concat('РЕШЕНИЕ', chr(10), 'от ', printf('%02d.%02d.%04d', 1 + doc_id % 28, 1 + doc_id % 12, 2015 + doc_id % 10),
                      ' г. № ', CAST(doc_id % 97 AS VARCHAR(20)), chr(10),
                      'Участок ', {_number(_D, 'doc_id * 2')}, ', смежный ', {_number(_D, 'doc_id * 2 + 1')},
                      '; зона Ж', CAST(1 + doc_id % 4 AS VARCHAR(20)), CASE WHEN doc_id % 5 = 0 THEN '.1' ELSE '' END,
                      ' и СХ2 рядом.') AS text
        FROM {{documents}}
        UNION ALL
        SELECT doc_id, {_D} AS survey_id, CAST(3 AS BIGINT) AS page,
               CASE WHEN lang = 'en' THEN 'Система координат МСК-91, каталог координат поворотных точек'
                    WHEN lang = 'fr' THEN concat('СК-63; участок ', {_number(_D, 'doc_id * 2')}, ' повторно упомянут')
                    ELSE 'стр. 3' END AS text
        FROM {{documents}}""",
    # one catalogue row per document
    "catalog": f"""
        SELECT doc_id, {_D} AS survey_id, source AS listing, lang,
               concat('https://docs.example.org/', source, '/', CAST(doc_id AS VARCHAR(20)),
                      CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.doc' WHEN 2 THEN '.zip' WHEN 3 THEN '.pdf' ELSE '' END) AS url,
               concat(CASE doc_id % 6 WHEN 0 THEN 'Административный регламент предоставления земельных участков без торгов '
                             WHEN 1 THEN 'Извещение об аукционе '
                             WHEN 2 THEN 'Публичный сервитут '
                             WHEN 3 THEN 'Проект планировки СНТ «Луч» '
                             WHEN 4 THEN 'Изменения ПЗЗ Заречного поселения '
                             ELSE 'Распоряжение о земельных участках ' END,
                      'от ', printf('%02d.%02d.%04d', 1 + doc_id % 28, 1 + doc_id % 12, 2015 + doc_id % 10), ' № ', CAST(doc_id % 97 AS VARCHAR(20))) AS title,
               CASE WHEN n_chars < 200 THEN 'pending' WHEN lang = 'de' THEN 'error' ELSE 'read' END AS state,
               text, n_chars, source
        FROM {{documents}}""",
    "observations": """
        SELECT event_id, user_id AS key, ts, event_type, value, props,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'received' END AS state,
               CASE WHEN event_type = 'error' THEN CAST(NULL AS DOUBLE) ELSE value END AS content
        FROM {events}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def _expand(sql: str, base) -> str:
    """Inline lifted tables, then name base tables through ``base``."""

    def sub(match: re.Match) -> str:
        name = match.group(1)
        return _expand(TABLES[name], base) if name in TABLES else base(name)

    return _NAME.sub(sub, sql)


def spark_sql(name: str, folder: str) -> str:
    text = _expand(TABLES[name], lambda t: f"parquet.`{folder}/{t}.parquet`")
    return text.replace("chr(10)", "char(10)")


def duck_sql(sql: str) -> str:
    """Prefix ``sql`` with the lifted tables it names."""
    used = [n for n in TABLES if re.search(rf"\b{n}\b", sql)]
    body = sql.strip()
    if not used:
        return body
    ctes = ",\n".join(f"{n} AS ({_expand(TABLES[n], lambda t: t).strip()})" for n in used)
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
