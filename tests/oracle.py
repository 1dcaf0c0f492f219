"""Run registered queries against their SQL in DuckDB: ``python tests/oracle.py [folder] [name-prefix...]``."""

from __future__ import annotations

import collections
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 4)
        return int(r) if r == int(r) else r
    return v


def compare(columns, rows, ref_columns, ref_rows) -> str | None:
    if sorted(columns) != sorted(ref_columns):
        return f"columns {sorted(columns)} vs {sorted(ref_columns)}"
    order = sorted(columns)
    i = [columns.index(c) for c in order]
    j = [ref_columns.index(c) for c in order]
    a = collections.Counter(tuple(norm(r[k]) for k in i) for r in rows)
    b = collections.Counter(tuple(norm(r[k]) for k in j) for r in ref_rows)
    if a != b:
        return (f"{order} rows {sum(a.values())} vs {sum(b.values())}; only spark {list((a - b).items())[:3]}; "
                f"only sql {list((b - a).items())[:3]}")
    return None


def types_match(df, ref) -> str | None:
    kinds = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "INTEGER": "int"}
    ours = dict(df.dtypes)
    bad = [(c, ours.get(c), str(t)) for c, t in ref if ours.get(c) is not None and kinds.get(str(t), str(t)) != ours[c]]
    return f"types {bad}" if bad else None


def check(spark, con, name, folder) -> tuple[str, float, float]:
    import __spark_entry__ as entry

    QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
    t0 = time.time()
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in ORACLES:
        return f"ok rows-only {len(rows)}", t1 - t0, 0.0
    cur = con.execute(ORACLES[name])
    ref_cols = [d[0] for d in cur.description]
    ref_types = [(d[0], d[1]) for d in cur.description]
    ref = cur.fetchall()
    t2 = time.time()
    problem = compare(df.columns, rows, ref_cols, ref) or types_match(df, ref_types)
    if problem is None and not rows:
        return "ok EMPTY", t1 - t0, t2 - t1
    return ("ok " + str(len(rows))) if problem is None else "MISMATCH " + problem, t1 - t0, t2 - t1


def main(argv):
    folder = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        folder, argv = argv[0], argv[1:]
    import __spark_entry__ as entry
    from groundsift.session import local_session

    names = [n for n in entry.queries() if not argv or any(n.startswith(p) for p in argv)]
    spark, con, bad = local_session("8"), duck(folder), 0
    for name in names:
        try:
            verdict, a, b = check(spark, con, name, folder)
        except Exception as exc:  # report and go on
            verdict, a, b = "ERROR " + str(exc)[:700].replace("\n", " "), 0.0, 0.0
        if not verdict.startswith("ok") or "EMPTY" in verdict or a > 8 or b > 8:
            bad += not verdict.startswith("ok")
            print(f"{name}: {verdict}  spark {a:.1f}s sql {b:.1f}s", flush=True)
        elif argv:
            print(f"{name}: {verdict}  spark {a:.1f}s sql {b:.1f}s", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
