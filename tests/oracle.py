"""Compare every named query with its SQL form in DuckDB.

usage: python tests/oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

EXACT = bool(os.environ.get("ORACLE_EXACT"))  # compare doubles bit by bit
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if EXACT else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return f"decimal:{v}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v if isinstance(v, str) else repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t)
    )


def kind(name: str) -> str:
    name = name.lower()
    for k, words in {
        "int": ("int", "long", "short"), "float": ("double", "float"), "text": ("string", "varchar"),
        "bool": ("bool",), "time": ("timestamp", "date"),
    }.items():
        if any(name.startswith(w) for w in words) or (k == "int" and name in ("bigint", "integer", "tinyint")):
            return k
    return name


def compare(spark, con, sf_dir, name, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return ("rows-only", len(got), took, df.columns)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return ("COLUMNS", sorted(df.columns), sorted(cols), took)
    dtypes = {d[0]: str(d[1]).lower() for d in cur.description}
    odd = [(c, t2, dtypes[c]) for c, t2 in df.dtypes if "hugeint" in dtypes[c] or "decimal" in dtypes[c] + t2]
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return ("VALUES", len(a), len(b), diff, took)
    if odd:
        return ("TYPES", odd, took)
    return ("ok", len(a), took)


def main():
    from evenhand.session import local_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("oracle")
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        if EXACT and name not in sqls:
            continue
        try:
            res = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            res = ("ERROR", type(exc).__name__, str(exc)[:900])
        if res[0] not in ("ok", "rows-only"):
            bad += 1
        print(f"{name:32s}", *res, flush=True)
    print("not matching:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
