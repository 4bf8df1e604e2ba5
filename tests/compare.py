"""Run registered queries and their SQL side by side. ``python tests/compare.py <sf dir> [name prefix ...]``"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def differences(spark_df, con, statement, limit=3):
    """Empty when the DataFrame and the SQL agree in columns, types' kinds and values."""
    left = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(statement)
    right = canonical([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return [f"columns {left[0]} / {right[0]}"]
    if len(left[1]) != len(right[1]):
        a, b = set(left[1]) - set(right[1]), set(right[1]) - set(left[1])
        return [f"rows {len(left[1])} / {len(right[1])}", f"only spark {list(a)[:limit]}", f"only sql {list(b)[:limit]}"]
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return [f"{len(bad)} rows differ"] + [f"{a}\n        {b}" for a, b in bad[:limit]] if bad else []


def types(spark_df, con, statement):
    """Column types that are not the plain counterpart of each other."""
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "date": "DATE", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]",
        "array<bigint>": "BIGINT[]",
    }
    sql_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {statement}").fetchall()}
    return [
        f"{c}: {t} / {sql_types.get(c)}"
        for c, t in spark_df.dtypes
        if same.get(t) != sql_types.get(c)
    ]


def main(folder: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry
    from chirrup.session import build_session

    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = oracle(folder), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = build(spark, folder)
            if name in sqls:
                bad = differences(df, con, sqls[name]) + types(df, con, sqls[name])
                n = ""
            else:
                bad, n = [], f"(rows only: {df.count()})"
        except Exception as e:  # noqa: BLE001
            bad, n = [f"{type(e).__name__}: {str(e)[:1500]}"], ""
        failed += bool(bad)
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - t0:.1f}s {n}", *bad, sep="\n     ", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
