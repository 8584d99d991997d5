"""Run registered queries beside their SQL in DuckDB: python tests/check.py [name-part ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session(partitions: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (int, float)) else (True, "n", float(x)) for x in r))


def compare(df, con, sql) -> str:
    sn, sr = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    dn, dr = _rows([d[0] for d in cur.description], cur.fetchall())
    if sn != dn:
        return f"COLUMNS spark-only {set(sn) - set(dn)} duck-only {set(dn) - set(sn)}"
    if len(sr) != len(dr):
        return f"ROWS {len(sr)} vs {len(dr)}; first {sr[:2]} | {dr[:2]}"
    types = {k: (type(a).__name__, type(b).__name__) for r, q in zip(sr, dr) for k, a, b in zip(sn, r, q) if a is not None and b is not None and type(a) is not type(b)}
    bad = [(k, a, b) for r, q in zip(sr, dr) for k, a, b in zip(sn, r, q) if a != b]
    note = f" TYPES {types}" if types else ""
    kinds = {n: t for n, t in df.dtypes}
    dk = {d[0]: str(d[1]) for d in con.execute(f"select * from ({sql}) limit 0").description}
    width = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    off = {n: (t, dk[n]) for n, t in kinds.items() if t in width and width[t] != dk[n].upper()}
    if off:
        note += f" WIDTH {off}"
    if bad:
        return f"VALUES {len(bad)} differ, e.g. {bad[:4]}" + note
    return f"ok {len(sr)} rows" + note


def main(argv):
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    import __spark_entry__ as entry

    spark, con = session(), duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, run in queries.items():
        if argv and not any(a == name or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        t = time.time()
        try:
            df = run(spark, sf)
            if name in oracles:
                msg = compare(df, con, oracles[name])
            else:
                rows = df.collect()
                msg = f"ok(no sql) {len(rows)} rows {rows[:1]}"
        except Exception as e:  # noqa: BLE001
            msg = "ERROR " + str(e)[:700]
        if not msg.startswith("ok") or "TYPES" in msg or "WIDTH" in msg:
            failed.append(name)
        print(f"{name}: {msg} [{time.time() - t:.1f}s]", flush=True)
    print("FAILED", len(failed), failed)


if __name__ == "__main__":
    main(sys.argv[1:])
