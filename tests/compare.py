"""Run queries next to their SQL twins: python tests/compare.py [sf_dir] [names or family prefixes...]."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return ("s", str(v))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else round(v, 6) + 0.0)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (list, tuple)):
        return ("l", tuple(norm(x) for x in v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return ("t", str(v))
    return ("o", str(v))


def duck(folder):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, folder):
    t = time.time()
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return "rows", len(rows), took, ""
    rel = con.sql(sql)
    cols = rel.columns
    other = rel.fetchall()
    order_a = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    order_b = sorted(range(len(cols)), key=lambda i: cols[i])
    if [df.columns[i] for i in order_a] != [cols[i] for i in order_b]:
        return "COLUMNS", len(rows), took, f"{sorted(df.columns)} vs {sorted(cols)}"
    a = sorted((tuple(norm(r[i]) for i in order_a) for r in rows), key=repr)
    b = sorted((tuple(norm(r[i]) for i in order_b) for r in other), key=repr)
    if a == b:
        return "ok", len(rows), took, ""
    from collections import Counter
    ca, cb = Counter(a), Counter(b)
    return "DIFF", len(rows), took, (f"spark {len(a)} sql {len(b)}\n   only spark: {list((ca - cb).items())[:3]}"
                                     f"\n   only sql:   {list((cb - ca).items())[:3]}")


if __name__ == "__main__":
    from evigrid.session import build_session
    from evigrid.workloads import load_all
    queries, oracles = load_all()
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "20g"})
    spark.sparkContext.setLogLevel("OFF")
    con = duck(folder)
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or fn.__module__.endswith("." + w) for w in wanted):
            continue
        try:
            state, n, took, note = compare(spark, con, name, fn, oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001
            state, n, took, note = "ERROR", 0, 0, str(e)[:1500]
        bad += state not in ("ok", "rows")
        print(f"{state:8} {name:32} {n:8} rows {took:6.1f}s {note}", flush=True)
    print("bad", bad)
