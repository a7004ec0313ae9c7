"""Compare registered queries with their SQL on one scale factor: check.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from freshet.queries import load_all
from freshet.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("T", " ").removesuffix(" 00:00:00")
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda t: [(x is None, str(type(x)), x) for x in t])


def compare(spark, con, name, q, sf_dir):
    t0 = time.time()
    df = q.run(spark, sf_dir)
    got = df.collect()
    sec = time.time() - t0
    cols, mine = rows_of(df.columns, got)
    if q.sql is None:
        return f"rows-only {len(mine)}", sec
    cur = con.execute(q.sql)
    ocols, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return f"COLUMNS {cols} vs {ocols}", sec
    if mine == theirs:
        return f"ok {len(mine)}", sec
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b][:3]
    return f"DIFF {len(mine)} vs {len(theirs)}: {bad}", sec


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    wanted = sys.argv[2:]
    bad = 0
    for name, q in load_all().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            res, sec = compare(spark, con, name, q, sf_dir)
        except Exception as e:  # report and go on with the next query
            res, sec = f"ERROR {type(e).__name__}: {str(e)[:1500]}", 0.0
        bad += not res.startswith(("ok", "rows-only"))
        print(f"{sec:6.2f}s {name}: {res}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
