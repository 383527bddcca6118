"""Compare registered queries with their SQL on the given tables.

``python tests/compare.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return repr(v)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(spark, con, sf_dir, fn, sql) -> str:
    """Empty when both agree."""
    df = fn(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = canonical([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        spark_rows, sql_rows = set(got[1]), set(want[1])
        a = [r for r in got[1] if r not in sql_rows][:3]
        b = [r for r in want[1] if r not in spark_rows][:3]
        return f"{len(got[1])} rows / {len(want[1])} rows\n  spark {a}\n  sql   {b}\n  cols {got[0]}"
    return ""


def main():
    import __spark_entry__ as entry
    from answerloom import get_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = get_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.session.timeZone": os.environ.get("COMPARE_TZ", "UTC"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        try:
            if name in sqls:
                diff = difference(spark, con, sf_dir, fn, sqls[name])
                note = "ok" if not diff else "DIFF " + diff
            else:
                note = f"no sql, {fn(spark, sf_dir).count()} rows"
        except Exception as e:  # report and go on
            note = "ERROR " + str(e)[:600]
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name} [{time.time() - t:.1f}s] {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
