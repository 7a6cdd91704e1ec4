"""Compares registered queries with their checking SQL: python -m tests.oracle [name part ...]"""

import datetime
import glob
import math
import os
import sys
import time

import duckdb

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def connection(folder=FOLDER):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, name, query, sql, con, folder=FOLDER):
    df = query(spark, folder)
    mine = table_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows only", len(mine[1])
    cur = con.execute(sql)
    theirs = table_of([d[0] for d in cur.description], cur.fetchall())
    if mine == theirs:
        return "ok", len(mine[1])
    if mine[0] != theirs[0]:
        return f"COLUMNS {mine[0]} / {theirs[0]}", len(mine[1])
    only_mine = [x for x in mine[1] if x not in set(theirs[1])][:3]
    only_theirs = [x for x in theirs[1] if x not in set(mine[1])][:3]
    return f"DIFF rows {len(mine[1])}/{len(theirs[1])}\n   columns {mine[0]}\n   spark {only_mine}\n   sql   {only_theirs}", len(mine[1])


def session(cores=8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry
    spark, con, sqls = session(), connection(), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        wanted = [a for a in sys.argv[1:] if not a.startswith("-")]
        if any(a[1:] in name for a in sys.argv[1:] if a.startswith("-")) or wanted and not any(part in name for part in wanted):
            continue
        start = time.time()
        try:
            verdict, rows = compare(spark, name, query, sqls.get(name), con)
        except Exception as error:  # reported, the run goes on
            verdict, rows = f"ERROR {type(error).__name__} {str(error)[:600]}", -1
        bad += verdict not in ("ok", "rows only")
        print(f"{name:36s} {time.time() - start:6.2f}s rows {rows:6d} {verdict}", flush=True)
    print("not matching:", bad)
