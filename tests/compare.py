"""python tests/compare.py [SF_DIR] [NAME...]: every query against its SQL in DuckDB, by sorted rows."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def difference(spark, con, sf_dir, f, sql):
    df = f(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}", len(got[1])
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows and {len(want[1])}", len(got[1])
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return (f"{len(bad)} rows differ, as {bad[0]}" if bad else ""), len(got[1])


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from tessera.plans import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    for name in sys.argv[2:] or queries():
        t = time.time()
        try:
            if name in oracle_sql():
                said, n = difference(spark, con, sf_dir, queries()[name], oracle_sql()[name])
            else:
                said, n = "no SQL", queries()[name](spark, sf_dir).count()
        except Exception as e:
            said, n = f"FAILED {str(e)[:500]}", -1
        print(f"{name} {n} rows {time.time() - t:.1f} s {said}", flush=True)
