"""Compare queries with their SQL: python tests/oracle.py SF_DIR [NAME...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows_of(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, bool):
            return int(v)
        if isinstance(v, float) or type(v).__name__ == "Decimal":
            v = float(v)
            return int(v) if v == math.floor(v) else round(v, 6)
        return v

    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=str)


def compare(spark, sf, names=None):
    import duckdb

    import __spark_entry__ as e

    q, o, bad = e.queries(), e.oracle_sql(), {}
    with duckdb.connect() as c:
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        for n in names or o:
            t0 = time.time()
            try:
                df = q[n](spark, sf)
                got = rows_of([tuple(r) for r in df.collect()], df.columns)
                cur = c.execute(o[n])
                cols = [d[0] for d in cur.description]
                want = rows_of(cur.fetchall(), cols)
                why = None if got == want and sorted(df.columns) == sorted(cols) else f"{len(got)} and {len(want)} rows; {got[:2]} {want[:2]} {df.columns} {cols}"
                if not why and not got:
                    why = "no rows"
            except Exception as x:
                why = f"{type(x).__name__}: {str(x)[:600]}"
            if why:
                bad[n] = why
            print(n, "ok" if not why else "BAD " + why, round(time.time() - t0, 1), flush=True)
    return bad


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    found = compare(s, sys.argv[1], sys.argv[2:])
    print("BAD:", *found)
