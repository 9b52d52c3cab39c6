"""Run chosen queries against DuckDB: python -m tests.check sf0.01 [name ...]"""

import sys
import time

import __spark_entry__ as entry
from tests.compare import connect, diff
from trackmill.session import local_session

if __name__ == "__main__":
    sf, names = sys.argv[1] if "/" in sys.argv[1] else f"/root/testdata/{sys.argv[1]}", sys.argv[2:]
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names or sorted(entry.queries()):
        t = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            sql = entry.oracle_sql().get(name)
            why = (f"rows-only {df.count()}") if sql is None else diff(df, con, sql)
        except Exception as e:  # noqa: BLE001
            why = f"ERROR {type(e).__name__}: {str(e)[:900]}"
        bad += bool(why and not why.startswith("rows-only"))
        print(f"{name:28s} {time.time() - t:6.1f}s {'ok' if not why else why}", flush=True)
    print("bad:", bad)
