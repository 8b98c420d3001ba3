"""Run registered queries against their SQL: run_oracle.py [sf_dir] [key ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from sievework.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
chosen = sys.argv[2:]
spark = local_session(8)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
bad = 0
for key, fn in entry.queries().items():
    if chosen and not any(key.startswith(c) for c in chosen):
        continue
    start = time.time()
    try:
        df = fn(spark, sf_dir)
        sql = entry.oracle_sql().get(key)
        verdict = compare(df, con, sql) if sql else f"no SQL, {df.count()} rows"
    except Exception as e:
        verdict = f"{type(e).__name__}: {str(e)[:700]}"
    bad += verdict is not None
    print(f"{'ok  ' if verdict is None else 'FAIL'} {key} {time.time() - start:.1f}s {verdict or ''}", flush=True)
print("not ok:", bad)
