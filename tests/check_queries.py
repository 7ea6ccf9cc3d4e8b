"""Run registered queries against their SQL: python tests/check_queries.py [sf] [name part ...]"""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from emberframe.session import build_session  # noqa: E402
from tests.oracle import ROOT, connect, difference  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    parts = sys.argv[2:]
    spark = build_session()
    con = connect(f"{ROOT}/{sf}")
    oracles = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = build(spark, f"{ROOT}/{sf}")
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(exc)).strip()[:1500]
            if "--trace" in parts:
                traceback.print_exc()
        took = time.time() - start
        kind = "sql" if name in oracles else "rows"
        if problem:
            bad += 1
        print(f"{'FAIL' if problem else 'ok  '} {kind:4} {took:6.2f}s {name} {problem or ''}", flush=True)
    print("failures:", bad)
