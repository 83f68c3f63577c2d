"""Compare registered queries with DuckDB: python tests/check.py [sf_dir] [name ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gateflow.queries import QUERIES, SQL  # noqa: E402
from gateflow.session import build_session  # noqa: E402
from tests.oracle import differences, duck  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con, bad = build_session("check"), duck(sf_dir), []
    for name in args or QUERIES:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            result = differences(got, con.execute(SQL[name]).df()) if name in SQL else "rows only"
        except Exception as e:  # noqa: BLE001
            got, result = [], f"ERROR {type(e).__name__} {str(e)[:1500]}"
        if result not in ("", "rows only"):
            bad.append(name)
        print(f"{name:32s} {len(got):7d} rows {time.time() - start:6.2f}s {result or 'ok'}", flush=True)
    print("FAILED:", bad or "none")


if __name__ == "__main__":
    main()
