"""Compare registered queries with their SQL twins: ``python tests/check.py SF [key ...]``."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from flowspark.session import build_session  # noqa: E402
from oracle import compare, connect  # noqa: E402


def main() -> None:
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(sf_dir)
    failed = 0
    for key in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[key](spark, sf_dir)
            if key in oracles:
                result = compare(df, con, oracles[key])
            else:
                n = len(df.collect())
                result = None if n else "no rows"
        except Exception as e:  # report and go on
            result = f"{type(e).__name__}: {str(e)[:600]}"
        failed += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {key} {time.time() - start:.1f}s "
              f"{result or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
