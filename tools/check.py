"""Compare every registered query with its SQL on one data folder.

    python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(float(v))
        if isinstance(v, (list, tuple)):
            return tuple(cell(x) for x in v)
        if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
            return v
        return str(v)

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    import duckdb

    from seqseg.plans.catalog import all_oracles, all_queries
    from seqseg.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--show", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", 8, {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.log.structuredLogging.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    queries, oracles = all_queries(), all_oracles()
    failed = 0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, args.sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in oracles:
                print(f"ROWS  {name:28s} {len(rows):7d} rows {took:6.2f}s", flush=True)
                continue
            result = con.execute(oracles[name])
            names = [d[0] for d in result.description]
            expected = result.fetchall()
            same_columns = sorted(names) == sorted(df.columns)
            a, b = canonical(rows, df.columns), canonical(expected, names)
            ok = same_columns and a == b
            failed += not ok
            print(f"{'OK   ' if ok else 'FAIL '} {name:28s} {len(rows):7d} rows {took:6.2f}s", flush=True)
            if not ok:
                print("   columns", sorted(df.columns), sorted(names), len(a), len(b))
                left, right = set(map(repr, a)), set(map(repr, b))
                print("   only spark", sorted(left - right)[:3])
                print("   only sql  ", sorted(right - left)[:3])
        except Exception as error:  # noqa: BLE001 - report and go on
            failed += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
