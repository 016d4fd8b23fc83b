"""Single-node reference point: DuckDB running the oracle SQL of the bench queries.

Usage: python tools/duckdb_times.py [sf_dir]   (median of 3 warm runs per query)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from bench import HEADLINE  # noqa: E402
from matchmart.catalog import ORACLE  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    times = {}
    for name in HEADLINE:
        if name not in ORACLE:
            continue
        con.execute(ORACLE[name]).fetchall()
        samples = []
        for _ in range(3):
            t0 = time.perf_counter()
            con.execute(ORACLE[name]).fetchall()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    print(json.dumps({"engine": "duckdb", "sf_dir": sf_dir, "queries": times,
                      "total": round(sum(times.values()), 3)}))


if __name__ == "__main__":
    main()
