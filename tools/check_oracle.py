"""Run registered queries beside their SQL on one data folder and compare rows.

usage: python tools/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from rankwell.plans.adapters import TABLES  # noqa: E402
from rankwell.plans.catalogue import ORACLES, QUERIES  # noqa: E402
from rankwell.session import build_session  # noqa: E402


def rows_of(frame):
    columns = sorted(frame.columns)
    kinds = {c: str(frame[c].dtype) for c in columns}
    values = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, kinds, sorted((tuple(map(repr, v)) for v in values))


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark = build_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    bad = 0
    for name in names:
        try:
            start = time.time()
            mine = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"{name}: rows only, {len(mine)} rows, {took:.1f}s", flush=True)
                continue
            start = time.time()
            other = db.execute(ORACLES[name]).fetchdf()
            other_took = time.time() - start
            c1, k1, r1 = rows_of(mine)
            c2, k2, r2 = rows_of(other)
            problems = []
            if c1 != c2:
                problems.append(f"columns {c1} != {c2}")
            if c1 == c2 and k1 != k2:
                problems.append(f"kinds { {c: (k1[c], k2[c]) for c in c1 if k1[c] != k2[c]} }")
            if len(r1) != len(r2):
                problems.append(f"rows {len(r1)} != {len(r2)}")
            if c1 == c2 and r1 != r2:
                only1 = [r for r in r1 if r not in set(r2)]
                only2 = [r for r in r2 if r not in set(r1)]
                problems.append(
                    f"values differ {len(only1)}/{len(only2)} {c1}\n   spark {only1[:2]}\n   sql   {only2[:2]}"
                )
            state = "ok" if not problems else "DIFF " + "; ".join(problems)[:1500]
            bad += bool(problems)
            print(f"{name}: {state}, {len(r1)} rows, {took:.1f}s / {other_took:.1f}s", flush=True)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"{name}: ERROR {type(error).__name__} {str(error)[:900]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
