"""Run catalogue queries on Spark and DuckDB and compare rows: compare.py FOLDER [query ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracle import ORACLES
from foliomill.plans.catalog import CATALOG
from foliomill.session import session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(record[i]) for i in order) for record in records]
    return sorted(columns), sorted(rows, key=repr)


def main(folder: str, names: list[str]) -> int:
    spark = session(
        "compare", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
        spark__sql__shuffle__partitions="8",
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name in names or list(CATALOG):
        started = time.time()
        try:
            df = CATALOG[name](spark, folder)
            mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - started
            if name not in ORACLES:
                print(f"{name:26s} rows only {len(mine[1])} {took:.1f}s", flush=True)
                continue
            started = time.time()
            result = db.execute(ORACLES[name])
            theirs = rows_of([d[0] for d in result.description], result.fetchall())
            same = mine == theirs
            bad += not same
            print(f"{name:26s} {'ok' if same else 'DIFFERS'} {len(mine[1])} {len(theirs[1])} "
                  f"{took:.1f}s {time.time() - started:.1f}s", flush=True)
            if not same:
                if mine[0] != theirs[0]:
                    print("   columns", mine[0], theirs[0])
                else:
                    shown = 0
                    for a, b in zip(mine[1], theirs[1]):
                        if a != b:
                            for n, x, y in zip(mine[0], a, b):
                                if x != y:
                                    at = 0
                                    if isinstance(x, str) and isinstance(y, str):
                                        at = next((i for i, (p, r) in enumerate(zip(x, y)) if p != r), min(len(x), len(y)))
                                    print("   ", n, at, repr(x)[max(0, at - 40):at + 160], "|", repr(y)[max(0, at - 40):at + 160])
                            shown += 1
                            if shown == 2:
                                break
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"{name:26s} FAILED {str(error)[:700]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
