"""Compare registered queries with their SQL: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value + 0.0:.9g}")
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return value


def bag(table) -> tuple[list[str], list[str], Counter]:
    names = sorted(table.column_names)
    columns = [[plain(v) for v in table.column(n).to_pylist()] for n in names]
    types = [str(table.schema.field(n).type).replace("large_", "") for n in names]
    return names, types, Counter(zip(*columns)) if columns else Counter()


def check(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None if both give the same bag of rows, else what differs."""
    left = bag(fn(spark, sf_dir).toArrow())
    right = bag(con.execute(sql).to_arrow_table())
    if left[0] != right[0]:
        return f"columns {left[0]} against {right[0]}"
    if left[1] != right[1]:
        return f"types {[x for x in zip(*[left[0], left[1], right[1]]) if x[1] != x[2]]}"
    if left[2] != right[2]:
        only_left, only_right = left[2] - right[2], right[2] - left[2]
        return (
            f"rows {left[2].total()} against {right[2].total()}; only in Spark {only_left.total()}: "
            f"{[str(r)[:600] for r in list(only_left)[:2]]}; only in SQL {only_right.total()}: {[str(r)[:600] for r in list(only_right)[:2]]}"
        )
    return None


def main() -> int:
    from patchlake.session import build_session
    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = e.queries(), e.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracle:
                difference = check(spark, con, sf_dir, queries[name], oracle[name])
                state = "same" if difference is None else "DIFFERENT " + difference
            else:
                difference = None
                state = f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            difference = "error"
            state = "ERROR " + str(error)[:1500]
        bad += difference is not None
        print(f"{name} {time.time() - start:.1f}s {state}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
