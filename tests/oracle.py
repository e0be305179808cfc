"""Compare registered queries with their DuckDB SQL: ``python tests/oracle.py SF_DIR [NAME...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if hasattr(v, "item"):
        return normal(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    got = query(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} / {sorted(names)}"
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, want.fetchall())
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}: {a[:1]} {b[:1]}"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not _near(x, y)]
    return f"{len(wrong)} of {len(a)} rows differ: {wrong[0]}" if wrong else None


def _near(x: tuple, y: tuple) -> bool:
    return all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) <= 2e-5) for p, q in zip(x, y, strict=True))


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connection(sys.argv[1])
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [q for q in queries if not q.startswith("op") and q != "pipeline"]:
        began = time.time()
        try:
            said = compare(spark, con, name, queries[name], oracles[name], sys.argv[1]) if name in oracles else f"rows only: {queries[name](spark, sys.argv[1]).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:400]}"
        if said or time.time() - began > 8:
            print(f"{name} ({time.time() - began:.1f} s): {said or 'ok'}", flush=True)
    print("done", len(queries), len(oracles))
