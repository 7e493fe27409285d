"""Compare every registered query with its DuckDB twin: names, types, row count and values.

    python -m suite.check [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan" if math.isnan(v) else repr(v + 0.0))
    if hasattr(v, "isoformat"):
        return (3, v.isoformat(sep=" "))
    return (4, f"{type(v).__name__}:{v}")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


_DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
               "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


def compare(spark_df, con, sql: str) -> str:
    """'' where both agree, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: _DUCK_TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    expected = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} <> {sorted(names)}"
    wrong = [(n, t, types[n]) for n, t in spark_df.dtypes if t != types[n]]
    if wrong:
        return f"types {wrong}"
    got = [tuple(r) for r in spark_df.collect()]
    if len(got) != len(expected):
        return f"{len(got)} rows <> {len(expected)}"
    a, b = _rows(spark_df.columns, got), _rows(names, expected)
    for x, y in zip(a, b):
        if x != y:
            return f"values {x} <> {y}"
    return "" if a else "EMPTY"


def main(argv: list[str]) -> int:
    from suite.all_queries import ORACLES, QUERIES
    from treegauge.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                verdict = compare(fn(spark, sf_dir), con, ORACLES[name]) or "ok"
            else:
                verdict = f"rows {fn(spark, sf_dir).count()}"
        except Exception as e:
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        failed += verdict != "ok" and not verdict.startswith("rows ")
        print(f"{name:34s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
