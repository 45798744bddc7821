"""Compare registered queries with their SQL on DuckDB: python tests/check_oracle.py [sf] [name part ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP",
}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(con, df, sql):
    """None when rows, names and types agree, else what differs."""
    relation = con.sql(sql)
    names, types = list(relation.columns), [str(x) for x in relation.types]
    expected = dict(zip(names, types))
    actual = {name: KINDS.get(kind, kind) for name, kind in df.dtypes}
    if expected != actual:
        return f"schema: spark {actual} duckdb {expected}"
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    right = rows_of(names, relation.fetchall())
    if len(left) != len(right):
        return f"rows: spark {len(left)} duckdb {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"values: {len(bad)} of {len(left)} rows differ, first {bad[0]}"
    return None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from parcelmill.runtime import session

    sf = argv[1] if len(argv) > 1 else "0.01"
    parts = argv[2:]
    spark = session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__autoBroadcastJoinThreshold=os.environ.get("BJT", "10485760"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    oracles, failed, total = oracle_sql(), [], 0.0
    for name, run in queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = compare(con, df, oracles[name])
            else:
                rows = df.collect()
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        seconds = time.time() - start
        total += seconds
        label = "ok" if problem is None else "BAD"
        mode = "sql" if name in oracles else "rows"
        print(f"{label:4}{mode:5}{seconds:6.1f}s {name} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} bad, {total:.0f}s: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
