"""Run registered queries beside their SQL and compare the rows, order aside.

Usage: python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftline")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            files = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def normal(value):
    return None if value is None or value != value else value


def row_set(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    """Empty text if equal, else what differs; also the seconds Spark took."""
    start = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return ("" if got else "no rows"), seconds, len(got)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}", seconds, len(got)
    spark_types = dict(df.dtypes)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for d in cursor.description:
        if kinds.get(spark_types[d[0]]) != str(d[1]):
            return f"type of {d[0]}: {spark_types[d[0]]} / {d[1]}", seconds, len(got)
    a, b = row_set(df.columns, got), row_set(columns, expected)
    if a == b:
        return "", seconds, len(got)
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return f"rows {len(a)} / {len(b)}\n   spark {only_a}\n   sql   {only_b}", seconds, len(got)


def main() -> int:
    import __spark_entry__ as contract

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = contract.queries(), contract.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = session(), duck(sf_dir)
    failures = 0
    for name in names:
        try:
            problem, seconds, rows = compare(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as error:  # report and go on with the others
            problem, seconds, rows = f"{type(error).__name__}: {str(error)[:600]}", 0.0, 0
        failures += bool(problem)
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if not problem else 'FAIL'} {name:28s} {kind:4s} {rows:6d} rows {seconds:6.2f}s {problem}", flush=True)
    print(f"{len(names) - failures} of {len(names)} agree")
    spark.stop()
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
