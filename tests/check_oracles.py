"""Run every query against its DuckDB oracle: ``python tests/check_oracles.py [dir]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


# Spark and DuckDB names of the types the results have.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def spark_result(df):
    names = sorted(df.columns)
    types = dict(df.dtypes)
    rows = sorted(tuple(r) for r in df.select(*names).collect())
    return [(n, TYPES[types[n]]) for n in names], rows


def duckdb_result(con, sql: str):
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    names = sorted(described)
    picked = ", ".join(f'"{n}"' for n in names)
    rows = sorted(con.execute(f"SELECT {picked} FROM ({sql})").fetchall())
    return [(n, described[n]) for n in names], rows


def main() -> int:
    import __spark_entry__ as contract
    from rankforge.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "check-oracles",
        {
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = contract.oracle_sql()
    bad = 0
    for name, query in contract.queries().items():
        start = time.time()
        schema, rows = spark_result(query(spark, sf_dir))
        took = time.time() - start
        if name in oracles:
            want_schema, want_rows = duckdb_result(con, oracles[name])
            ok = schema == want_schema and rows == want_rows
            verdict = "equal" if ok else f"DIFFERS {want_schema} {len(want_rows)} {want_rows[:2]} {rows[:2]}"
        else:
            ok, verdict = bool(rows), "rows only"
        bad += not ok
        print(f"{name:34s} {len(rows):8d} rows {took:7.2f}s  {verdict}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
