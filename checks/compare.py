"""Run a query in Spark and its SQL in DuckDB and compare columns, row count and values."""

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import SQL
from checks.queries import JOBS, bound

GIVEN = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((value is None, "" if value is None else str(value)) for value in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, folder: str, name: str) -> tuple[int, list]:
    """Row count and the first differences (empty when equal)."""
    df = bound(name)(spark, folder)
    columns = sorted(df.columns)
    mine = sorted((tuple(row) for row in df.select(*(f"`{c}`" for c in columns)).collect()), key=_key)
    found = con.sql(SQL[name])
    if sorted(found.columns) != columns:
        return len(mine), [("columns", columns, sorted(found.columns))]
    quoted = ", ".join('"' + c.replace('"', '""') + '"' for c in columns)
    other = sorted(con.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall(), key=_key)
    if len(mine) != len(other):
        return len(mine), [("rows", len(mine), len(other)), mine[:2], other[:2]]
    different = [(a, b) for a, b in zip(mine, other) if not all(map(_same, a, b))]
    return len(mine), ([("values", len(different)), columns] + different[:2] if different else [])


def main(folder: str, names: list[str]) -> None:
    from arqueo.session import local_session

    spark, con = local_session("compare"), connect(folder)
    for name in names or list(JOBS):
        if name not in SQL:
            print(f"{name:34s} no sql", flush=True)
            continue
        start = time.time()
        try:
            rows, problems = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            rows, problems = -1, [str(error)[:900]]
        print(f"{name:34s} {'ok' if not problems else 'DIFF'} rows={rows} {time.time() - start:.1f}s", flush=True)
        for problem in problems:
            print("    ", problem, flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
