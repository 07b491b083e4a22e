"""Compare a registered query with its DuckDB twin. Run as a script for all or the named ones."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of_spark(df) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(df.columns)
    table = df.select(*(df[f"`{name}`"] for name in names)).toArrow()
    return names, [str(t) for t in table.schema.types], _rows(table)


def rows_of_duckdb(con, sql) -> tuple[list[str], list[str], list[tuple]]:
    table = con.sql(sql).to_arrow_table()
    table = table.select(sorted(table.column_names))
    return table.column_names, [str(t) for t in table.schema.types], _rows(table)


def _rows(table) -> list[tuple]:
    columns = [column.to_pylist() for column in table.columns]
    return sorted(zip(*columns), key=repr)


def difference(spark, con, folder, run, sql) -> str | None:
    """What differs between the two results, or None."""
    names, types, rows = rows_of_spark(run(spark, folder))
    sql_names, sql_types, sql_rows = rows_of_duckdb(con, sql)
    if names != sql_names:
        return f"columns {names} against {sql_names}"
    same = {"large_string": "string"}
    if [same.get(t, t) for t in types] != [same.get(t, t) for t in sql_types]:
        return f"types {types} against {sql_types}"
    if len(rows) != len(sql_rows):
        return f"{len(rows)} rows against {len(sql_rows)}"
    if not rows:
        return "no rows at all"
    for mine, theirs in zip(rows, sql_rows):
        if mine != theirs:
            return f"{str(mine)[:300]} against {str(theirs)[:300]}"
    return None


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con, bad = session(), connect(folder), 0
    queries, twins = entry.queries(), entry.oracle_sql()
    for name in wanted or queries:
        start = time.time()
        try:
            if name in twins:
                found = difference(spark, con, folder, queries[name], twins[name])
            else:
                found = None if queries[name](spark, folder).collect() else "no rows at all"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.2f}s {found or ''}", flush=True)
    from pairloom.storage import release

    release(spark)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
