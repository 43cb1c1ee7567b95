"""Compare every query with its DuckDB SQL: names, types, row counts and values.

Run directly for a report: ``python tests/oracle_check.py /root/testdata/sf0.01 [query ...]``.
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def _key(value) -> tuple:
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, datetime.date):
        return (1, value.isoformat())
    return (1, repr(value))


def _rows(rows, columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    duck_types = {c[0]: str(c[1]) for c in result.description}
    duck_rows = result.fetchall()
    duck_columns = list(duck_types)
    spark_types = {n: SPARK_TYPES.get(t, t) for n, t in spark_df.dtypes}
    found = []
    names = {c: str(t) for c, t in zip(duck_columns, [c[1] for c in con.execute(f"DESCRIBE {sql}").fetchall()])}
    if sorted(spark_types.items()) != sorted(names.items()):
        found.append(f"types {sorted(set(spark_types.items()) ^ set(names.items()))}")
    spark_rows = [tuple(r) for r in spark_df.collect()]
    if len(spark_rows) != len(duck_rows):
        found.append(f"rows {len(spark_rows)} != {len(duck_rows)}")
    if sorted(spark_types) == sorted(duck_columns):
        a, b = _rows(spark_rows, spark_df.columns), _rows(duck_rows, duck_columns)
        if a != b:
            only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
            found.append(f"values {len(only_a)}/{len(only_b)}: {only_a[:2]} | {only_b[:2]}")
    return found


def main() -> int:
    from goalweave.plans.oracle import oracle_sql
    from goalweave.plans.queries import QUERIES
    from goalweave.session import local_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark, con, sqls = local_session(), connect(sf_dir), oracle_sql()
    bad = 0
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            found = differences(fn(spark, sf_dir), con, sqls[name]) if name in sqls else ["no SQL"]
        except Exception as error:  # noqa: BLE001 - a report, the next query still runs
            found = [f"{type(error).__name__}: {str(error)[:700]}"]
        bad += bool(found and found != ["no SQL"])
        print(f"{'ok  ' if not found else 'DIFF'} {name} {time.time() - start:.1f}s {'; '.join(found)}", flush=True)
    print("differing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
