"""Compare registered queries with DuckDB on the same parquet tables.

``python tests/oracle.py [sf_dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else repr(0.0 if number == 0 else number)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


def canonical(names, rows):
    places = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([str([plain(row[i]) for i in places]) for row in rows])


def compare(df, connection, sql) -> tuple[bool, str]:
    spark_names = df.columns
    spark_rows = canonical(spark_names, df.collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    rows = canonical(names, result.fetchall())
    if sorted(names) != sorted(spark_names):
        return False, f"columns {sorted(spark_names)} != {sorted(names)}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck = {d[0]: str(d[1]).lower() for d in result.description}
    expected = {"bigint": "bigint", "int": "integer", "string": "varchar", "double": "double", "boolean": "boolean"}
    differ = {n: (kinds[n], duck[n]) for n in names if expected.get(kinds[n], "?") != duck[n]}
    note = f" types {differ}" if differ else ""
    if spark_rows != rows:
        only_spark = sorted(set(spark_rows) - set(rows))[:2]
        only_duck = sorted(set(rows) - set(spark_rows))[:2]
        return False, f"{len(spark_rows)} vs {len(rows)} rows\n   spark {only_spark}\n   duck  {only_duck}{note}"
    return True, f"{len(rows)} rows{note}"


def main() -> int:
    from custlytics.plans.registry import all_queries
    from custlytics.session import create_spark_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = create_spark_session(
        "oracle",
        master="local[8]",
        settings={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                  "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name, query in all_queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if query.oracle is None:
                ok, note = True, f"{len(query.plan(spark, sf_dir).collect())} rows, no SQL"
            else:
                ok, note = compare(query.plan(spark, sf_dir), connection, query.oracle)
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
