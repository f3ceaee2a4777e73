"""Side-by-side check of a Spark query and its SQL. As a script: python tests/compare.py SF_DIR [name-part ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime) and value.tzinfo:
        return value.replace(tzinfo=None)
    return value


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def differences(df, con, sql: str, need_rows: bool = False) -> list[str]:
    names = sorted(df.columns)
    got = [tuple(plain(row[n]) for n in names) for row in df.collect()]
    result = con.execute(sql)
    sql_names = [d[0] for d in result.description]
    sql_types = {d[0]: str(d[1]) for d in result.description}
    if sorted(sql_names) != names:
        return [f"columns {names} vs {sorted(sql_names)}"]
    want = [tuple(plain(row[sql_names.index(n)]) for n in names) for row in result.fetchall()]
    found = ["no rows"] if need_rows and not want else []
    for f in df.schema.fields:
        expected = KINDS.get(f.dataType.simpleString())
        if expected and expected != sql_types[f.name]:
            found.append(f"type {f.name}: {f.dataType.simpleString()} vs {sql_types[f.name]}")
    if len(got) != len(want):
        found.append(f"rows {len(got)} vs {len(want)}")
    a, b = sorted(got, key=repr), sorted(want, key=repr)
    bad = [(x, y) for x, y in zip(a, b) if x != y or repr(x) != repr(y)]
    if bad:
        found.append(f"{len(bad)} rows differ in {names}, first: {bad[0][0]} vs {bad[0][1]}")
    return found


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from prismill.session import build_session

    folder, parts = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": os.environ.get("SHUFFLE", "8"), "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, sqls = duck(folder), oracle_sql()
    failed = 0
    for name, build in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            problems = differences(df, con, sqls[name], need_rows=True) if name in sqls else [] if df.collect() else ["no rows"]
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        failed += bool(problems)
        print(f"{'ok  ' if not problems else 'FAIL'} {name} {time.time() - start:.2f}s {'' if name in sqls else '(rows only)'}", *problems, sep="\n     " if problems else " ", flush=True)
    print("failed:", failed)
