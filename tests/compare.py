"""Run queries against their SQL in DuckDB and compare all rows.

Usage: python tests/compare.py [sf_dir] [name part ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connection(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{directory}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def family(kind: str) -> str:
    kind = kind.lower()
    for name, words in {
        "int": ("bigint", "int", "long", "short", "byte", "hugeint", "ubigint", "tinyint"),
        "double": ("double", "float"),
        "string": ("varchar", "string"),
        "bool": ("bool",),
    }.items():
        if any(kind.startswith(w) for w in words):
            return name
    return kind.split("(")[0]


def difference(frame, con, sql: str) -> str | None:
    """None if rows, names and kinds of columns agree, else what differs."""
    relation = con.sql(sql)
    names = sorted(frame.columns)
    if names != sorted(relation.columns):
        return f"columns {names} != {sorted(relation.columns)}"
    kinds = dict(zip(relation.columns, relation.types))
    for field in frame.schema:
        if family(field.dataType.simpleString()) != family(str(kinds[field.name])):
            return f"type of {field.name}: {field.dataType.simpleString()} != {kinds[field.name]}"
    mine = sorted((repr(tuple(plain(row[n]) for n in names)) for row in frame.collect()))
    positions = [relation.columns.index(n) for n in names]
    other = sorted((repr(tuple(plain(row[i]) for i in positions)) for row in relation.fetchall()))
    if mine == other:
        return None
    a, b = set(mine), set(other)
    return (
        f"{len(mine)} rows != {len(other)} rows; only here {[x[:400] for x in sorted(a - b)[:3]]}; "
        f"only in SQL {[x[:400] for x in sorted(b - a)[:3]]}"
    )


def main() -> int:
    import __spark_entry__ as e
    from larkspan.session import build_session

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connection(directory), e.oracle_sql(), 0
    for name, run in e.queries().items():
        if parts and not any(name == p or name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            frame = run(spark, directory)
            if name in sql:
                found = difference(frame, con, sql[name])
                verdict = "ok" if found is None else "DIFF " + found
            else:
                verdict = f"rows {frame.count()}"
        except Exception as error:  # noqa: BLE001
            verdict = "FAIL " + str(error)[:1500]
        bad += verdict.startswith(("DIFF", "FAIL"))
        print(f"{time.time() - start:6.2f}s {name}: {verdict}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 99))
