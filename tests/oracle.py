"""Runs queries in Spark and their SQL in DuckDB and compares names, types and values.

Also refuses plans that cross tables.
"""

from __future__ import annotations

import contextlib
import datetime
import io
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_FAMILY = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int", "double": "float",
    "float": "float", "string": "text", "varchar": "text", "boolean": "bool", "timestamp": "time",
    "timestamp_ntz": "time",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=repr)


def plan_text(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def compare(spark, con, folder: str, name: str, fn, sql: str | None) -> list[str]:
    df = fn(spark, folder)
    names = df.columns
    ours = _rows(names, df.collect())
    crossing = [w for w in ("NestedLoopJoin", "CartesianProduct") if w in plan_text(df)]
    if crossing:
        return [f"{name}: the plan holds {crossing[0]}"]
    if sql is None:
        return [] if ours else [f"{name}: no rows"]
    cursor = con.execute(sql)
    described = [(c[0], str(c[1]).lower()) for c in cursor.description]
    theirs = _rows([n for n, _ in described], cursor.fetchall())
    problems = []
    if sorted(names) != sorted(n for n, _ in described):
        problems.append(f"{name}: columns {sorted(names)} against {sorted(n for n, _ in described)}")
        return problems
    kinds = dict(described)
    for field in df.schema:
        mine, other = field.dataType.simpleString(), kinds[field.name]
        other = {"number": other, "datetime": "timestamp"}.get(other, other)
        if _FAMILY.get(mine, mine) != _FAMILY.get(other, other):
            problems.append(f"{name}: column {field.name} is {mine} against {other}")
    if len(ours) != len(theirs):
        problems.append(f"{name}: {len(ours)} rows against {len(theirs)}")
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        problems.append(f"{name}: {len(different)} rows differ, first {different[0]}")
    return problems


def main(folder: str, wanted: list[str]) -> int:
    from tests.conftest import make_session

    import __spark_entry__ as entry

    spark, con = make_session(), connect(folder)
    failed = 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problems = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as exc:  # noqa: BLE001
            problems = [f"{name}: {type(exc).__name__} {str(exc)[:1500]}"]
        failed += bool(problems)
        took = time.time() - start
        print(f"{'FAIL' if problems else 'ok  '} {name} {took:.1f}s" + ("" if name in sqls else " (rows only)"), flush=True)
        for p in problems:
            print("     ", p[:1500], flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
