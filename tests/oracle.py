"""Runs registered queries against their SQL counterparts in DuckDB.

    python -m tests.oracle [sf] [name ...]
"""
from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
DATA = "/root/testdata/sf{}"


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, Decimal):
        value = float(value) if value != value.to_integral_value() else int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return str(value) if not isinstance(value, int) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


SPARK_SECONDS: dict[str, float] = {}

FAMILY = {
    "BIGINT": "int", "INTEGER": "int", "HUGEINT": "huge", "VARCHAR": "str", "BOOLEAN": "bool", "DOUBLE": "float",
    "bigint": "int", "int": "int", "string": "str", "boolean": "bool", "double": "float",
}


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when equal, else what differs."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    SPARK_SECONDS[name] = time.time() - start
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    duck = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    for column, kind in df.dtypes:
        if FAMILY.get(kind, kind) != FAMILY.get(duck[column], duck[column]):
            return f"type of {column}: {kind} against {duck[column]}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; first {[r for r in got if r not in want][:2]} / {[r for r in want if r not in got][:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} against {w}"
    return None if got else "no rows"


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from auditframe.session import build_session

    sf = argv[0] if argv else "0.01"
    names = argv[1:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(DATA.format(sf))
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, fn, entry.oracle_sql().get(name), DATA.format(sf))
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} {SPARK_SECONDS.get(name, 0):.1f}s of {time.time() - start:.1f}s {'' if name in entry.oracle_sql() else '(rows only) '}{problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
