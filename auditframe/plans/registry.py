"""Registry of named queries and the SQL each is compared with."""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Session settings the results (zone) and the skew handling (the rest) depend on.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
}

#: SQL text of the shared views, in dependency order.
SQL_VIEWS: dict[str, str] = {}


def sql_view(name: str, body: str) -> None:
    SQL_VIEWS[name] = body.strip()


def with_views(body: str) -> str:
    """Prefix a statement with the views it mentions, and those they mention."""
    needed: set[str] = set()
    text = body
    while True:
        found = {v for v in SQL_VIEWS if v not in needed and v in text}
        if not found:
            break
        needed |= found
        text = " ".join(SQL_VIEWS[v] for v in found)
    ctes = ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in SQL_VIEWS if v in needed)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:].strip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:].strip()}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL counterpart."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for key, value in RUNTIME.items():
                spark.conf.set(key, value)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def tree_sql(rows: str, keys: str = "", levels: int = 2, with_value: bool = True) -> str:
    """SQL of the digest trees over ``rows`` (keys, name, value): keys, leaves, root."""
    k = f"{keys}, " if keys else ""
    leaf = "sha256(place || sha256(v))" if with_value else "place"
    value = "coalesce('=' || value, '')" if with_value else "''"
    text = f"""SELECT {k}left(place, {levels}) AS prefix, sum(n) AS leaves, sha256('bucket' || string_agg(leaf || ':' || n, ',' ORDER BY place, leaf || ':' || n)) AS digest
  FROM (SELECT {k}place, {leaf} AS leaf, count(*) AS n FROM (SELECT {k}sha256(coalesce('=' || name, '')) AS place, {value} AS v FROM ({rows})) GROUP BY ALL) GROUP BY {k}prefix"""
    for level in range(levels - 1, -1, -1):
        text = f"""SELECT {k}left(p, {level}) AS prefix, sum(leaves) AS leaves, sha256('node' || string_agg(right(p, 1) || ':' || digest, ',' ORDER BY p)) AS digest
  FROM (SELECT * RENAME (prefix AS p) FROM ({text})) GROUP BY ALL"""
    return f"SELECT {k}CAST(leaves AS BIGINT) AS leaves, digest AS root FROM ({text})"
