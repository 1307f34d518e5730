"""Ordered computations that do not put a whole key into one task.

A plain window keeps every row of a key in one task.  Here each key is cut into
chunks of its integer order column; the window runs inside a chunk, and what has
to cross a chunk border travels through a table with one row per chunk, which is up to
a million times smaller than a large key.  Both sides of the join back are hashed on
(keys, chunk), so the data itself is shuffled once.

Keys must be non-null and the order column unique within its key.  By default the order is a dense
integer and ``size`` the width of a chunk in order values.  ``ranged`` prepares rows for any order that Spark can
sort (texts, sparse numbers, structs): the functions then use the ranges it made as chunks.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.session import materialise

# Width of a chunk in order values: at most about a million rows, which one task sorts easily.
CHUNK = 1 << 20


def with_chunks(df: DataFrame, order: str, size: int = CHUNK) -> DataFrame:
    """Add the chunk column, which the functions below then use and keep.

    Steps over the same keys and order that share it also share one shuffle.
    """
    return df.withColumn("_chunk", F.expr(f"`{order}` div {int(size)}"))


def ranged(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows, stored in ranges of (keys, order) of about equal size, with the range's number as chunk column.

    Ranges follow the order, so they serve as chunks whatever the order column is; a key of any length is cut where a range
    ends. Spark samples ``df`` for the borders, so it is evaluated twice: store what is dear first.
    """
    return materialise(df.repartitionByRange(*keys, order).withColumn("_chunk", F.spark_partition_id()))


def _chunked(df: DataFrame, keys: Sequence[str], order: str, size: int):
    with_chunk = df if "_chunk" in df.columns else with_chunks(df, order, size)
    chunk_keys = [*keys, "_chunk"]
    inside = Window.partitionBy(*chunk_keys).orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    return with_chunk, chunk_keys, inside, across


def _added(df: DataFrame) -> list[str]:
    return [] if "_chunk" in df.columns else ["_chunk"]


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    *,
    back: bool = False,
    size: int = CHUNK,
) -> DataFrame:
    """Add ``value`` of the next row (or previous, with ``back``) of the same key."""
    data, chunk_keys, inside, across = _chunked(df, keys, order, size)
    shift, edge = (F.lag, F.max_by) if back else (F.lead, F.min_by)
    # The one-field struct tells "neighbour with a NULL value" from "no neighbour".
    data = data.withColumn("_own", F.struct(value.alias("v")))
    edges = (
        data.groupBy(*chunk_keys)
        .agg(edge("_own", order).alias("_edge"))
        .select(*chunk_keys, shift("_edge").over(across).alias("_far"))
    )
    return (
        data.withColumn("_near", shift("_own").over(inside))
        .join(edges, chunk_keys, "left")
        .withColumn(name, F.coalesce("_near", "_far").getField("v"))
        .drop("_own", "_near", "_far", *_added(df))
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    *,
    size: int = CHUNK,
    totals: str | None = None,
) -> DataFrame:
    """Add inclusive running sums per key, named by ``sums``; ``totals`` names the key's total of the first sum."""
    data, chunk_keys, inside, across = _chunked(df, keys, order, size)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    names = list(sums)
    for name in names:
        data = data.withColumn(f"_x_{name}", sums[name])
    chunks = data.groupBy(*chunk_keys).agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in names])
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chunks = chunks.select(
        *chunk_keys, *[F.sum(f"_t_{n}").over(before).alias(f"_b_{n}") for n in names],
        *([F.sum(f"_t_{names[0]}").over(whole).alias(totals)] if totals else []),
    )
    data = data.select(
        "*", *[F.sum(f"_x_{n}").over(upto).alias(f"_r_{n}") for n in names]
    ).join(chunks, chunk_keys, "left")
    for name in names:
        data = data.withColumn(
            name, F.coalesce(f"_r_{name}", F.lit(0)) + F.coalesce(f"_b_{name}", F.lit(0))
        )
    return data.drop(*_added(df), *[f"_{p}_{n}" for n in names for p in ("x", "r", "b")])


def positions(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "pos", *, size: int = CHUNK
) -> DataFrame:
    """Add the 1-based position of each row within its key (keys may be empty)."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")}, size=size)


def carried(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column], *, size: int = CHUNK) -> DataFrame:
    """Add, per name, the last value that is not NULL at or before each row of the same key."""
    data, chunk_keys, inside, across = _chunked(df, keys, order, size)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    names = list(values)
    data = data.select("*", *[values[n].alias(f"_v_{n}") for n in names])
    latest_of = [F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(order, F.col(f"_v_{n}").alias("v")))).alias(f"_t_{n}") for n in names]
    ends = data.groupBy(*chunk_keys).agg(*latest_of)
    ends = ends.select(*chunk_keys, *[F.last(f"_t_{n}.v", ignorenulls=True).over(before).alias(f"_b_{n}") for n in names])
    data = data.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(upto).alias(f"_r_{n}") for n in names]).join(ends, chunk_keys, "left")
    data = data.select("*", *[F.coalesce(f"_r_{n}", f"_b_{n}").alias(n) for n in names])
    return data.drop(*_added(df), *[f"_{p}_{n}" for n in names for p in ("v", "r", "b")])


def latest(df: DataFrame, keys: Sequence[str], order: Column | str, *keep: str) -> DataFrame:
    """One row per key: the one with the greatest ``order``; combines before the shuffle."""
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*keep), order).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in keep])
    )


def earliest(df: DataFrame, keys: Sequence[str], order: Column | str, *keep: str) -> DataFrame:
    """One row per key: the one with the smallest ``order``."""
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*keep), order).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in keep])
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name as a balanced tree, which keeps plan analysis short."""
    if len(parts) == 1:
        return parts[0]
    middle = len(parts) // 2
    return union_all(parts[:middle]).unionByName(union_all(parts[middle:]))
