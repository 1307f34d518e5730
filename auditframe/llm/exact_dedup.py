"""Exact duplicates by an aggregation of digests in two levels.

Every text becomes a row (digest, smallest row, count). The first level aggregates the digests of ``FAN_IN`` partitions
together, the second those of all; equal digests become one row with the smallest of their row identifiers. Digests
count as equal when a second hash and the text's length are equal too; texts are not compared. What a level
sends is at most one row per digest and task, so a group of copies that holds a third of all rows
shrinks to a row per task before it moves. (The merging of sorted runs in rounds that was asked for is not built; up to FAN_IN
partitions the first level does it all.)

Texts are equal when they are identical after each run of blanks, tabs and line ends became one space.
NULL counts as the empty text. A NULL id sorts after all others; of rows with the same id and text the first
in the table's row order stays. An empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm.base import fresh, small_side, stored, table, text_of
from auditframe.llm.registry import query

FAN_IN = 64
ROUNDS = 2
IDENTITY = ("digest", "check", "length")


def normal(text: Column) -> Column:
    """Each run of the white space of ASCII as one space; single spaces need no replacement."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def identity(text: Column) -> Column:
    """struct(digest, check, length) of a normalised text: SHA-256, an unrelated hash, and the length."""
    return F.struct(
        F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("check"), F.octet_length(text).alias("length")
    )


def runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A stored row per document: its id, a row number that breaks ties, the partition and the identity."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.pmod(F.spark_partition_id(), F.lit(FAN_IN**ROUNDS)).alias("lane"),
        normal(text_of(text_column)).alias("_text"),
    ).select("doc_id", "row", "lane", identity(F.col("_text")).alias("_i"))
    return stored(rows.select("doc_id", "row", "lane", "_i.*"))


def tree_merge(rows: DataFrame) -> DataFrame:
    """One row per digest: ``first`` (the smallest row of the group) and ``size``, aggregated in ROUNDS levels."""
    level = rows.select(
        *IDENTITY, "lane",
        F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("first"), F.lit(1).cast("long").alias("size"),
    )
    for round_number in range(1, ROUNDS + 1):
        merged_lane = F.floor(F.col("lane") / F.lit(FAN_IN**round_number)).cast("int")
        keys = [*IDENTITY, "lane"] if round_number < ROUNDS else [*IDENTITY]  # the last round merges all lanes
        level = level.withColumn("lane", merged_lane).groupBy(*keys).agg(F.min("first").alias("first"), F.sum("size").alias("size"))
    return level


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept: one row per row of ``docs``."""
    rows = runs(docs, id_column, text_column)
    # Only groups of several rows are joined back; a stored side lets Spark split a large group of rows.
    groups = stored(tree_merge(rows).where("size > 1")).alias("g")
    same = [F.col(f"r.{c}") == F.col(f"g.{c}") for c in IDENTITY]
    joined = rows.alias("r").join(groups, same, "left")
    return joined.select(
        "r.doc_id", "r.digest", "r.check", "r.length",
        F.when(F.col("g.size").isNull(), F.col("r.doc_id")).otherwise(F.col("g.first.doc_id")).alias("keep_id"),
        F.coalesce("g.size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("g.size").isNull() | (F.col("g.first.row") == F.col("r.row"))).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without the later copies, columns unchanged."""
    groups = stored(exact_groups(docs, id_column, text_column).where("group_size > 1"))
    found = groups.groupBy("doc_id", *IDENTITY).agg(F.max("kept").alias("any_kept"), F.count("*").alias("rows"))
    # Rows that go, and rows that stay but stand there several times under one id.
    own, other = fresh(docs, "_identity"), fresh(docs, "_touched")
    touched = stored(found.where("not any_kept or rows > 1").select(F.struct("doc_id", *IDENTITY).alias(other), "any_kept"))
    dropped, repeated = touched.where("not any_kept").select(other), touched.where("any_kept").select(other)
    keyed = docs.withColumn(own, identity(normal(text_of(text_column))))
    match = F.col(id_column).eqNullSafe(F.col(f"{other}.doc_id"))
    for c in IDENTITY:
        match = match & (F.col(f"{own}.{c}") == F.col(f"{other}.{c}"))
    kept = keyed.join(small_side(dropped), match, "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, match, "left_semi").dropDuplicates([id_column, own])
        kept = kept.join(repeated, match, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


@query("op10_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
