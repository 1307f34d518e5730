"""Exports of several tables that become visible together.

The tables are written first, each to its own folder under the export's name; the manifest, with the number of rows and the
digest-tree root of every table, is written last, as one file, and is the commit. Readers start at the manifest: an export
that was killed before it is invisible, one that is run again replaces what the first left, and a table that is not what
the manifest says stops whoever reads it.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions import digest_tree
from auditframe.functions.canon import KEEP_NULLS
from auditframe.functions.ordered import union_all
from auditframe.operators.leak import refuse_if

MANIFEST = "name STRING, rows BIGINT, root STRING, schema STRING"


def table_root(df: DataFrame, levels: int = digest_tree.LEVELS) -> DataFrame:
    """leaves, root: the tree over the rows as canonical JSON, repeated rows counted."""
    return digest_tree.roots(df, F.to_json(F.struct(*sorted(df.columns)), KEEP_NULLS), levels=levels)


def _table(spark: SparkSession, target: str, export: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{target}/tables/{export}/{name}")


def write_export(tables: Mapping[str, DataFrame], target: str, export: str, levels: int = digest_tree.LEVELS) -> DataFrame:
    """Write the tables and commit; gives the manifest. A committed export is left as it is, whatever the tables hold now."""
    spark = next(iter(tables.values())).sparkSession
    done = manifest(spark, target, export)
    if done is not None:
        return done
    entries = []
    for name, df in tables.items():
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        df.write.mode("overwrite").parquet(f"{target}/tables/{export}/{name}")
        # The roots are those of what was written, not of what was to be written.
        root = table_root(_table(spark, target, export, name, ddl), levels)
        entries.append(root.select(F.lit(name).alias("name"), F.col("leaves").alias("rows"), "root", F.lit(ddl).alias("schema")))
    union_all(entries).coalesce(1).write.mode("overwrite").parquet(f"{target}/manifests/{export}")  # one row per table
    return manifest(spark, target, export)


def manifest(spark: SparkSession, target: str, export: str) -> DataFrame | None:
    """The manifest of a committed export, else None; a folder without its file is no commit."""
    try:
        found = spark.read.schema(MANIFEST).parquet(f"{target}/manifests/{export}")
        return None if found.isEmpty() else found
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _committed(spark: SparkSession, target: str, export: str) -> DataFrame:
    found = manifest(spark, target, export)
    if found is None:
        raise FileNotFoundError(f"export {export} is not committed")
    return found


def read_export(spark: SparkSession, target: str, export: str, name: str, levels: int = digest_tree.LEVELS) -> DataFrame:
    """A table of a committed export; reading any row fails when the table is not what the manifest lists."""
    listed = _committed(spark, target, export).where(F.col("name") == name).select("root", "schema").collect()  # one row per table
    if len(listed) != 1:
        raise KeyError(f"export {export} does not list {name}")
    df = _table(spark, target, export, name, listed[0]["schema"])
    differs = table_root(df, levels).select((F.col("root") != listed[0]["root"]).cast("int").alias("_differs"))
    return refuse_if(df, differs, "_differs", f"table {name} is not what the manifest of {export} lists")


def export_problems(spark: SparkSession, target: str, export: str, levels: int = digest_tree.LEVELS) -> DataFrame:
    """name, problem: tables of a committed export that are missing or differ from the manifest."""
    listed = _committed(spark, target, export)
    found = []
    for row in listed.collect():  # one row per table
        try:
            root = table_root(_table(spark, target, export, row["name"], row["schema"]), levels)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found.append(spark.range(1).select(F.lit(row["name"]).alias("name"), F.lit("missing").alias("problem")))
            continue
        found.append(root.where(F.col("root") != row["root"]).select(F.lit(row["name"]).alias("name"), F.lit("differs").alias("problem")))
    return union_all(found)
