"""Manifests of files: building, comparing, reproducibility."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import digest_tree
from auditframe.session import materialise


def asset_value() -> Column:
    """What a manifest says of a path."""
    return F.concat_ws("|", F.col("bytes").cast("string"), "sha256")


def manifest_tree(assets: DataFrame, levels: int = digest_tree.LEVELS) -> list[DataFrame]:
    """The digest tree over (path, bytes, sha256), for roots, inclusion proofs and comparisons."""
    return digest_tree.tree(assets, F.col("path"), asset_value(), levels=levels)


def manifest_summary(assets: DataFrame, levels: int = digest_tree.LEVELS) -> DataFrame:
    """One row: number of files, bytes, and the root of their digest tree."""
    sizes = assets.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    root = manifest_tree(assets, levels)[0].select(F.col("digest").alias("root"))
    return sizes.crossJoin(F.broadcast(root))  # one row each


def listed_assets(claims: DataFrame, assets: DataFrame, levels: int = digest_tree.LEVELS) -> DataFrame:
    """Claimed assets (path, bytes, sha256) with whether the manifest's tree proves them."""
    nodes = manifest_tree(materialise(assets.select("path", "bytes", "sha256")), levels)
    wanted = claims.select(F.col("path").alias("name"), asset_value().alias("value"))
    checked = digest_tree.verify_many(nodes, wanted)
    published = nodes[0].select(F.col("digest").alias("_published"))
    fits = checked.crossJoin(F.broadcast(published)).select(F.col("name").alias("path"), F.col("value").alias("_value"), (F.col("holds") & (F.col("root") == F.col("_published"))).alias("_ok"))
    known = claims.withColumn("_value", asset_value()).join(fits, ["path", "_value"], "left")
    return known.withColumn("listed", F.coalesce("_ok", F.lit(False))).drop("_value", "_ok")


def manifest_problems(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Paths that are missing, unlisted, listed twice, or differ in size or hash."""
    listed = manifest.groupBy("path").agg(
        F.count("*").alias("_n"), F.min(F.struct("bytes", "sha256")).alias("_m")
    )
    there = actual.select("path", F.struct("bytes", "sha256").alias("_a"))
    reasons = F.array_compact(F.array(
        F.when(F.col("_a").isNull(), "missing"),
        F.when(F.col("_m").isNull(), "unlisted"),
        F.when(F.col("_n") > 1, "duplicate"),
        F.when(F.col("_m.bytes") != F.col("_a.bytes"), "size differs"),
        F.when(F.col("_m.sha256") != F.col("_a.sha256"), "hash differs"),
    ))
    return listed.join(there, "path", "full_outer").select("path", F.explode(reasons).alias("reason"))


def reproducibility_problems(first: DataFrame, second: DataFrame) -> DataFrame:
    """Files of two runs of one configuration that are not byte-equal."""
    a, b = first.select("path", F.col("sha256").alias("_a")), second.select("path", F.col("sha256").alias("_b"))
    both = a.join(b, "path", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select("path", F.when(F.col("_b").isNull(), "only first").when(F.col("_a").isNull(), "only second").otherwise("differs").alias("problem"))
