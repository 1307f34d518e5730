"""Incremental forms of the panel summary, request de-duplication and conflicts, and version checks."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files landing in a folder (or matching a path with a star), as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What was written under a path; an empty frame when nothing was."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_available(stream: DataFrame, mode: str, target: str) -> DataFrame:
    """Process what has arrived, write results under ``target`` and read them back (nothing, when no file has arrived yet).

    In complete mode a batch replaces the earlier result; in append mode each batch is
    its own folder, replaced when the batch is run again after a failure.
    """
    def keep(batch: DataFrame, number: int) -> None:
        place = f"{target}/data/batch=0" if mode == "complete" else f"{target}/data/batch={number}"
        batch.write.mode("overwrite").parquet(place)

    _run(stream, keep, mode, target)
    return read_or_empty(stream.sparkSession, f"{target}/data", stream.schema).select(*stream.columns)


def _run(stream: DataFrame, keep, mode: str, target: str) -> None:
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True).foreachBatch(keep).start()
    )
    query.awaitTermination()


def progress(records: DataFrame) -> DataFrame:
    """Running summary per model of records as they land (output mode complete)."""
    return records.groupBy("model").agg(
        F.count("*").alias("recorded"),
        F.count_if("complete").alias("complete"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def first_requests(requests: DataFrame, delay: str) -> DataFrame:
    """Requests without repeats of (case_id, request_id) that arrive within ``delay``."""
    return requests.withWatermark("at", delay).dropDuplicatesWithinWatermark(["case_id", "request_id"])


def request_sessions(requests: DataFrame, delay: str) -> DataFrame:
    """One row per run of uses of a request id, with the first payload and whether a later use disagrees with it.

    requests: case_id, request_id, pos, payload, at (event time). Uses less than ``delay`` apart are one run, in whatever
    order and in however many batches they arrive; the first is the earliest by (at, pos). A run is given out, and its state freed,
    when the event time has passed its last use by twice the delay; the state of a run is one row, however
    many uses it has. Uses that arrive later than that are left out (Spark counts them in the query's progress).
    """
    seen = requests.withWatermark("at", delay).groupBy(F.session_window("at", delay), "case_id", "request_id").agg(
        F.min_by(F.struct("payload"), F.struct("at", "pos")).alias("_first"), F.count("*").alias("uses"), F.count("payload").alias("_known"),
        F.min("payload").alias("_least"), F.max("payload").alias("_most"),
    )
    mixed = ~F.col("_least").eqNullSafe(F.col("_most")) | ~F.col("_known").isin(0) & (F.col("_known") != F.col("uses"))
    return seen.select("case_id", "request_id", F.col("session_window.start").alias("first_at"), F.col("_first.payload").alias("payload"), "uses", mixed.alias("conflict"))


def _in_order(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Judges rows that come sorted by object and position; what it holds between batches is one object's version."""
    key, version = None, 0
    for rows in batches:
        fits, versions = [], []
        for case, thing, asserted, start in zip(rows["case_id"], rows["object_id"], rows["asserted_version"], rows["start"]):
            if (case, thing) != key:
                key, version = (case, thing), int(start)
            fits.append(asserted == version)
            version += fits[-1]
            versions.append(version)
        yield pd.DataFrame({
            "case_id": rows["case_id"], "object_id": rows["object_id"], "pos": rows["pos"], "accepted": fits,
            "category": [None if fit else "stale_version" for fit in fits], "version": versions,
        })


def version_checks(requests: DataFrame, target: str) -> DataFrame:
    """Optimistic concurrency over a stream: a request is accepted when it asserts the
    object's current version, which it then raises by one; otherwise it is stale.

    requests: case_id, object_id (both of any type), pos, asserted_version. Processes what has arrived and gives all verdicts so far:
    case_id, object_id, pos, accepted, category, version. Rows of one micro-batch are sorted by Spark and taken in order of
    pos; a task goes through them with one number in hand. What a batch leaves, one row per object it met, is
    written beside its verdicts, both replaced when the batch is run again; the current version is the greatest one.
    """
    spark, keys = requests.sparkSession, ["case_id", "object_id"]
    kinds = {k: requests.schema[k].dataType.simpleString() for k in keys}
    schema = T.StructType.fromDDL(f"case_id {kinds['case_id']}, object_id {kinds['object_id']}, pos BIGINT, accepted BOOLEAN, category STRING, version BIGINT")
    left = T.StructType([*schema.fields[:2], schema.fields[5], T.StructField("batch", T.LongType())])

    def keep(batch: DataFrame, number: int) -> None:
        before = read_or_empty(spark, f"{target}/versions", left).where(F.col("batch") < number).groupBy(*keys).agg(F.max("version").alias("start"))
        rows = batch.join(before, keys, "left").select(*keys, F.col("pos").cast("long").alias("pos"), "asserted_version", F.coalesce("start", F.lit(0)).alias("start"))
        judged = rows.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInPandas(_in_order, schema)
        judged.write.mode("overwrite").parquet(f"{target}/data/batch={number}")
        done = spark.read.schema(schema).parquet(f"{target}/data/batch={number}")
        done.groupBy(*keys).agg(F.max("version").alias("version")).write.mode("overwrite").parquet(f"{target}/versions/batch={number}")

    _run(requests, keep, "append", target)
    return read_or_empty(spark, f"{target}/data", schema).select(*schema.names)
