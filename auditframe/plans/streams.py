"""Streaming queries, run over what is there and compared with their batch meaning."""
from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.functions.canon import cents
from auditframe.functions.ordered import running_sums
from auditframe.plans.evidence import fresh
from auditframe.plans.registry import query
from auditframe.plans.strategy import k_of, load
from auditframe.streaming import jobs as J


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return J.read_stream(spark, f"{sf}/events.parquet*", schema)


@query(
    "progress_stream",
    """SELECT 'm' || (event_id % 4) AS model, count(*) AS recorded, count(*) FILTER (event_type <> 'error') AS complete, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS output_tokens
FROM events GROUP BY 1""",
)
def progress_stream(spark, sf):
    records = event_stream(spark, sf).select(
        F.concat(F.lit("m"), F.col("event_id") % 4).alias("model"), (F.col("event_type") != "error").alias("complete"), cents(F.col("value")).alias("output_tokens")
    )
    return J.run_available(J.progress(records), "complete", fresh(spark, "progress"))


@query("dedup_stream", "SELECT DISTINCT user_id AS case_id, k AS request_id FROM v_ev")
def dedup_stream(spark, sf):
    requests = event_stream(spark, sf).select(
        F.col("user_id").alias("case_id"), k_of(F.col("props")).alias("request_id"), F.col("ts").cast("timestamp").alias("at")
    )
    # The events span a month: within it every repeat is dropped, and what is older is forgotten.
    return J.run_available(J.first_requests(requests, "31 days"), "append", fresh(spark, "dedup")).select("case_id", "request_id")


@query(
    "request_sessions_stream",
    """SELECT case_id, request_id, epoch_us(min(ts)) AS first_us, arg_min(event_type, ts) AS payload, count(*) AS uses, count(DISTINCT event_type) > 1 AS conflict FROM (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 12 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, request_id ORDER BY ts) AS run FROM (
    SELECT user_id AS case_id, k % 10 AS request_id, ts, event_type, ts - lag(ts) OVER (PARTITION BY user_id, k % 10 ORDER BY ts) AS gap FROM v_ev))
GROUP BY case_id, request_id, run HAVING max(ts) + INTERVAL 24 HOURS <= (SELECT max(ts) FROM events)""",
)
def request_sessions_stream(spark, sf):
    """Uses of a request less than twelve hours apart, as far as event time has passed them."""
    requests = event_stream(spark, sf).select(
        F.col("user_id").alias("case_id"), (k_of(F.col("props")) % 10).alias("request_id"), F.col("event_id").alias("pos"),
        F.col("event_type").alias("payload"), F.col("ts").cast("timestamp").alias("at"),
    )
    found = J.run_available(J.request_sessions(requests, "12 hours"), "append", fresh(spark, "sessions"))
    return found.select("case_id", "request_id", F.unix_micros("first_at").alias("first_us"), "payload", "uses", "conflict")


@query(
    "version_stream",
    """SELECT case_id, object_id, pos, pos % 5 <> 0 AS accepted, CASE WHEN pos % 5 = 0 THEN 'stale_version' END AS category, CAST(sum((pos % 5 <> 0)::INT) OVER (PARTITION BY case_id, object_id ORDER BY pos) AS BIGINT) AS version
FROM (SELECT user_id AS case_id, 'o' || (k % 5) AS object_id, event_id AS pos FROM v_ev)""",
)
def version_stream(spark, sf):
    """Every fifth request asserts an old version, the others the number of accepted ones before."""
    e = load(spark, sf, "events", "event_id", "user_id", "props").select(
        F.col("user_id").alias("case_id"), F.concat(F.lit("o"), k_of(F.col("props")) % 5).alias("object_id"), F.col("event_id").alias("pos")
    )
    right = F.when(F.col("pos") % 5 != 0, 1).otherwise(0).cast("long")
    counted = running_sums(e, ["case_id", "object_id"], "pos", {"_done": right})
    asserted = F.col("_done") - 1  # counts the request itself only when it is a right one
    folder = fresh(spark, "requests")
    requests = counted.select("case_id", "object_id", "pos", asserted.alias("asserted_version"))
    requests.write.parquet(folder)
    stream = J.read_stream(spark, folder, spark.read.parquet(folder).schema)
    return J.version_checks(stream, fresh(spark, "versions"))
