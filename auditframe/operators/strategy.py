"""What an agent does after a rejection, and per-run metrics of free runs.

Turns carry: run_id, episode_id, turn, surface, action, actor_id, object_versions,
request_is_object, outcome, category, error.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.canon import half_even, map_key, ratio
from auditframe.functions.ordered import neighbour, ranged, running_sums, with_chunks

EPISODE = ["run_id", "episode_id"]

# Names of the four responses to a rejection.
BUCKETS = ("repeat", "local_adjustment", "revision", "abandon")

# Rejection categories and the phrase that decides each, first match wins.
REJECTION_PHRASES = (
    ("unauthorized", "not authorized"),
    ("stale_version", "stale or excessive"),
    ("precondition", "precondition"),
    ("ungrounded", "evidence_refs"),
    ("unknown_action", "not available on"),
    ("already_applied", "already applied"),
    ("malformed", "request fields must be exactly"),
    ("schema", "tool-request.schema.json"),
)

# Error codes of a refused selection, decided on the lower-cased message.
SELECTION_PHRASES = (
    ("EVIDENCE_OUTSIDE_SET", ("outside supplied set",)),
    ("REFUSAL_REJECTED", ("refusal",)),
    ("UNSUPPORTED_ADDITION", ("unsupported",)),
    ("SCHEMA_INVALID", ("schema", "validation failed")),
)


def rejection_category(message: Column) -> Column:
    """Category of a rejection message; other when no phrase occurs."""
    chain = F
    for category, phrase in REJECTION_PHRASES:
        chain = chain.when(message.contains(phrase), category)
    return chain.otherwise("other")


def selection_error_code(message: Column) -> Column:
    """Code of a selection error message, ignoring case."""
    lowered = F.lower(message)
    chain = F
    for code, phrases in SELECTION_PHRASES:
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | lowered.contains(phrase)
        chain = chain.when(hit, code)
    return chain.otherwise("VALIDATION_REJECTED")


def stable_turns(turns: DataFrame, pos: str) -> DataFrame:
    """Turns ordered by turn number (a missing one counts 0) and then by position.

    The new ``turn`` is a struct of both, so equal turn numbers keep their order and numbers may be sparse or large.
    """
    turn = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.col(pos).alias("pos"))
    return ranged(turns.withColumn("turn", turn), EPISODE, "turn")


def classify_rejections(turns: DataFrame, *, keep_chunks: bool = False) -> DataFrame:
    """Add ``bucket``: the response to each rejected turn, NULL on other turns.

    With ``keep_chunks`` the chunk column stays, so that ``episode_strategy`` goes on
    with the same shuffle.
    """
    approach = F.when(F.col("request_is_object"), F.struct("surface", "action"))
    signature = F.when(
        F.col("request_is_object"),
        F.struct("surface", "action", "actor_id", map_key(F.col("object_versions")).alias("versions")),
    )
    prepared = turns.withColumns({"_approach": approach, "_signature": signature})
    coming = F.struct("outcome", "_approach", "_signature")
    chunked = prepared if "_chunk" in turns.columns else with_chunks(prepared, "turn")
    data = neighbour(chunked, EPISODE, "turn", coming, "_next")
    after = F.col("_next")

    def same(field: str) -> Column:
        return after[field].isNotNull() & after[field].eqNullSafe(F.col(field))

    bucket = (
        F.when(F.col("outcome") != "REJECTED", None)
        .when(after.isNull() | after["outcome"].isin("STOP", "POLICY_ERROR"), "abandon")
        .when(same("_signature"), "repeat")
        .when(same("_approach"), "local_adjustment")
        .otherwise("revision")
    )
    return data.withColumn("bucket", bucket).drop("_next", "_approach", "_signature", *([] if keep_chunks else ["_chunk"]))


def episode_strategy(classified: DataFrame) -> DataFrame:
    """Per episode: rejections per bucket, longest repeat streak, rejections before
    the first revision (NULL when there is none)."""
    is_repeat = F.col("bucket").eqNullSafe("repeat")
    run = running_sums(
        classified.select(*EPISODE, "turn", "outcome", "bucket", *[c for c in classified.columns if c == "_chunk"]),
        EPISODE,
        "turn",
        {
            "_island": F.when(is_repeat, 0).otherwise(1).cast("long"),
            "_seen": F.when(F.col("outcome") == "REJECTED", 1).otherwise(0).cast("long"),
        },
    )
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    islands = run.groupBy(*EPISODE, "_island").agg(
        *counts,
        F.min(F.when(F.col("bucket") == "revision", F.col("_seen") - 1)).alias("_first"),
    )
    return islands.groupBy(*EPISODE).agg(
        *[F.sum(b).alias(b) for b in BUCKETS],
        F.max("repeat").alias("longest_repeat_streak"),
        F.min("_first").alias("rejections_before_first_revision"),
    ).withColumn("rejections", sum((F.col(b) for b in BUCKETS), F.lit(0).cast("long")))


def run_strategy(per_episode: DataFrame) -> DataFrame:
    """Per run: totals, fractions (NULL without a rejection), streak and latency."""
    total = per_episode.groupBy("run_id").agg(
        F.count("*").alias("episodes"),
        F.sum("rejections").alias("rejections"),
        *[F.sum(b).alias(f"{b}_total") for b in BUCKETS],
        F.max("longest_repeat_streak").alias("longest_repeat_streak"),
        half_even(F.avg("rejections_before_first_revision"), 2).alias("mean_rejections_before_first_revision"),
        F.count_if(F.col("revision") > 0).alias("episodes_with_any_revision"),
    )
    return total.withColumns(
        {f"{b}_fraction": ratio(F.col(f"{b}_total"), F.col("rejections"), 4) for b in BUCKETS}
    )


def free_run_metrics(outcomes: DataFrame) -> DataFrame:
    """Per run over episode outcomes (run_id, episode_id, complete, turns, rejected,
    forbidden_output_keys, canary_echoes, state_changes_outside_contract)."""
    return outcomes.groupBy("run_id").agg(
        F.count("*").alias("episodes"),
        F.count_if("complete").alias("completed"),
        F.bool_and("complete").alias("all_pass"),
        ratio(F.count_if("complete"), F.count("*"), 4).alias("completion_rate"),
        ratio(F.sum("turns"), F.count("*"), 2).alias("mean_turns"),
        F.sum("forbidden_output_keys").alias("forbidden_output_keys"),
        F.sum("canary_echoes").alias("canary_echoes"),
        F.sum("state_changes_outside_contract").alias("state_changes_outside_contract"),
        F.sum("rejected").alias("rejected_requests"),
    )


def rejection_counts(turns: DataFrame) -> DataFrame:
    """Rejections per run and category, merged over episodes."""
    return (
        turns.where(F.col("outcome") == "REJECTED")
        .groupBy("run_id", "category")
        .agg(F.count("*").alias("rejections"))
    )


TOKEN_FIELDS = ("input_tokens", "output_tokens", "total_tokens", "cached_tokens")


def provider_usage(telemetry: DataFrame) -> DataFrame:
    """Per run: calls, retries, malformed responses, token sums that stay NULL when
    no call reports the field.  A row is a call when it has a status."""
    is_call = F.col("status").isNotNull()
    reports = is_call & F.coalesce(*[F.col(f) for f in TOKEN_FIELDS]).isNotNull()
    return telemetry.groupBy("run_id").agg(
        F.count_if(is_call).alias("provider_calls"),
        F.count_if(reports).alias("calls_reporting_usage"),
        F.sum(F.coalesce("transport_retries", F.lit(0))).alias("retry_events"),
        F.count_if(F.coalesce("malformed_response", F.lit(False))).alias("malformed_responses"),
        *[F.sum(F.when(is_call, F.col(f))).alias(f) for f in TOKEN_FIELDS],
        *[F.count(F.when(is_call, F.col(f))).alias(f"{f}_reported_calls") for f in TOKEN_FIELDS],
    )


def telemetry_summary(telemetry: DataFrame) -> DataFrame:
    """Per run: calls, statuses of interest, total and mean latency or NULL."""
    return telemetry.groupBy("run_id").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == 429).alias("retries_429"),
        F.count_if(F.col("status").between(500, 599)).alias("status_5xx"),
        half_even(F.sum("elapsed_seconds"), 3).alias("total_latency"),
        half_even(F.avg("elapsed_seconds"), 3).alias("mean_latency"),
    )


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts per key and value; a missing value is shown as UNKNOWN."""
    return df.groupBy(*keys, F.coalesce(F.col(value).cast("string"), F.lit("UNKNOWN")).alias(value)).agg(
        F.count("*").alias("n")
    )


def run_delta(rows: DataFrame, before: str | int, after: str | int, fields: list[str]) -> DataFrame:
    """Field by field difference of exactly two runs; NULL in gives NULL out."""
    pair = rows.where(F.col("run_id").isin(before, after)).groupBy().agg(
        *[F.max(F.when(F.col("run_id") == before, F.col(f).cast("double"))).alias(f"b_{f}") for f in fields],
        *[F.max(F.when(F.col("run_id") == after, F.col(f).cast("double"))).alias(f"a_{f}") for f in fields],
    )
    return pair.select(*[half_even(F.col(f"a_{f}") - F.col(f"b_{f}"), 4).alias(f"{f}_delta") for f in fields])
