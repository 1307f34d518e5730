"""Queries over agent turns (table events)."""
from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.functions.canon import shown
from auditframe.operators import strategy as S
from auditframe.plans.registry import query, sql_view

# Messages the adapter gives to rejections, by k % 9; the last matches no phrase.
ERRORS = (
    "actor not authorized for action",
    "stale or excessive object versions",
    "precondition not met",
    "evidence_refs must be exposed",
    "action not available on surface",
    "transition already applied",
    "request fields must be exactly the contract fields",
    "tool-request.schema.json failed",
    "internal failure",
)


def load(spark, sf, table, *columns):
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    return df.select(*columns) if columns else df


def k_of(props):
    return F.get_json_object(props, "$.k").cast("int")


def turns(spark, sf):
    e = load(spark, sf, "events", "event_id", "user_id", "event_type", "props").withColumn("k", k_of(F.col("props")))
    outcome = (
        F.when(F.col("event_type") == "error", "REJECTED")
        .when(F.col("event_type") == "signup", "STOP")
        .when(F.col("event_type") == "view", "IDEMPOTENT")
        .otherwise("APPLIED")
    )
    error = F.when(F.col("event_type") == "error", F.array(*[F.lit(m) for m in ERRORS])[F.col("k") % 9])
    return e.select(
        (F.col("user_id") % 3).alias("run_id"),
        F.col("user_id").alias("episode_id"),
        F.col("event_id").alias("turn"),
        F.lit("case").alias("surface"),
        (F.col("k") % 2).alias("action"),
        F.lit("agent").alias("actor_id"),
        F.create_map(F.lit("object"), F.col("k") % 4).alias("object_versions"),
        (F.col("k") % 25 != 0).alias("request_is_object"),
        outcome.alias("outcome"),
        error.alias("error"),
        F.when(F.col("event_type") == "error", S.rejection_category(error)).alias("category"),
    )


sql_view(
    "v_ev",
    """SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events""",
)
_messages = ", ".join(f"'{m}'" for m in ERRORS)
_cases = " ".join(
    f"WHEN contains(error, '{phrase}') THEN '{category}'" for category, phrase in S.REJECTION_PHRASES
)
sql_view(
    "v_turns",
    f"""SELECT *, CASE WHEN error IS NULL THEN NULL {_cases} ELSE 'other' END AS category FROM (
  SELECT user_id % 3 AS run_id, user_id AS episode_id, event_id AS turn, k % 2 AS action, k % 4 AS versions,
    k % 25 <> 0 AS is_object,
    CASE event_type WHEN 'error' THEN 'REJECTED' WHEN 'signup' THEN 'STOP' WHEN 'view' THEN 'IDEMPOTENT' ELSE 'APPLIED' END AS outcome,
    CASE WHEN event_type = 'error' THEN ([{_messages}])[k % 9 + 1] END AS error
  FROM v_ev)""",
)
sql_view(
    "v_bucket",
    """SELECT *, CASE WHEN outcome <> 'REJECTED' THEN NULL
   WHEN n_outcome IS NULL OR n_outcome IN ('STOP', 'POLICY_ERROR') THEN 'abandon'
   WHEN is_object AND n_object AND n_action = action AND n_versions = versions THEN 'repeat'
   WHEN is_object AND n_object AND n_action = action THEN 'local_adjustment'
   ELSE 'revision' END AS bucket
 FROM (SELECT *, lead(outcome) OVER w AS n_outcome, lead(is_object) OVER w AS n_object,
         lead(action) OVER w AS n_action, lead(versions) OVER w AS n_versions
       FROM v_turns WINDOW w AS (PARTITION BY run_id, episode_id ORDER BY turn))""",
)
sql_view(
    "v_episode_strategy",
    """SELECT run_id, episode_id, rep + loc + rev + aba AS rejections, rep, loc, rev, aba,
    longest_repeat_streak, rejections_before_first_revision FROM (
  SELECT run_id, episode_id, sum(rep) rep, sum(loc) loc, sum(rev) rev, sum(aba) aba,
    max(rep) AS longest_repeat_streak, min(first) AS rejections_before_first_revision FROM (
    SELECT run_id, episode_id, island, count(*) FILTER (bucket = 'repeat') rep, count(*) FILTER (bucket = 'local_adjustment') loc,
      count(*) FILTER (bucket = 'revision') rev, count(*) FILTER (bucket = 'abandon') aba,
      min(CASE WHEN bucket = 'revision' THEN seen - 1 END) AS first FROM (
      SELECT *, sum(CASE WHEN bucket = 'repeat' THEN 0 ELSE 1 END) OVER w AS island,
        sum(CASE WHEN outcome = 'REJECTED' THEN 1 ELSE 0 END) OVER w AS seen
      FROM v_bucket WINDOW w AS (PARTITION BY run_id, episode_id ORDER BY turn))
    GROUP BY run_id, episode_id, island)
  GROUP BY run_id, episode_id)""",
)


@query(
    "strategy_buckets",
    "SELECT run_id, bucket, count(*) AS n FROM v_bucket WHERE bucket IS NOT NULL GROUP BY run_id, bucket",
)
def strategy_buckets(spark, sf):
    d = S.classify_rejections(turns(spark, sf))
    return d.where(F.col("bucket").isNotNull()).groupBy("run_id", "bucket").agg(F.count("*").alias("n"))


def per_episode(spark, sf):
    return S.episode_strategy(S.classify_rejections(turns(spark, sf), keep_chunks=True))


@query(
    "strategy_streak",
    "SELECT run_id, episode_id, CAST(longest_repeat_streak AS BIGINT) AS longest_repeat_streak FROM v_episode_strategy",
)
def strategy_streak(spark, sf):
    return per_episode(spark, sf).select("run_id", "episode_id", "longest_repeat_streak")


@query(
    "strategy_latency",
    """SELECT run_id, episode_id, CAST(rejections AS BIGINT) AS rejections,
  CAST(rejections_before_first_revision AS BIGINT) AS rejections_before_first_revision FROM v_episode_strategy""",
)
def strategy_latency(spark, sf):
    return per_episode(spark, sf).select("run_id", "episode_id", "rejections", "rejections_before_first_revision")


sql_view(
    "v_run_strategy",
    """SELECT run_id, count(*) AS episodes, CAST(sum(rejections) AS BIGINT) AS rejections,
  CAST(sum(rep) AS BIGINT) AS repeat_total, CAST(sum(loc) AS BIGINT) AS local_adjustment_total,
  CAST(sum(rev) AS BIGINT) AS revision_total, CAST(sum(aba) AS BIGINT) AS abandon_total,
  CAST(max(longest_repeat_streak) AS BIGINT) AS longest_repeat_streak,
  round_even(avg(rejections_before_first_revision), 2) AS mean_rejections_before_first_revision,
  count(*) FILTER (rev > 0) AS episodes_with_any_revision,
  round_even(sum(rep) / nullif(sum(rejections), 0), 4) AS repeat_fraction,
  round_even(sum(loc) / nullif(sum(rejections), 0), 4) AS local_adjustment_fraction,
  round_even(sum(rev) / nullif(sum(rejections), 0), 4) AS revision_fraction,
  round_even(sum(aba) / nullif(sum(rejections), 0), 4) AS abandon_fraction
FROM v_episode_strategy GROUP BY run_id""",
)


@query("strategy_run", "SELECT * FROM v_run_strategy")
def strategy_run(spark, sf):
    return S.run_strategy(per_episode(spark, sf))


@query(
    "rejection_categories",
    "SELECT run_id, category, count(*) AS rejections FROM v_turns WHERE outcome = 'REJECTED' GROUP BY run_id, category",
)
def rejection_categories(spark, sf):
    return S.rejection_counts(turns(spark, sf))


sql_view(
    "v_outcomes",
    """SELECT run_id, episode_id, count(*) AS turns,
  count(*) FILTER (outcome = 'APPLIED') >= 2 * count(*) FILTER (outcome = 'REJECTED') AS complete,
  count(*) FILTER (outcome = 'REJECTED') AS rejected,
  count(*) FILTER (category = 'malformed') AS forbidden_output_keys,
  count(*) FILTER (outcome = 'STOP' AND NOT is_object) AS canary_echoes,
  CASE WHEN run_id < 2 THEN count(*) FILTER (outcome = 'APPLIED' AND NOT is_object) END AS state_changes_outside_contract
FROM v_turns GROUP BY run_id, episode_id""",
)


def outcomes(spark, sf):
    """Episode outcomes derived from turns; run 2 never measured its state changes."""
    o, plain = F.col("outcome"), ~F.col("request_is_object")
    return turns(spark, sf).groupBy("run_id", "episode_id").agg(
        F.count("*").alias("turns"),
        (F.count_if(o == "APPLIED") >= 2 * F.count_if(o == "REJECTED")).alias("complete"),
        F.count_if(o == "REJECTED").alias("rejected"),
        F.count_if(F.col("category") == "malformed").alias("forbidden_output_keys"),
        F.count_if((o == "STOP") & plain).alias("canary_echoes"),
        F.when(F.col("run_id") < 2, F.count_if((o == "APPLIED") & plain)).alias("state_changes_outside_contract"),
    )


sql_view(
    "v_run_metrics",
    """SELECT run_id, count(*) AS episodes, count(*) FILTER (complete) AS completed, bool_and(complete) AS all_pass,
  round_even(count(*) FILTER (complete) / count(*), 4) AS completion_rate, round_even(sum(turns) / count(*), 2) AS mean_turns,
  CAST(sum(forbidden_output_keys) AS BIGINT) AS forbidden_output_keys, CAST(sum(canary_echoes) AS BIGINT) AS canary_echoes,
  CAST(sum(state_changes_outside_contract) AS BIGINT) AS state_changes_outside_contract,
  CAST(sum(rejected) AS BIGINT) AS rejected_requests FROM v_outcomes GROUP BY run_id""",
)


@query("run_metrics", "SELECT * FROM v_run_metrics")
def run_metrics(spark, sf):
    return S.free_run_metrics(outcomes(spark, sf))


sql_view(
    "v_telemetry",
    """SELECT user_id % 3 AS run_id, event_id AS turn,
  CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 429 WHEN 'view' THEN 503 ELSE 200 END AS status,
  CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(round(value * 1000) AS BIGINT) END AS elapsed_ms,
  k % 3 AS transport_retries,
  CASE WHEN event_type IN ('click', 'purchase') THEN k + 100 END AS input_tokens,
  CASE WHEN event_type = 'purchase' THEN k END AS output_tokens,
  CASE WHEN event_type = 'purchase' THEN 2 * k + 100 END AS total_tokens,
  CASE WHEN event_type = 'click' AND user_id % 3 <> 2 THEN k % 7 END AS cached_tokens,
  CASE WHEN event_type = 'view' THEN k % 2 = 0 END AS malformed_response FROM v_ev""",
)


def telemetry(spark, sf):
    e = load(spark, sf, "events", "event_id", "user_id", "event_type", "value", "props").withColumn("k", k_of(F.col("props")))
    kind, k = F.col("event_type"), F.col("k")
    return e.select(
        (F.col("user_id") % 3).alias("run_id"),
        F.col("event_id").alias("turn"),
        F.when(kind == "signup", None).when(kind == "error", 429).when(kind == "view", 503).otherwise(200).alias("status"),
        F.when(kind != "signup", F.round(F.col("value") * 1000).cast("long") / 1000).alias("elapsed_seconds"),
        F.when(kind != "signup", F.round(F.col("value") * 1000).cast("long")).alias("elapsed_ms"),
        (k % 3).alias("transport_retries"),
        F.when(kind.isin("click", "purchase"), k + 100).alias("input_tokens"),
        F.when(kind == "purchase", k).alias("output_tokens"),
        F.when(kind == "purchase", 2 * k + 100).alias("total_tokens"),
        F.when((kind == "click") & (F.col("user_id") % 3 != 2), k % 7).alias("cached_tokens"),
        F.when(kind == "view", k % 2 == 0).alias("malformed_response"),
    )


sql_view(
    "v_usage",
    """SELECT run_id, count(status) AS provider_calls,
  count(*) FILTER (status IS NOT NULL AND coalesce(input_tokens, output_tokens, total_tokens, cached_tokens) IS NOT NULL) AS calls_reporting_usage,
  CAST(sum(transport_retries) AS BIGINT) AS retry_events, count(*) FILTER (coalesce(malformed_response, false)) AS malformed_responses,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens,
  count(input_tokens) AS input_tokens_reported_calls, count(output_tokens) AS output_tokens_reported_calls,
  count(total_tokens) AS total_tokens_reported_calls, count(cached_tokens) AS cached_tokens_reported_calls
FROM v_telemetry GROUP BY run_id""",
)


@query(
    "usage_nullsafe",
    """SELECT run_id, provider_calls, calls_reporting_usage, retry_events, malformed_responses, input_tokens,
  output_tokens, total_tokens, input_tokens_reported_calls, output_tokens_reported_calls, total_tokens_reported_calls,
  cached_tokens_reported_calls, coalesce(CAST(cached_tokens AS VARCHAR), '?') AS cached_tokens FROM v_usage""",
)
def usage_nullsafe(spark, sf):
    return S.provider_usage(telemetry(spark, sf)).withColumn("cached_tokens", shown(F.col("cached_tokens")))


@query(
    "telemetry_summary",
    """SELECT run_id, count(*) AS calls, count(*) FILTER (status = 429) AS retries_429,
  count(*) FILTER (status BETWEEN 500 AND 599) AS status_5xx,
  round_even(CAST(sum(elapsed_ms) AS DOUBLE) / 1000, 3) AS total_latency,
  round_even(CAST(sum(elapsed_ms) AS DOUBLE) / count(elapsed_ms) / 1000, 3) AS mean_latency FROM v_telemetry GROUP BY run_id""",
)
def telemetry_summary(spark, sf):
    return S.telemetry_summary(telemetry(spark, sf))


@query(
    "telemetry_status_histogram",
    """SELECT run_id, coalesce(CAST(status AS VARCHAR), 'UNKNOWN') AS status, count(*) AS n FROM v_telemetry GROUP BY 1, 2""",
)
def telemetry_status_histogram(spark, sf):
    return S.histogram(telemetry(spark, sf), ["run_id"], "status")


DELTA_FIELDS = ["completion_rate", "mean_turns", "repeat_fraction", "revision_fraction", "longest_repeat_streak", "total_tokens", "cached_tokens"]


def run_rows(spark, sf):
    """One row per run: completion, strategy and usage side by side."""
    return (
        S.free_run_metrics(outcomes(spark, sf))
        .drop("episodes")
        .join(S.run_strategy(per_episode(spark, sf)), "run_id", "left")
        .join(S.provider_usage(telemetry(spark, sf)), "run_id", "left")
    )


sql_view(
    "v_run_rows",
    """SELECT m.run_id, m.completion_rate, m.mean_turns, m.rejected_requests, s.repeat_fraction, s.revision_fraction,
  s.longest_repeat_streak, s.mean_rejections_before_first_revision, u.provider_calls, u.total_tokens, u.cached_tokens
FROM v_run_metrics m LEFT JOIN v_run_strategy s USING (run_id) LEFT JOIN v_usage u USING (run_id)""",
)


@query(
    "run_delta",
    "SELECT "
    + ", ".join(f"round_even(CAST(a.{f} AS DOUBLE) - CAST(b.{f} AS DOUBLE), 4) AS {f}_delta" for f in DELTA_FIELDS)
    + " FROM v_run_rows a, v_run_rows b WHERE a.run_id = 1 AND b.run_id = 0",
)
def run_delta(spark, sf):
    return S.run_delta(run_rows(spark, sf), 0, 1, DELTA_FIELDS)


@query(
    "run_comparison",
    """SELECT run_id, completion_rate, mean_turns, rejected_requests, repeat_fraction, revision_fraction, longest_repeat_streak,
  mean_rejections_before_first_revision, provider_calls, coalesce(CAST(cached_tokens AS VARCHAR), '?') AS cached_tokens FROM v_run_rows""",
)
def run_comparison(spark, sf):
    return run_rows(spark, sf).select(
        "run_id", "completion_rate", "mean_turns", "rejected_requests", "repeat_fraction", "revision_fraction",
        "longest_repeat_streak", "mean_rejections_before_first_revision", "provider_calls",
        shown(F.col("cached_tokens")).alias("cached_tokens"),
    )


@query(
    "stable_turn_order",
    """SELECT run_id, bucket, count(*) AS n FROM (SELECT run_id, CASE WHEN outcome <> 'REJECTED' THEN NULL WHEN n_outcome IS NULL OR n_outcome IN ('STOP', 'POLICY_ERROR') THEN 'abandon'
   WHEN is_object AND n_object AND n_action = action AND n_versions = versions THEN 'repeat' WHEN is_object AND n_object AND n_action = action THEN 'local_adjustment' ELSE 'revision' END AS bucket
 FROM (SELECT *, lead(outcome) OVER w AS n_outcome, lead(is_object) OVER w AS n_object, lead(action) OVER w AS n_action, lead(versions) OVER w AS n_versions
       FROM (SELECT *, CASE WHEN turn % 11 = 0 THEN 0 ELSE turn // 300 END AS t FROM v_turns) WINDOW w AS (PARTITION BY run_id, episode_id ORDER BY t, turn)))
WHERE bucket IS NOT NULL GROUP BY run_id, bucket""",
)
def stable_turn_order(spark, sf):
    """Turn numbers are shared by many rows or missing; position decides among equal ones."""
    t = turns(spark, sf).withColumn("pos", F.col("turn"))
    t = t.withColumn("turn", F.when(F.col("pos") % 11 != 0, F.expr("pos div 300")))
    d = S.classify_rejections(S.stable_turns(t, "pos"))
    return d.where(F.col("bucket").isNotNull()).groupBy("run_id", "bucket").agg(F.count("*").alias("n"))


SELECTION_ERRORS = (
    "claim 4 cites evidence OUTSIDE supplied set: e9", "Refusal lacks cited evidence coverage", "claim 2 is unsupported by its cited evidence",
    "schema validation failed at claims/0", "duplicate claim id: c1",
)


@query(
    "selection_errors",
    """SELECT user_id % 3 AS run_id, (['EVIDENCE_OUTSIDE_SET', 'REFUSAL_REJECTED', 'UNSUPPORTED_ADDITION', 'SCHEMA_INVALID', 'VALIDATION_REJECTED'])[k % 5 + 1] AS error_code, count(*) AS n
FROM v_ev WHERE event_type = 'error' GROUP BY ALL""",
)
def selection_errors(spark, sf):
    e = load(spark, sf, "events", "user_id", "event_type", "props").where("event_type = 'error'")
    message = F.array(*[F.lit(m) for m in SELECTION_ERRORS])[k_of(F.col("props")) % 5]
    return e.groupBy((F.col("user_id") % 3).alias("run_id"), S.selection_error_code(message).alias("error_code")).agg(F.count("*").alias("n"))
