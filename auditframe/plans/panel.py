"""Queries over model panels: one record per event, four models."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditframe.functions.canon import cents, digest
from auditframe.operators import leak as L
from auditframe.operators import panel as P
from auditframe.plans.registry import query, sql_view
from auditframe.plans.rules import gold
from auditframe.plans.strategy import k_of, load
from auditframe.session import materialise

FAMILY_NAMES = ("settlement", "allocations", "reconciliation", "margin", "permissions", "lifecycle", "evidence", "temporal")
ROUTES = ("execute", "approve", "escalate")
OUTCOMES = ("closed", "closed", "closed", "provider_error", "invalid_json", "turn_limit", "case_token_limit")
TOOLS = ("read_document", "assess", "assess", "execute", "inspect", "close", "escalate")


def pick(values, index):
    return F.array(*[F.lit(v) for v in values])[index.cast("int")]


def plan(spark, sf):
    e = load(spark, sf, "events", "event_id")
    case = F.expr("event_id div 4")
    return e.select(
        F.concat(F.lit("m"), F.col("event_id") % 4).alias("model"), case.alias("case_id"),
        pick(FAMILY_NAMES, case % 8).alias("family"), pick(ROUTES, case % 3).alias("route"),
    )


def records(spark, sf):
    """Model m3 lost every record whose event id is a multiple of 37."""
    e = load(spark, sf, "events", "event_id", "value", "props").where("NOT (event_id % 4 = 3 AND event_id % 37 = 0)")
    key, case = F.col("event_id"), F.expr("event_id div 4")
    mixed = (key * 7919) % 256
    bits = F.when((key * 7919) % 5 < 3, F.lit(255)).otherwise(mixed)
    checks = {c: bits.bitwiseAND(F.lit(1 << i)) > 0 for i, c in enumerate(P.CHECKS)}
    empty = F.array().cast("array<string>")
    safety = (
        F.when(key % 11 == 0, F.array(F.lit("unauthorized_execution_attempt")))
        .when(key % 13 == 0, F.array(F.lit("wrong_operation_attempt"))).otherwise(empty)
    )
    return P.with_grade(e.select(
        F.concat(F.lit("m"), key % 4).alias("model"), case.alias("case_id"), key,
        pick(FAMILY_NAMES, case % 8).alias("family"), pick(ROUTES, case % 3).alias("route"),
        pick(OUTCOMES, key % 7).alias("outcome"), *[v.alias(c) for c, v in checks.items()], safety.alias("safety_violations"),
        (F.lit(4) + key % 9).alias("turns"), cents(F.col("value")).alias("output_tokens"), F.col("value").alias("seconds"),
        k_of(F.col("props")).alias("k"),
    ))


def actions(spark, sf):
    e = load(spark, sf, "events", "event_id", "value").where("NOT (event_id % 4 = 3 AND event_id % 37 = 0)")
    key = F.col("event_id")
    d = e.select(
        F.concat(F.lit("m"), key % 4).alias("model"), F.expr("event_id div 4").alias("case_id"), key, cents(F.col("value")).alias("value"),
        F.explode(F.array(*[F.lit(i) for i in range(1, 5)])).alias("pos"),
    )
    ok = ((F.col("event_id") + 1) * F.col("pos")) % 5 != 0
    return d.select(
        "model", "case_id", "pos", pick(TOOLS, (F.col("event_id") + F.col("pos")) % 7).alias("tool"), ok.alias("ok"),
        F.when(~ok, pick(("version_conflict", "precondition", "control_denied"), F.col("event_id") % 3)).alias("error"),
        (F.col("value") + F.col("pos") % 2).alias("value"),
    )


def turns(spark, sf):
    e = load(spark, sf, "events", "event_id", "value", "props").withColumn("k", k_of(F.col("props")))
    key, k = F.col("event_id"), F.col("k")
    status = F.when((key % 4 == 3) & (k == 0), 402).when(k % 5 == 0, 429).otherwise(200)
    return e.select(
        F.concat(F.lit("m"), key % 4).alias("model"), key,
        F.when(k % 3 > 0, k).alias("prompt_tokens"), F.when(k % 3 > 1, k * 2).alias("completion_tokens"),
        F.when(k % 3 > 1, k * 3).alias("total_tokens"), F.when(k % 7 == 0, k).alias("reasoning_tokens"),
        F.when(key % 4 < 2, cents(F.col("value"))).alias("cost_micros"),
        F.when(k % 4 > 0, F.concat(F.lit("fp"), k % 4)).alias("fingerprint"),
        F.when(k % 5 == 0, F.array(F.struct(status.alias("http_status")), F.struct(F.lit(200).alias("http_status"))))
        .otherwise(F.array(F.struct(status.alias("http_status")))).alias("attempts"),
    )


def answers(spark, sf):
    cases = plan(spark, sf).select("case_id", "family", "route").distinct()
    case = F.col("case_id")
    return cases.select(
        "case_id", F.col("route").alias("expected_route"), F.concat(F.lit("sig"), F.expr("case_id div 8") % 50).alias("mechanism_signature"),
        (case * 3).alias("target"), (case % 7 * 100).alias("risk_amount"),
    )


_family = "(['" + "', '".join(FAMILY_NAMES) + "'])"
_bits = ", ".join(f"(bits & {1 << i}) > 0 AS {c}" for i, c in enumerate(P.CHECKS))
sql_view(
    "v_plan",
    f"""SELECT 'm' || (event_id % 4) AS model, event_id // 4 AS case_id, {_family}[event_id // 4 % 8 + 1] AS family,
  (['execute', 'approve', 'escalate'])[event_id // 4 % 3 + 1] AS route FROM events""",
)
sql_view(
    "v_records",
    f"""SELECT *, passed / 8.0::DOUBLE AS score, passed = 8 AND safety IS NULL AS complete FROM (
  SELECT *, {_bits}, bit_count(bits) AS passed FROM (
  SELECT 'm' || (event_id % 4) AS model, event_id // 4 AS case_id, event_id, {_family}[event_id // 4 % 8 + 1] AS family,
    (['execute', 'approve', 'escalate'])[event_id // 4 % 3 + 1] AS route, ({list(OUTCOMES)})[event_id % 7 + 1] AS outcome,
    CASE WHEN event_id * 7919 % 5 < 3 THEN 255 ELSE event_id * 7919 % 256 END AS bits,
    CASE WHEN event_id % 11 = 0 THEN 'unauthorized_execution_attempt' WHEN event_id % 13 = 0 THEN 'wrong_operation_attempt' END AS safety,
    4 + event_id % 9 AS turns, CAST(round(value * 100) AS BIGINT) AS output_tokens, value AS seconds, k
  FROM v_ev WHERE NOT (event_id % 4 = 3 AND event_id % 37 = 0)))""",
)
sql_view(
    "v_actions",
    f"""SELECT *, CASE WHEN NOT ok THEN (['version_conflict', 'precondition', 'control_denied'])[event_id % 3 + 1] END AS error FROM (
  SELECT 'm' || (event_id % 4) AS model, event_id // 4 AS case_id, event_id, pos, ({list(TOOLS)})[(event_id + pos) % 7 + 1] AS tool,
    (event_id + 1) * pos % 5 <> 0 AS ok, CAST(round(value * 100) AS BIGINT) + pos % 2 AS value
  FROM events CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS pos) WHERE NOT (event_id % 4 = 3 AND event_id % 37 = 0))""",
)
sql_view(
    "v_assigned",
    """SELECT p.model, p.case_id, p.family, p.route, r.* EXCLUDE (model, case_id, family, route), r.event_id IS NOT NULL AS recorded
FROM v_plan p LEFT JOIN v_records r ON r.model = p.model AND r.case_id = p.case_id""",
)
_summary = """count(*) AS assigned, count(*) FILTER (recorded) AS recorded, count(*) FILTER (NOT recorded) AS missing,
  count(*) FILTER (complete) AS complete, round_even(coalesce(sum(score), 0) / count(*), 6) AS mean_score,
  count(*) FILTER (safety IS NOT NULL) AS safety_cases"""


def assigned(spark, sf):
    return P.assigned_rows(plan(spark, sf), records(spark, sf))


@query(
    "grade_eight",
    "SELECT model, case_id, score, complete, safety IS NOT NULL AS unsafe FROM v_records",
)
def grade_eight(spark, sf):
    return records(spark, sf).select("model", "case_id", "score", "complete", (F.size("safety_violations") > 0).alias("unsafe"))


sql_view("v_summary", f"SELECT model, {_summary} FROM v_assigned GROUP BY model")


@query("panel_summary", "SELECT * FROM v_summary")
def panel_summary(spark, sf):
    return P.summarize(assigned(spark, sf), "model")


@query(
    "panel_grouping_sets",
    f"""SELECT model, family, route, quarantined, CASE g WHEN 7 THEN 'model' WHEN 3 THEN 'family' WHEN 5 THEN 'route' ELSE 'quarantine' END AS level,
  * EXCLUDE (model, family, route, quarantined, g) FROM (
  SELECT model, family, route, quarantined, grouping(model, family, route, quarantined) AS g, {_summary}
  FROM (SELECT *, family = 'evidence' AS quarantined FROM v_assigned)
  GROUP BY GROUPING SETS ((model), (model, family), (model, route), (model, quarantined)))""",
)
def panel_grouping_sets(spark, sf):
    return P.summarize_sets(assigned(spark, sf))


_checks = ", ".join(f"'{c}'" for c in P.CHECKS)


@query(
    "check_histogram",
    f"""SELECT model, ([{_checks}])[i + 1] AS "check", count(*) FILTER ((bits >> i) & 1 = 1) AS passed, count(*) FILTER ((bits >> i) & 1 = 0) AS failed
FROM v_records CROSS JOIN (SELECT unnest(range(8)) AS i) GROUP BY model, i""",
)
def check_histogram(spark, sf):
    return P.check_histogram(records(spark, sf))


@query("outcome_histogram", "SELECT model, outcome, count(*) AS n FROM v_records GROUP BY ALL")
def outcome_histogram(spark, sf):
    return P.outcome_histogram(records(spark, sf))


@query("tool_errors", "SELECT model, error, count(*) AS n FROM v_actions WHERE NOT ok GROUP BY ALL")
def tool_errors(spark, sf):
    return P.tool_errors(actions(spark, sf))


sql_view(
    "v_action_facts",
    """SELECT model, case_id, bool_or(tool = 'execute' AND ok) AS executed, bool_or(NOT ok) AS refused,
  arg_max(value, pos) FILTER (tool = 'assess' AND ok) AS assessed_value FROM v_actions GROUP BY model, case_id""",
)
sql_view(
    "v_diagnosed",
    """SELECT r.*, outcome = 'closed' AND NOT complete AS closed_incorrect, executed AND NOT calculation AS executed_wrong_value,
  safety IS NOT NULL AS unsafe_attempt, refused AS tool_rejection, assessed_value FROM v_records r JOIN v_action_facts USING (model, case_id)""",
)


def diagnosed(spark, sf):
    return P.diagnostics(records(spark, sf), P.action_facts(actions(spark, sf)))


@query(
    "diagnostics",
    """SELECT model, count(*) FILTER (closed_incorrect) AS closed_incorrect, count(*) FILTER (executed_wrong_value) AS executed_wrong_value,
  count(*) FILTER (unsafe_attempt) AS unsafe_attempt, count(*) FILTER (tool_rejection) AS tool_rejection FROM v_diagnosed GROUP BY model""",
)
def diagnostics(spark, sf):
    return P.counts_of(diagnosed(spark, sf), P.DIAGNOSTICS, "model")


@query(
    "semantic_tags",
    f"""SELECT model, count(*) FILTER (u AND route = 'approve') AS {P.TAGS[0]}, count(*) FILTER (u AND route = 'escalate') AS {P.TAGS[1]},
  count(*) FILTER (u AND outcome = 'closed') AS {P.TAGS[2]},
  count(*) FILTER (assessed_value = case_id % 7 * 100 AND assessed_value <> case_id * 3) AS {P.TAGS[3]},
  count(*) FILTER (outcome = 'closed' AND NOT calculation) AS {P.TAGS[4]}
FROM (SELECT *, coalesce(safety = 'unauthorized_execution_attempt', false) AS u FROM v_diagnosed) GROUP BY model""",
)
def semantic_tags(spark, sf):
    tagged = P.semantic_tags(records(spark, sf), P.action_facts(actions(spark, sf)), answers(spark, sf))
    return P.counts_of(tagged, P.TAGS, "model")


sql_view(
    "v_medians",
    """SELECT model, quantile_cont(CAST(turns AS DOUBLE), 0.5) AS median_actions, quantile_cont(CAST(output_tokens AS DOUBLE), 0.5) AS median_output_tokens,
  round_even(quantile_cont(seconds, 0.5), 6) AS median_seconds FROM v_records GROUP BY model""",
)


@query("panel_medians", "SELECT * FROM v_medians")
def panel_medians(spark, sf):
    return P.medians(records(spark, sf)).withColumn("median_seconds", F.bround("median_seconds", 6))


sql_view(
    "v_panel_usage",
    """SELECT 'm' || (event_id % 4) AS model, CAST(sum(CASE WHEN k % 3 > 0 THEN k ELSE 0 END) AS BIGINT) AS prompt_tokens,
  CAST(sum(CASE WHEN k % 3 > 1 THEN k * 2 ELSE 0 END) AS BIGINT) AS completion_tokens, CAST(sum(CASE WHEN k % 3 > 1 THEN k * 3 ELSE 0 END) AS BIGINT) AS total_tokens,
  CAST(sum(CASE WHEN k % 7 = 0 THEN k ELSE 0 END) AS BIGINT) AS reasoning_tokens, CAST(sum(CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS http_attempts,
  CAST(sum(CASE WHEN event_id % 4 < 2 THEN CAST(round(value * 100) AS BIGINT) END) AS BIGINT) AS cost_micros, count(DISTINCT k % 4) AS fingerprints,
  bool_or(event_id % 4 = 3 AND k = 0) AS billing_or_auth_wall FROM v_ev GROUP BY 1""",
)


@query("panel_usage", "SELECT * FROM v_panel_usage")
def panel_usage(spark, sf):
    return P.usage_totals(turns(spark, sf))


@query("panel_fingerprints", "SELECT DISTINCT 'm' || (event_id % 4) AS model, CASE WHEN k % 4 > 0 THEN 'fp' || (k % 4) ELSE 'UNREPORTED' END AS fingerprint FROM v_ev")
def panel_fingerprints(spark, sf):
    return P.fingerprints(turns(spark, sf))


sql_view(
    "v_eligible_models",
    "SELECT model, billing_or_auth_wall, NOT billing_or_auth_wall AND missing = 0 AS comparison_eligible FROM v_summary JOIN v_panel_usage USING (model)",
)


def eligible(spark, sf):
    return P.eligibility(P.summarize(assigned(spark, sf), "model"), P.usage_totals(turns(spark, sf)))


@query("arm_eligibility", "SELECT * FROM v_eligible_models")
def arm_eligibility(spark, sf):
    return eligible(spark, sf)


@query(
    "agreement",
    """SELECT count(*) AS cases, count(*) FILTER (pe > 0) AS provider_error_cases, count(*) FILTER (p = n) AS all_models_pass,
  count(*) FILTER (p = 0 AND pe = 0) AS all_models_fail, count(*) FILTER (p > 0 AND p < n) AS disagreement,
  count(*) FILTER (clear) AS clear_cases, count(*) FILTER (clear AND pe > 0) AS clear_provider_error_cases, count(*) FILTER (clear AND p = n) AS clear_all_models_pass,
  count(*) FILTER (clear AND p = 0 AND pe = 0) AS clear_all_models_fail, count(*) FILTER (clear AND p > 0 AND p < n) AS clear_disagreement
FROM (SELECT case_id, family <> 'evidence' AS clear, count(*) AS n, count(*) FILTER (complete) AS p, count(*) FILTER (outcome = 'provider_error') AS pe
  FROM v_records WHERE model IN (SELECT model FROM v_eligible_models WHERE comparison_eligible) GROUP BY ALL)""",
)
def agreement(spark, sf):
    return P.agreement(records(spark, sf), eligible(spark, sf))


_ranked_models = ", ".join(
    f"coalesce(string_agg(model, ',' ORDER BY model) FILTER ({cond}), '') AS {name}, count(*) FILTER ({cond}) AS n_{name}"
    for name, cond in (
        ("failed_models", "ran AND NOT complete"), ("passed_models", "ran AND complete"), ("safety_models", "ran AND unsafe_attempt"),
        ("wrong_execution_models", "ran AND executed_wrong_value"), ("incorrect_closure_models", "ran AND closed_incorrect"),
        ("provider_error_models", "NOT ran"),
    )
)
sql_view(
    "v_ranked",
    f"""SELECT case_id, family, failed_models, passed_models, safety_models, wrong_execution_models, incorrect_closure_models, provider_error_models,
  semantic AS semantic_failures, (['execute', 'approve', 'escalate'])[case_id % 3 + 1] AS expected_route, 'sig' || (case_id // 8 % 50) AS mechanism_signature,
  CASE WHEN family = 'evidence' THEN 'QUARANTINED_POLICY_AMBIGUITY' ELSE 'REQUIRES_INDEPENDENT_REVIEW' END AS admission,
  CASE WHEN family = 'evidence' THEN -100 ELSE 100 * (n_safety_models > 0)::INT + 80 * (n_wrong_execution_models > 0)::INT
    + 40 * (n_incorrect_closure_models > 0)::INT + 20 * (semantic > 0 AND n_passed_models > 0)::INT + semantic END::BIGINT AS priority
FROM (SELECT case_id, family, {_ranked_models},
    count(*) FILTER (ran AND NOT complete AND outcome NOT IN {P.NON_SEMANTIC}) AS semantic
  FROM (SELECT *, outcome <> 'provider_error' AS ran FROM v_diagnosed WHERE model IN (SELECT model FROM v_eligible_models WHERE comparison_eligible))
  GROUP BY case_id, family) WHERE n_failed_models > 0""",
)


def ranked(spark, sf):
    return P.rank_cases(diagnosed(spark, sf), eligible(spark, sf), answers(spark, sf))


@query("case_ranking", "SELECT * FROM v_ranked")
def case_ranking(spark, sf):
    d = ranked(spark, sf)
    lists = [c for c in d.columns if c.endswith("_models")]
    return d.withColumns({c: F.array_join(c, ",") for c in lists}).orderBy(*P.ranking_order())


sql_view(
    "v_shortlist",
    """SELECT family, mechanism_signature, case_id, priority, failed_models, failed_variants FROM (
  SELECT *, count(*) OVER (PARTITION BY family, mechanism_signature) AS failed_variants,
    row_number() OVER (PARTITION BY family, mechanism_signature ORDER BY priority DESC, case_id) AS rn FROM v_ranked WHERE family <> 'evidence') WHERE rn = 1""",
)


@query("shortlist", "SELECT * FROM v_shortlist")
def shortlist(spark, sf):
    return P.shortlist(ranked(spark, sf)).withColumn("failed_models", F.array_join("failed_models", ","))


@query("shortlist_top20", "SELECT * FROM v_shortlist ORDER BY priority DESC, failed_variants DESC, family, case_id LIMIT 20")
def shortlist_top20(spark, sf):
    return P.shortlist_top(P.shortlist(ranked(spark, sf))).withColumn("failed_models", F.array_join("failed_models", ","))


@query(
    "shortlist_siblings",
    """SELECT r.family, r.mechanism_signature, s.case_id, r.case_id AS sibling_case_id FROM v_ranked r JOIN v_shortlist s
  ON s.family = r.family AND s.mechanism_signature = r.mechanism_signature WHERE r.case_id <> s.case_id""",
)
def shortlist_siblings(spark, sf):
    d = ranked(spark, sf)
    return P.siblings(d, P.shortlist(d))


@query("smoke_first", "SELECT family, min(case_id) AS case_id FROM v_plan GROUP BY family")
def smoke_first(spark, sf):
    return P.first_per_family(plan(spark, sf))


@query(
    "repeatability",
    """SELECT r.case_id, r.model, r.complete AS original_complete, t.c AS repeat_completions, t.n AS repeats, t.c + r.complete::INT AS passes_including_original,
  t.n + 1 AS trials_including_original, t.s + (r.safety IS NOT NULL)::INT AS safety_failures_including_original
FROM v_records r JOIN (SELECT case_id, model, count(*) AS n, count(*) FILTER ((event_id + i) % 3 <> 0) AS c, count(*) FILTER ((event_id + i) % 17 = 0) AS s
  FROM v_records CROSS JOIN (SELECT unnest([1, 2]) AS i) WHERE event_id % 5 = 0 GROUP BY ALL) t USING (case_id, model)""",
)
def repeatability(spark, sf):
    """Records whose event id is a multiple of five were repeated twice."""
    original = records(spark, sf)
    again = original.where("event_id % 5 = 0").select("case_id", "model", "event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
    mark = F.col("event_id") + F.col("i")
    trials = again.select(
        "case_id", "model", (mark % 3 != 0).alias("complete"),
        F.when(mark % 17 == 0, F.array(F.lit("unauthorized_execution_attempt"))).otherwise(F.array().cast("array<string>")).alias("safety_violations"),
    )
    return P.repeatability(original, trials)


@query(
    "answers_complete",
    """SELECT coalesce(c.doc_id, a.doc_id) AS case_id, CASE WHEN c.doc_id IS NULL THEN 'missing_case' WHEN a.doc_id IS NULL THEN 'missing_answer' ELSE 'digest_differs' END AS problem
FROM (SELECT doc_id, text FROM documents WHERE doc_id % 41 <> 0) c FULL OUTER JOIN labels a ON a.doc_id = c.doc_id
WHERE c.doc_id IS NULL OR a.doc_id IS NULL OR (a.toxic = 1)""",
)
def answers_complete(spark, sf):
    """Documents as cases (every 41st lost) against labels as answers; toxic ones carry a wrong digest."""
    d = load(spark, sf, "documents", "doc_id", "text")
    cases = d.where("doc_id % 41 <> 0").select(F.col("doc_id").alias("case_id"), F.sha2("text", 256).alias("case_sha256"))
    labels = load(spark, sf, "labels", "doc_id", "toxic")
    answer = labels.join(d, "doc_id").select(
        F.col("doc_id").alias("case_id"),
        F.when(F.col("toxic") == 1, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("case_sha256"),
    )
    return P.answer_bindings(cases, answer)


@query(
    "response_commitment",
    """SELECT conv_id, turn, CASE WHEN (conv_id * 8 + turn) % 19 = 0 THEN 'missing_turn' WHEN (conv_id * 8 + turn) % 13 = 0 THEN 'turn_differs' ELSE 'body_differs' END AS problem
FROM conversations WHERE (conv_id * 8 + turn) % 19 = 0 OR (conv_id * 8 + turn) % 13 = 0 OR ((conv_id * 8 + turn) % 7 = 0 AND role <> 'user')""",
)
def response_commitment(spark, sf):
    c = load(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    mark = F.col("conv_id") * 8 + F.col("turn")
    body = F.sha2("text", 256)
    whole = digest({"role": F.col("role"), "text": F.col("text")})
    entries = c.select(
        "conv_id", "turn", F.when(mark % 13 == 0, F.lit("0")).otherwise(whole).alias("sha256"),
        F.when(mark % 7 == 0, F.lit("0")).otherwise(body).alias("response_sha256"),
    )
    files = c.where(mark % 19 != 0).select(
        "conv_id", "turn", whole.alias("turn_sha256"), body.alias("body_sha256"), (F.col("role") == "user").alias("provider_error")
    )
    return P.response_commitments(entries, files, ["conv_id", "turn"])


@query("unknown_ids", "SELECT DISTINCT l_orderkey AS case_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def unknown_ids(spark, sf):
    submitted = load(spark, sf, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("case_id")).distinct()
    cases = load(spark, sf, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("case_id"))
    return P.unknown_ids(submitted, cases)


@query(
    "supplement_union",
    "SELECT model, count(*) AS records, count(*) FILTER (complete) AS complete FROM v_records GROUP BY model",
)
def supplement_union(spark, sf):
    d = records(spark, sf)
    joined = P.supplement(d.where("model <> 'm3'"), d.where("model = 'm3'"))
    return joined.groupBy("model").agg(F.count("*").alias("records"), F.count_if("complete").alias("complete"))


@query(
    "protocol_differences",
    """SELECT 'case_count' AS field, CAST(count(*) AS VARCHAR) AS planned, CAST(count(*) FILTER (o_orderstatus <> 'P') AS VARCHAR) AS supplemental FROM orders
UNION ALL SELECT 'last_case', CAST(max(o_orderkey) AS VARCHAR), CAST(max(o_orderkey) FILTER (o_orderstatus <> 'P') AS VARCHAR) FROM orders
HAVING max(o_orderkey) <> max(o_orderkey) FILTER (o_orderstatus <> 'P')""",
)
def protocol_differences(spark, sf):
    def protocol(cases):
        return cases.agg(
            F.count("*").alias("case_count"), F.min("o_custkey").alias("first_case"), F.max("o_orderkey").alias("last_case"), F.lit(24).alias("turn_limit")
        )

    o = load(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return P.protocol_differences(protocol(o), protocol(o.where("o_orderstatus <> 'P'")), ["case_count", "first_case", "last_case", "turn_limit"])


@query(
    "dataset_counts",
    """SELECT family, route, count(*) AS cases, CAST(sum(docs) AS BIGINT) AS documents, count(*) * 8 AS scored_criteria FROM (
  SELECT g.family, g.route, (SELECT count(*) FROM lineitem WHERE l_orderkey = g.case_id) AS docs FROM v_gold g) GROUP BY family, route""",
)
def dataset_counts(spark, sf):
    docs = load(spark, sf, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count("*").alias("docs"))
    return gold(spark, sf).select("case_id", "family", "route").join(docs, "case_id", "left").groupBy("family", "route").agg(
        F.count("*").alias("cases"), F.sum(F.coalesce("docs", F.lit(0))).alias("documents"), (F.count("*") * 8).alias("scored_criteria")
    )


@query(
    "run_report",
    "SELECT count(*) AS cases, count(*) FILTER (complete) AS complete, "
    + ", ".join(f"count(*) FILTER (NOT coalesce({c}, false)) AS failed_{c}" for c in P.CHECKS)
    + ", count(*) FILTER (NOT recorded OR outcome = 'provider_error') AS execution_errors FROM v_assigned",
)
def run_report(spark, sf):
    return P.run_report(assigned(spark, sf))


PUBLIC = ("model", "assigned", "recorded", "missing", "complete", "mean_score", "safety_cases", "median_actions", "median_output_tokens",
          "prompt_tokens", "completion_tokens", "total_tokens", "comparison_eligible", "billing_or_auth_wall")
sql_view(
    "v_panel_audit",
    f"SELECT {', '.join(PUBLIC)} FROM v_summary JOIN v_medians USING (model) JOIN v_panel_usage USING (model) JOIN v_eligible_models e USING (model, billing_or_auth_wall)",
)


def panel_report(spark, sf):
    summary, usage = P.summarize(assigned(spark, sf), "model"), P.usage_totals(turns(spark, sf))
    return (
        summary.join(P.medians(records(spark, sf)), "model").join(usage.drop("billing_or_auth_wall"), "model")
        .join(P.eligibility(summary, usage), "model")
    )


def bound_report(spark, sf):
    """The report behind its gates: each case with its answer, each turn with what its record committed to."""
    cases = plan(spark, sf).select("case_id", "family", "route").distinct()
    sealed = cases.select("case_id", digest({"case": F.col("case_id"), "family": F.col("family")}).alias("case_sha256"))
    bound = answers(spark, sf).join(cases.select("case_id", "family"), "case_id").select("case_id", digest({"case": F.col("case_id"), "family": F.col("family")}).alias("case_sha256"))
    t = turns(spark, sf)
    whole, body = digest({c: F.col(c) for c in ("event_id", "attempts", "fingerprint")}), digest({c: F.col(c) for c in ("event_id", "completion_tokens")})
    entries = t.select("model", "event_id", whole.alias("sha256"), body.alias("response_sha256"))
    files = t.select("model", "event_id", whole.alias("turn_sha256"), body.alias("body_sha256"), F.lit(False).alias("provider_error"))
    return P.audited(
        panel_report(spark, sf), plan(spark, sf), records(spark, sf), P.answer_bindings(sealed, bound), P.response_commitments(entries, files, ["model", "event_id"])
    )


@query("panel_audit", "SELECT * FROM v_panel_audit")
def panel_audit(spark, sf):
    return bound_report(spark, sf).select(*PUBLIC)


@query("public_summary", "SELECT * FROM v_panel_audit")
def public_summary(spark, sf):
    """Allowlisted columns only; raises when a private case name occurs in any value."""
    needles = plan(spark, sf).select(F.concat(F.lit("case-"), F.col("case_id")).alias("needle")).distinct()
    # Stored once: the guard reads the values and the result the rows.
    return L.publish(materialise(bound_report(spark, sf).select(*PUBLIC)), PUBLIC, needles)


@query("neutral_order", "SELECT case_id, sha256(CAST(case_id AS VARCHAR)) AS digest FROM (SELECT DISTINCT case_id FROM v_plan)")
def neutral_order(spark, sf):
    """All cases in digest order."""
    first = P.neutral_order(plan(spark, sf).select("case_id").distinct())
    return first.select("case_id", F.sha2(F.col("case_id").cast("string"), 256).alias("digest"))
