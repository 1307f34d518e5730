"""Queries over claims (orders) and evidence (customers and nations); a task is a customer."""
from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.operators import claims as K
from auditframe.plans.registry import query, sql_view
from auditframe.plans.strategy import load


def evidence(spark, sf):
    """Each customer's nation holds its segment; for even customers the next nation does too."""
    c = load(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nations = F.when(F.col("c_custkey") % 2 == 0, F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25)).otherwise(F.array("c_nationkey"))
    return c.select(
        F.col("c_custkey").alias("task_id"), F.explode(nations).alias("evidence_id"), F.concat(F.lit("customer  "), "c_custkey").alias("subject"),
        F.lit("segment").alias("relation"), F.col("c_mktsegment").alias("object"), F.lit("affirmed").alias("polarity"),
        F.create_map(F.lit("as of"), F.lit("1")).alias("qualifiers"),
    )


def supplied(spark, sf):
    """All evidence a task was given: the nations above and nation 24."""
    e = evidence(spark, sf).select("task_id", "evidence_id")
    last = load(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("task_id"), F.lit(24).alias("evidence_id"))
    return e.unionByName(last).distinct()


def claims(spark, sf):
    o = load(spark, sf, "orders", "o_orderkey", "o_custkey")
    c = load(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    key, own, after = F.col("o_orderkey"), F.col("c_nationkey"), (F.col("c_nationkey") + 1) % 25
    ids = (
        F.when(key % 23 == 0, F.array().cast("array<int>")).when(key % 19 == 0, F.array(own, own))
        .when(key % 17 == 0, F.array(own, F.lit(99))).when(key % 2 == 0, F.array(own, after)).otherwise(F.array(own))
    )
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_custkey").alias("task_id"), key.alias("claim_id"), key.alias("pos"), F.concat(F.lit("customer "), "o_custkey").alias("subject"),
        F.lit("segment").alias("relation"), F.when(key % 7 == 0, "WRONG [x]").otherwise(F.col("c_mktsegment")).alias("object"),
        F.when(key % 11 == 0, "negated").otherwise("affirmed").alias("polarity"),
        F.create_map(F.lit("as of"), F.when(key % 13 == 0, "2").otherwise("1")).alias("qualifiers"), ids.alias("evidence_ids"),
    )


sql_view(
    "v_claims",
    """SELECT o_custkey AS task_id, o_orderkey AS claim_id, c_nationkey AS own, (c_nationkey + 1) % 25 AS nxt, o_custkey % 2 = 0 AS both_hold,
  CASE WHEN o_orderkey % 7 = 0 THEN 'WRONG [x]' ELSE c_mktsegment END AS object, o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS right_words,
  CASE WHEN o_orderkey % 23 = 0 THEN CAST([] AS INTEGER[]) WHEN o_orderkey % 19 = 0 THEN [c_nationkey, c_nationkey] WHEN o_orderkey % 17 = 0 THEN [c_nationkey, 99]
    WHEN o_orderkey % 2 = 0 THEN [c_nationkey, (c_nationkey + 1) % 25] ELSE [c_nationkey] END AS ids FROM orders JOIN customer ON o_custkey = c_custkey""",
)
sql_view(
    "v_support",
    """SELECT task_id, claim_id, right_words AND len(ids) > 0 AND NOT list_contains(ids, 99) AND (both_hold OR NOT list_contains(ids, nxt)) AS supported FROM v_claims""",
)
sql_view(
    "v_citation_problems",
    """SELECT task_id, claim_id, 'empty' AS problem FROM v_claims WHERE len(ids) = 0
UNION ALL SELECT task_id, claim_id, 'repeated' FROM v_claims WHERE len(ids) = 2 AND ids[1] = ids[2]
UNION ALL SELECT task_id, claim_id, 'outside' FROM v_claims WHERE list_contains(ids, 99) OR (list_contains(ids, nxt) AND NOT both_hold AND nxt <> 24)""",
)


@query("claim_support", "SELECT * FROM v_support")
def claim_support(spark, sf):
    return K.claim_support(claims(spark, sf), evidence(spark, sf))


@query("citation_membership", "SELECT * FROM v_citation_problems")
def citation_membership(spark, sf):
    return K.citation_problems(claims(spark, sf), supplied(spark, sf))


sql_view(
    "v_claim_errors",
    """SELECT s.task_id, s.claim_id, CASE WHEN p.shape THEN 'VALIDATION_REJECTED' WHEN p.outside THEN 'EVIDENCE_OUTSIDE_SET' WHEN NOT supported THEN 'UNSUPPORTED_ADDITION' END AS error_code
FROM v_support s LEFT JOIN (SELECT claim_id, bool_or(problem <> 'outside') AS shape, bool_or(problem = 'outside') AS outside FROM v_citation_problems GROUP BY claim_id) p USING (claim_id)""",
)


@query("claim_errors", "SELECT error_code, count(*) AS n FROM v_claim_errors GROUP BY error_code")
def claim_errors(spark, sf):
    return K.claim_errors(claims(spark, sf), evidence(spark, sf), supplied(spark, sf)).groupBy("error_code").agg(F.count("*").alias("n"))


def refusals(spark, sf):
    c = load(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    key = F.col("c_custkey")
    return c.select(
        key.alias("task_id"), F.concat(F.lit("customer "), key).alias("subject"), F.lit("segment").alias("relation"),
        F.when(key % 3 == 0, F.col("c_mktsegment")).otherwise("OTHER").alias("object"), F.lit("affirmed").alias("polarity"),
        F.create_map(F.lit("as of"), F.lit("1")).alias("qualifiers"), F.array("c_nationkey", F.lit(24)).alias("evidence_ids"),
    )


@query(
    "refusal_check",
    """SELECT c_custkey AS task_id, CASE WHEN c_custkey % 3 = 0 THEN 'contradicted' WHEN c_custkey % 5 = 0 THEN 'uncovered' ELSE 'accepted' END AS verdict FROM customer""",
)
def refusal_check(spark, sf):
    coverage = evidence(spark, sf).where("task_id % 5 <> 0").select("task_id", "evidence_id", "subject", "relation", "qualifiers")
    return K.refusal_verdicts(refusals(spark, sf), evidence(spark, sf), coverage)


@query(
    "oracle_match",
    "SELECT task_id, bool_and(claim_id % 29 <> 0) AS oracle_match FROM v_claims GROUP BY task_id",
)
def oracle_match(spark, sf):
    """The expected selection has other ids and says something else for every 29th claim."""
    mine = claims(spark, sf)
    expected = mine.withColumns({
        "object": F.when(F.col("claim_id") % 29 == 0, F.concat("object", F.lit("?"))).otherwise(F.col("object")), "claim_id": -F.col("claim_id"), "pos": -F.col("pos"),
    })
    return K.oracle_match(mine, expected)


def selection_records(spark, sf):
    errors = K.claim_errors(claims(spark, sf), evidence(spark, sf), supplied(spark, sf))
    key = F.col("claim_id")
    done, matched = key % 101 != 0, key % 29 != 0
    good = F.col("error_code").isNull()
    return errors.select(
        key, done.alias("provider_completed"), (done & ~F.coalesce(F.col("error_code") == "VALIDATION_REJECTED", F.lit(False))).alias("selection_schema_valid"),
        (done & good).alias("semantic_valid"), (done & good).alias("rendered_schema_valid"), (good & matched).alias("oracle_match"),
        F.when(done, F.coalesce("error_code", F.when(~matched, "ORACLE_MISMATCH"))).alias("error_code"),
    )


@query(
    "acceptance_gates",
    """SELECT *, n AS attempted_calls, false AS gate_exact_calls, completion_rate >= 0.99 AS gate_minimum_completed, schema_valid_selections = completed_calls AS gate_schema_valid,
  semantic_valid_selections = completed_calls AS gate_semantically_valid, unmatched = 0 AS gate_match_oracle, rendered_schema_valid_objects = completed_calls AS gate_rendered_valid,
  evidence_outside_set = 0 AS gate_no_outside_evidence, unsupported_additions = 0 AS gate_no_unsupported_additions, rejected_refusals = 0 AS gate_no_rejected_refusals,
  true AS gate_real_provider, true AS gate_frozen_task_set, 'FAIL' AS status FROM (
  SELECT count(*) AS n, count(*) FILTER (done) AS completed_calls, count(*) FILTER (done AND NOT shape) AS schema_valid_selections, count(*) FILTER (done AND good) AS semantic_valid_selections,
    count(*) FILTER (done AND good) AS rendered_schema_valid_objects, count(*) FILTER (done AND error_code = 'EVIDENCE_OUTSIDE_SET') AS evidence_outside_set,
    count(*) FILTER (done AND error_code = 'UNSUPPORTED_ADDITION') AS unsupported_additions, 0::BIGINT AS rejected_refusals, count(*) FILTER (done AND shape) AS other_validation_rejections,
    count(*) FILTER (done AND good AND NOT matched) AS oracle_mismatches, count(*) FILTER (done AND NOT (good AND matched)) AS unmatched,
    round_even(count(*) FILTER (done) / count(*), 9) AS completion_rate, round_even(count(*) FILTER (done AND NOT shape) / count(*) FILTER (done), 9) AS schema_valid_selection_rate,
    round_even(count(*) FILTER (done AND good) / count(*) FILTER (done), 9) AS rendered_schema_valid_rate
  FROM (SELECT *, claim_id % 101 <> 0 AS done, claim_id % 29 <> 0 AS matched, error_code IS NULL AS good, coalesce(error_code = 'VALIDATION_REJECTED', false) AS shape FROM v_claim_errors))""".replace(
        "SELECT *, n AS attempted_calls", "SELECT * EXCLUDE (n, unmatched), n AS attempted_calls"
    ),
)
def acceptance_gates(spark, sf):
    out = K.acceptance(selection_records(spark, sf), required_calls=500, minimum_rate=0.99, real_provider=True, frozen=True)
    return out.withColumns({c: F.bround(c, 9) for c in out.columns if c.endswith("_rate")})


@query(
    "coverage_counts",
    """SELECT c_mktsegment AS category, count(*) AS found, count(*) + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE -1 END AS expected
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""",
)
def coverage_counts(spark, sf):
    """The expected table is off for two segments."""
    tasks = load(spark, sf, "customer", F.col("c_mktsegment").alias("category"))
    off = F.when(F.col("category") == "BUILDING", 1).when(F.col("category") == "MACHINERY", -1).otherwise(0)
    expected = tasks.groupBy("category").agg(F.count("*").alias("n")).select("category", (F.col("n") + off).alias("n"))
    return K.coverage_differences(tasks, expected, ["category"])


sql_view(
    "v_markers",
    """SELECT task_id, evidence_id, row_number() OVER (PARTITION BY task_id ORDER BY first) AS marker_number, claims FROM (
  SELECT task_id, evidence_id, min(claim_id * 32 + i) AS first, count(DISTINCT claim_id) AS claims FROM (
    SELECT task_id, claim_id, unnest(ids) AS evidence_id, unnest(range(len(ids))) AS i FROM v_claims) GROUP BY ALL)""",
)


@query("citation_markers", "SELECT *, '[' || marker_number || ']' AS marker, 'citation-' || CASE WHEN marker_number < 1000 THEN lpad(CAST(marker_number AS VARCHAR), 3, '0') ELSE CAST(marker_number AS VARCHAR) END AS citation_id FROM v_markers")
def citation_markers(spark, sf):
    return K.citation_markers(claims(spark, sf))


@query(
    "marker_claims",
    """SELECT DISTINCT c.task_id, m.evidence_id, c.claim_id, '[' || m.marker_number || ']' AS marker FROM v_claims c JOIN v_markers m ON m.task_id = c.task_id AND list_contains(c.ids, m.evidence_id)""",
)
def marker_claims(spark, sf):
    c = claims(spark, sf)
    return K.marker_claims(c, K.citation_markers(c))


@query(
    "rendered_claims",
    """SELECT task_id, claim_id, 'customer ' || task_id || CASE WHEN claim_id % 11 = 0 THEN ' does not segment ' ELSE ' segment ' END ||
  CASE WHEN claim_id % 7 = 0 THEN 'WRONG (x)' ELSE object END || ' (as of=' || CASE WHEN claim_id % 13 = 0 THEN '2' ELSE '1' END || '). ' || string_agg('[' || marker_number || ']', ' ' ORDER BY i) AS sentence
FROM (SELECT *, unnest(ids) AS evidence_id, unnest(range(len(ids))) AS i FROM v_claims) JOIN v_markers USING (task_id, evidence_id) GROUP BY task_id, claim_id, object""",
)
def rendered_claims(spark, sf):
    c = claims(spark, sf)
    return K.rendered_claims(c, K.citation_markers(c))


@query(
    "refusal_sentences",
    """SELECT c_custkey AS task_id, 'The supplied evidence does not establish that customer ' || c_custkey || ' segment ' ||
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'OTHER' END || '. [1] ' || CASE WHEN c_nationkey = 24 THEN '[1]' ELSE '[2]' END AS sentence FROM customer""",
)
def refusal_sentences(spark, sf):
    r = refusals(spark, sf)
    return K.rendered_refusals(r, K.citation_markers(K.cited_refusals(r)))


@query(
    "refusal_citations",
    """SELECT c_custkey AS task_id, e AS evidence_id, i AS marker_number, '[' || i || ']' AS marker, 'citation-00' || i AS citation_id, 0::BIGINT AS claims
FROM (SELECT c_custkey, unnest(list_distinct([c_nationkey])) AS e, 1::BIGINT AS i FROM customer UNION ALL SELECT c_custkey, 24, 2 FROM customer WHERE c_nationkey <> 24)""",
)
def refusal_citations(spark, sf):
    return K.citation_markers(K.cited_refusals(refusals(spark, sf)))


@query(
    "forbidden_additions",
    "SELECT c_custkey AS task_id, c_custkey % 41 <> 0 AS rejected FROM customer",
)
def forbidden_additions(spark, sf):
    """Adds a wrong proposition to each task; every 41st task gets one that is in fact supported."""
    e = evidence(spark, sf).groupBy("task_id", "subject", "relation", "object", "polarity").agg(
        F.min("evidence_id").alias("_e"), F.any_value("qualifiers").alias("qualifiers")
    )
    good = e.select("task_id", F.lit(1).alias("claim_id"), F.lit(1).alias("pos"), *K.PROPOSITION, "qualifiers", F.array("_e").alias("evidence_ids"))
    wrong = good.withColumn("object", F.when(F.col("task_id") % 41 == 0, F.col("object")).otherwise("FORBIDDEN"))
    return K.rejected_additions(good, wrong, evidence(spark, sf))
