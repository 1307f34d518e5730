"""Queries over files, manifests, lineage, provenance and certificates."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.functions import digest_tree
from auditframe.functions.canon import canonical_json, digest, digest_matches, hours_between, iso_text, iso_timestamp, map_key
from auditframe.functions.ordered import union_all
from auditframe.operators import audit as A
from auditframe.operators import evidence as E
from auditframe.operators import leak as L
from auditframe.operators.sensitivity import patch_library
from auditframe.operators.strategy import free_run_metrics, provider_usage
from auditframe.plans.contract import episode_tables
from auditframe.plans.leak import docs, files
from auditframe.plans.registry import query, sql_view, tree_sql
from auditframe.plans.strategy import load, outcomes, telemetry, turns
from auditframe.session import materialise, shared_dir
from auditframe.sources import exports as X
from auditframe.sources import files as S
from auditframe.sources import manifests as M


def fresh(spark, name):
    """A new path in the shared folder for a query that writes before it reads."""
    return f"{shared_dir(spark)}/auditframe/{name}-{uuid.uuid4().hex}"


# --- manifests ------------------------------------------------------------------------
def assets(spark, sf):
    d = docs(spark, sf, "doc_id", "source", "text")
    return d.select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


def listed(spark, sf):
    """The manifest: every 53rd hash altered, every 59th entry dropped, every 61st listed twice, every 67th size off."""
    a = assets(spark, sf).where("doc_id % 59 <> 0")
    key = F.col("doc_id")
    times = F.sequence(F.lit(1), F.when(key % 61 == 0, 2).otherwise(1))
    return a.select(
        "path", (F.col("bytes") + F.when(key % 67 == 0, 1).otherwise(0)).alias("bytes"), F.when(key % 53 == 0, "0").otherwise(F.col("sha256")).alias("sha256"), F.explode(times).alias("_i")
    ).drop("_i")


sql_view(
    "v_manifest_problems",
    """SELECT source || '/' || doc_id AS path, unnest(list_filter([CASE WHEN doc_id % 59 = 0 THEN 'unlisted' END, CASE WHEN doc_id % 61 = 0 AND doc_id % 59 <> 0 THEN 'duplicate' END,
  CASE WHEN doc_id % 67 = 0 AND doc_id % 59 <> 0 THEN 'size differs' END, CASE WHEN doc_id % 53 = 0 AND doc_id % 59 <> 0 THEN 'hash differs' END], lambda x: x IS NOT NULL)) AS reason FROM documents""",
)


@query("manifest_diff", "SELECT * FROM v_manifest_problems")
def manifest_diff(spark, sf):
    return M.manifest_problems(listed(spark, sf), assets(spark, sf))


sql_view("v_assets", "SELECT doc_id, source || '/' || doc_id AS path, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents")
sql_view("v_asset_tree", tree_sql("SELECT path AS name, bytes || '|' || sha256 AS value FROM v_assets"))


@query("manifest_proofs", "SELECT path, doc_id % 53 <> 0 AND doc_id % 67 <> 0 AND doc_id % 59 <> 0 AS listed FROM v_assets")
def manifest_proofs(spark, sf):
    """Which files the published root of the manifest proves to be listed as they are."""
    manifest = listed(spark, sf).distinct()
    return M.listed_assets(assets(spark, sf).drop("doc_id"), manifest).select("path", "listed")


@query(
    "manifest_digest",
    """SELECT count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, (SELECT root FROM v_asset_tree) AS root FROM v_assets""",
)
def manifest_digest(spark, sf):
    return M.manifest_summary(assets(spark, sf))


@query(
    "reproducibility_diff",
    """SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 59 = 0 THEN 'only first' WHEN doc_id % 71 = 0 THEN 'only second' ELSE 'differs' END AS problem
FROM documents WHERE (doc_id % 59 = 0) <> (doc_id % 71 = 0) OR (doc_id % 53 = 0 AND doc_id % 59 <> 0)""",
)
def reproducibility_diff(spark, sf):
    a = assets(spark, sf)
    second = a.where("doc_id % 59 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 53 == 0, "0").otherwise(F.col("sha256")))
    return M.reproducibility_problems(a.where("doc_id % 71 <> 0"), second)


@query(
    "lineage_overlap",
    """SELECT field, value FROM (SELECT 'lang' AS field, lang AS value FROM documents WHERE doc_id % 5 <> 0 UNION SELECT 'source', source FROM documents WHERE doc_id % 5 <> 0
  UNION SELECT 'n_chars', CAST(n_chars AS VARCHAR) FROM documents WHERE doc_id % 5 <> 0) INTERSECT
SELECT field, value FROM (SELECT 'lang' AS field, lang AS value FROM documents WHERE doc_id % 5 = 0 UNION SELECT 'source', source FROM documents WHERE doc_id % 5 = 0
  UNION SELECT 'n_chars', CAST(n_chars AS VARCHAR) FROM documents WHERE doc_id % 5 = 0)""",
)
def lineage_overlap(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "lang", "source", "n_chars")
    return E.overlapping_values(d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0"), ["lang", "source", "n_chars"])


@query(
    "commitment_binding",
    """SELECT CAST(doc_id AS VARCHAR) AS subject, CASE WHEN doc_id % 43 = 0 THEN 'not_recomputed' WHEN doc_id % 47 = 0 THEN 'not_recorded' ELSE 'differs' END AS problem
FROM documents WHERE (doc_id % 43 = 0) <> (doc_id % 47 = 0) OR (doc_id % 53 = 0 AND doc_id % 43 <> 0)""",
)
def commitment_binding(spark, sf):
    a = docs(spark, sf, "doc_id", "text").select("doc_id", F.col("doc_id").cast("string").alias("subject"), F.sha2("text", 256).alias("sha256"))
    recorded = a.where("doc_id % 47 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 53 == 0, "0").otherwise(F.col("sha256")))
    return E.commitment_problems(recorded, a.where("doc_id % 43 <> 0"))


@query(
    "span_hash",
    """SELECT doc_id AS artifact_id, sha256(encode(text)[a + 1:a + 40]) AS actual_sha256, doc_id % 37 <> 0 AS matches FROM (SELECT *, doc_id % 10 AS a FROM documents)""",
)
def span_hash(spark, sf):
    d = docs(spark, sf, "doc_id", "text")
    artifacts = d.select(F.col("doc_id").alias("artifact_id"), F.encode("text", "UTF-8").alias("content"))
    start = F.col("doc_id") % 10
    cut = F.substring(F.encode("text", "UTF-8"), start.cast("int") + 1, F.lit(40))
    spans = d.select(
        F.col("doc_id").alias("artifact_id"), start.cast("int").alias("byte_start"), (start + 40).cast("int").alias("byte_end"),
        F.when(F.col("doc_id") % 37 == 0, "0").otherwise(F.sha2(cut, 256)).alias("text_sha256"),
    )
    return E.span_hashes(spans, artifacts).select("artifact_id", "actual_sha256", "matches")


# --- digests and time ----------------------------------------------------------------------
@query(
    "canonical_digest",
    """SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"key":' || o_orderkey || ',"note":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END || ',"roles":{"a":"' || o_orderstatus || '","b":"x"}}') AS digest,
  o_orderkey % 41 <> 0 AS self_digest_ok FROM orders""",
)
def canonical_digest(spark, sf):
    o = load(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey")
    roles = F.from_json(map_key(F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("o_orderstatus"))), "struct<a:string,b:string>")
    fields = {"key": key, "customer": F.col("o_custkey"), "note": F.when(key % 3 != 0, F.col("o_orderpriority")), "roles": roles}
    recorded = F.when(key % 41 == 0, "0").otherwise(digest(fields))
    return o.select("o_orderkey", digest(fields).alias("digest"), digest_matches(recorded, fields).alias("self_digest_ok"))


@query(
    "time_math",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS shown,
  CASE WHEN o_orderkey % 5 <> 0 THEN date_diff('hour', TIMESTAMP '1995-01-01', o_orderdate)::DOUBLE END AS hours FROM orders""",
)
def time_math(spark, sf):
    """Every fifth timestamp lacks its zone and is refused."""
    o = load(spark, sf, "orders", "o_orderkey", "o_orderdate")
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    at = iso_timestamp(F.when(F.col("o_orderkey") % 5 == 0, text).otherwise(F.concat(text, F.lit("Z"))))
    start = F.lit("1995-01-01T00:00:00Z").cast("timestamp")
    return o.select("o_orderkey", iso_text(at).alias("shown"), hours_between(start, at).alias("hours"))


# --- provenance and certificates ----------------------------------------------------------
sql_view(
    "v_provenance",
    """SELECT run_id, episode_id, count(*) FILTER (outcome = 'APPLIED') AS applied, count(*) FILTER (category = 'ungrounded') AS ungrounded FROM v_turns GROUP BY ALL""",
)


@query(
    "provenance",
    """SELECT run_id, episode_id, applied AS applied_actions, ungrounded AS ungrounded_rejected, CASE WHEN applied > 0 THEN 1.0::DOUBLE END AS provenance_completeness FROM v_provenance""",
)
def provenance(spark, sf):
    return E.provenance(turns(spark, sf))


@query(
    "provenance_summary",
    """SELECT run_id, round_even(avg(CASE WHEN applied > 0 THEN 1.0::DOUBLE END), 4) AS mean_completeness, count(*) FILTER (applied > 0) AS episodes_with_actions,
  CAST(sum(ungrounded) AS BIGINT) AS ungrounded_rejected, CASE WHEN count(*) FILTER (applied > 0) > 0 THEN 'evidenced' ELSE 'not_evidenced' END AS status FROM v_provenance GROUP BY run_id""",
)
def provenance_summary(spark, sf):
    return E.provenance_summary(E.provenance(turns(spark, sf)))


_scope = ", ".join(f"'{c}'" for c in E.SCOPE_CATEGORIES)
sql_view(
    "v_scope",
    f"""SELECT run_id, n AS attempted, n AS rejected, slipped, hidden AS hidden_field_probes, canary AS canary_echoes, CASE WHEN slipped IS NOT NULL THEN 'evidenced' ELSE 'not_evidenced' END AS status FROM (
  SELECT run_id, CAST(sum(state_changes_outside_contract) AS BIGINT) AS slipped, CAST(sum(forbidden_output_keys) AS BIGINT) AS hidden, CAST(sum(canary_echoes) AS BIGINT) AS canary FROM v_outcomes GROUP BY run_id)
JOIN (SELECT run_id, count(*) AS n FROM v_turns WHERE category IN ({_scope}) GROUP BY run_id) USING (run_id)""",
)


def run_metrics(spark, sf):
    return outcomes(spark, sf).groupBy("run_id").agg(
        F.sum("state_changes_outside_contract").alias("state_changes_outside_contract"), F.sum("forbidden_output_keys").alias("forbidden_output_keys"), F.sum("canary_echoes").alias("canary_echoes")
    )


@query("scope_violations", "SELECT * FROM v_scope")
def scope_violations(spark, sf):
    return E.scope_violations(turns(spark, sf), run_metrics(spark, sf))


@query(
    "scope_attempts",
    f"SELECT run_id, episode_id, turn, category, error FROM v_turns WHERE category IN ({_scope})",
)
def scope_attempts(spark, sf):
    return E.scope_attempts(turns(spark, sf)).select("run_id", "episode_id", "turn", "category", "error")


def logs(spark, sf):
    """Logs of runs: a run is a conversation, its files are its turns; the first five have the names of the logs, the others their number."""
    c = load(spark, sf, "conversations", "conv_id", "turn", "text")
    names = F.array(*[F.lit(n) for n in E.EXPECTED_LOGS])
    name = F.when(F.col("turn") < len(E.EXPECTED_LOGS), names[F.col("turn").cast("int")]).otherwise(F.concat(F.lit("turn-"), F.col("turn"), F.lit(".json")))
    found = c.select(F.col("conv_id").alias("run_id"), name.alias("file"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    expected = found.select("run_id").distinct().select("run_id", F.explode(names).alias("file")).unionByName(found.select("run_id", "file")).distinct()
    return E.log_manifest(expected, found)


sql_view(
    "v_logs",
    f"""SELECT r.run_id, n.file, octet_length(encode(c.text)) AS bytes, sha256(c.text) AS sha256, CASE WHEN c.text IS NULL THEN 'not_evidenced' ELSE 'evidenced' END AS status
FROM (SELECT DISTINCT conv_id AS run_id FROM conversations) r CROSS JOIN (SELECT unnest({list(E.EXPECTED_LOGS)}) AS file, unnest(range(5)) AS i) n LEFT JOIN conversations c ON c.conv_id = r.run_id AND c.turn = n.i
UNION ALL SELECT conv_id, 'turn-' || turn || '.json', octet_length(encode(text)), sha256(text), CASE WHEN text IS NULL THEN 'not_evidenced' ELSE 'evidenced' END FROM conversations WHERE turn >= 5""",
)


@query("log_manifest", "SELECT * FROM v_logs")
def log_manifest(spark, sf):
    return logs(spark, sf)


@query(
    "requirement_status",
    """SELECT run_id, requirement, CASE WHEN bool_or(status = 'evidenced') THEN 'evidenced' ELSE 'not_evidenced' END AS status FROM (
  SELECT run_id, 'D003' AS requirement, status FROM v_scope UNION ALL SELECT run_id, 'E015', status FROM v_logs
  UNION ALL SELECT run_id, 'D001', CASE WHEN count(*) FILTER (applied > 0) > 0 THEN 'evidenced' ELSE 'not_evidenced' END FROM v_provenance GROUP BY run_id) GROUP BY ALL""",
)
def requirement_status(spark, sf):
    t = turns(spark, sf)
    return E.requirement_status({
        "D001": E.provenance_summary(E.provenance(t)), "D003": E.scope_violations(t, run_metrics(spark, sf)), "E015": logs(spark, sf),
    })


def arm_results(spark, sf):
    """Five arms per user, three of which a certificate needs; an arm without a decision has a NULL result."""
    e = load(spark, sf, "events", "user_id", "event_type")
    kind = F.col("event_type")
    arm = F.when(kind == "click", E.CERTIFICATE_ARMS[0]).when(kind == "purchase", E.CERTIFICATE_ARMS[1]).when(kind == "view", E.CERTIFICATE_ARMS[2]).otherwise(kind)
    user = F.col("user_id")
    result = F.when((user % 7 == 0) & (F.col("event_type") == "view"), None).otherwise(~((user % 5 == 0) & (F.col("event_type") == "purchase")))
    return e.select(user.alias("episode_id"), arm.alias("arm_id"), result.alias("result")).distinct()


sql_view(
    "v_certificates",
    """SELECT *, CASE WHEN oracle_passes AND unaided_fails AND naive_retrieval_fails THEN 'ISSUED' ELSE 'NOT_ISSUED' END AS status,
  (oracle_passes IS NULL)::INT + (unaided_fails IS NULL)::INT + (naive_retrieval_fails IS NULL)::INT AS missing_arms FROM (
  SELECT user_id AS episode_id, bool_and(true) FILTER (event_type = 'click') AS oracle_passes, bool_and(user_id % 5 <> 0) FILTER (event_type = 'purchase') AS unaided_fails,
    bool_and(true) FILTER (event_type = 'view' AND user_id % 7 <> 0) AS naive_retrieval_fails FROM events GROUP BY user_id)""",
)


@query("certificates", "SELECT * FROM v_certificates")
def certificates(spark, sf):
    return E.certificates(arm_results(spark, sf))


@query("certificate_ledger", "SELECT status, count(*) AS episodes, CAST(sum(missing_arms) AS BIGINT) AS missing_results FROM v_certificates GROUP BY status")
def certificate_ledger(spark, sf):
    return E.certificate_ledger(E.certificates(arm_results(spark, sf)))


@query(
    "set_variation",
    """SELECT count(*) AS episode_count, 1::BIGINT AS distinct_authorization_maps, count(DISTINCT patches) AS distinct_patch_blocks, count(DISTINCT traps) AS distinct_trap_blocks,
  count(DISTINCT graph) AS distinct_action_graphs, count(DISTINCT s) AS surface_counts, count(DISTINCT n) AS event_counts,
  count(DISTINCT r + 1) AS role_counts FROM (SELECT b.episode_id, string_agg((k % 3) || '|' || event_type || role, ',' ORDER BY pos) AS graph, count(DISTINCT k % 3) AS s, count(*) AS n, count(DISTINCT role) AS r,
    coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (is_dup), '') AS traps,
    (count(*) FILTER (NOT is_dup), count(*) FILTER (NOT is_dup AND event_type = 'purchase'), count(*) FILTER (NOT is_dup AND event_id <> first_id), count(*) >= 2) AS patches FROM v_ep_base b GROUP BY b.episode_id)""",
)
def set_variation(spark, sf):
    """Every repeated request is a trap; its detector is named after the event's kind."""
    t = episode_tables(spark, sf, faults=False, stored=True)
    traps = t["events"].where("duplicate_of is not null").select("episode_id", F.split("action", "_")[0].alias("detector"))
    return E.set_variation(t["episodes"], t["events"], t["entities"], t["authorizations"], patch_library(A.linked(A.lanes(t))), traps)


# --- lineage and export ---------------------------------------------------------------------
def relations(spark, sf):
    """Typed relations between orders (trades), customers, nations and parts."""
    o = load(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    li = load(spark, sf, "lineitem", "l_orderkey", "l_suppkey")
    trade = F.concat(F.lit("t"), F.col("o_orderkey"))
    client = o.where("o_orderkey % 10 <> 0").select(trade.alias("source_id"), F.lit("for_client").alias("predicate"), F.concat(F.lit("c"), "o_custkey").alias("target_id"))
    booked = li.select(F.concat(F.lit("t"), "l_orderkey").alias("source_id"), F.lit("booked_to").alias("predicate"), F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("target_id")).distinct()
    concerns = o.where("o_orderstatus = 'F'").select(F.concat(F.lit("k"), F.col("o_orderkey") % 100).alias("source_id"), F.lit("concerns").alias("predicate"), trade.alias("target_id"))
    return client.unionByName(booked).unionByName(concerns)


def trades(spark, sf):
    return load(spark, sf, "orders", "o_orderkey").select(F.concat(F.lit("t"), "o_orderkey").alias("trade_id"))


sql_view(
    "v_booked",
    "SELECT l_orderkey, 's' || any_value(l_suppkey % 3) AS target_id FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey % 3) = 1",
)
sql_view(
    "v_related",
    """SELECT 't' || o_orderkey AS trade_id, 't' || o_orderkey AS entity_id FROM orders UNION SELECT 't' || o_orderkey, 'c' || o_custkey FROM orders WHERE o_orderkey % 10 <> 0
UNION SELECT 't' || l_orderkey, target_id FROM v_booked JOIN orders ON o_orderkey = l_orderkey UNION SELECT 't' || o_orderkey, 'k' || (o_orderkey % 100) FROM orders WHERE o_orderstatus = 'F'""",
)


@query(
    "relation_targets",
    """SELECT 't' || l_orderkey AS source_id, 'booked_to' AS predicate, target_id FROM v_booked UNION ALL SELECT 't' || o_orderkey, 'for_client', 'c' || o_custkey FROM orders WHERE o_orderkey % 10 <> 0""",
)
def relation_targets(spark, sf):
    return E.unique_targets(relations(spark, sf).where("predicate <> 'concerns'"))


def links(spark, sf):
    return E.related(trades(spark, sf), relations(spark, sf), ["for_client", "booked_to", "uses_product"], "concerns")


def atoms(spark, sf):
    """Two atoms per customer and one per complaint group."""
    c = load(spark, sf, "customer", "c_custkey")
    own = c.select(F.explode(F.array(F.concat(F.lit("a"), "c_custkey"), F.concat(F.lit("b"), "c_custkey"))).alias("atom_id"), F.concat(F.lit("c"), "c_custkey").alias("subject_id"))
    groups = load(spark, sf, "orders", "o_orderkey").select(F.concat(F.lit("k"), F.col("o_orderkey") % 100).alias("subject_id")).distinct()
    return own.unionByName(groups.select(F.concat(F.lit("x"), "subject_id").alias("atom_id"), "subject_id"))


sql_view(
    "v_atoms",
    """SELECT DISTINCT trade_id, CASE WHEN entity_id[1] = 'k' THEN 'x' || entity_id ELSE p || entity_id[2:] END AS atom_id
FROM v_related CROSS JOIN (SELECT unnest(['a', 'b']) AS p) WHERE entity_id[1] IN ('c', 'k')""",
)


@query("related_atoms", "SELECT * FROM v_atoms")
def related_atoms(spark, sf):
    return E.related_atoms(links(spark, sf), atoms(spark, sf))


@query(
    "evidence_select",
    """WITH RECURSIVE c AS (SELECT o_orderkey AS consumer, o_orderkey % 5 AS surface, row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) AS k FROM orders),
s AS (SELECT c_custkey AS span, c_custkey % 5 AS surface FROM customer),
d AS (SELECT DISTINCT c.consumer, s.span FROM c JOIN v_atoms a ON a.trade_id = 't' || c.consumer JOIN s ON s.surface = c.surface AND a.atom_id = 'a' || (s.span % 50)),
r AS (SELECT DISTINCT surface, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS consumer, NULL::BIGINT AS span, NULL::BOOLEAN AS direct FROM c
  UNION ALL SELECT surface, k + 1, list_append(used, pick.span), consumer, pick.span, pick.tier = 0 FROM (
    SELECT r.surface, r.k, r.used, c.consumer, min({'tier': CASE WHEN d.span IS NULL THEN 1 ELSE 0 END, 'span': s.span}) AS pick
    FROM r JOIN c ON c.surface = r.surface AND c.k = r.k + 1 JOIN s ON s.surface = r.surface AND NOT list_contains(r.used, s.span) LEFT JOIN d ON d.consumer = c.consumer AND d.span = s.span
    GROUP BY r.surface, r.k, r.used, c.consumer))
SELECT c.surface, c.consumer, r.span, CASE WHEN r.direct THEN 'entity_direct' WHEN r.span IS NOT NULL THEN 'surface_context' END AS support_scope FROM c LEFT JOIN r USING (surface, consumer)""",
)
def evidence_select(spark, sf):
    """Orders choose spans of their surface greedily; span i holds the atom of customer i % 50."""
    consumers = load(spark, sf, "orders", F.col("o_orderkey").alias("consumer")).withColumn("surface", F.col("consumer") % 5)
    spans = load(spark, sf, "customer", F.col("c_custkey").alias("span")).withColumn("surface", F.col("span") % 5)
    held = spans.select("span", F.concat(F.lit("a"), F.col("span") % 50).alias("atom_id"))
    wanted = E.related_atoms(links(spark, sf), atoms(spark, sf)).select(F.expr("cast(substring(trade_id, 2) AS bigint)").alias("consumer"), "atom_id")
    return E.assign_spans(consumers, spans, wanted, held)


@query(
    "split_disjoint",
    """SELECT side, o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY o_orderkey) AS rn FROM orders JOIN (
  SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY c_custkey) <= count(*) OVER () // 2 THEN 'train' ELSE 'transfer' END AS side FROM customer) ON c_custkey = o_custkey) WHERE rn <= 2""",
)
def split_disjoint(spark, sf):
    sides = E.client_sides(load(spark, sf, "customer", "c_custkey"), "c_custkey")
    o = load(spark, sf, "orders", "o_orderkey", "o_custkey")
    return E.first_per_side(o.join(sides, o.o_custkey == sides.c_custkey).drop("c_custkey"), "o_orderkey")


sql_view("v_sides", "SELECT c_custkey AS client, CASE WHEN row_number() OVER (ORDER BY c_custkey) <= count(*) OVER () // 2 THEN 'train' ELSE 'transfer' END AS side FROM customer")
sql_view("v_export_atoms", tree_sql("""SELECT '{"atom_id":"' || atom_id || '","trade_id":"' || trade_id || '"}' AS name FROM (SELECT DISTINCT trade_id, atom_id FROM v_atoms)""", with_value=False))
sql_view("v_export_sides", tree_sql("""SELECT '{"client":' || client || ',"side":"' || side || '"}' AS name FROM v_sides""", with_value=False))


@query(
    "evidence_export",
    """SELECT 'atoms' AS name, leaves AS rows, root, (SELECT count(DISTINCT atom_id) FROM v_atoms) AS read FROM v_export_atoms
UNION ALL SELECT 'sides', leaves, root, (SELECT count(DISTINCT side) FROM v_sides) FROM v_export_sides""",
)
def evidence_export(spark, sf):
    """Lineage tables written under one commit, its manifest, and what a reader finds behind it."""
    target = fresh(spark, "export")
    sides = E.client_sides(load(spark, sf, "customer", F.col("c_custkey").alias("client")), "client")
    manifest = X.write_export({"atoms": E.related_atoms(links(spark, sf), atoms(spark, sf)), "sides": sides}, target, "first")
    read = [
        X.read_export(spark, target, "first", name).agg(F.count_distinct(column).alias("read")).select(F.lit(name).alias("name"), "read")
        for name, column in (("atoms", "atom_id"), ("sides", "side"))
    ]
    return manifest.select("name", "rows", "root").join(union_all(read), "name")


# --- audits over files --------------------------------------------------------------------------
@query(
    "release_audit",
    """SELECT gate, hits, CASE WHEN hits > 0 THEN 'FAIL' ELSE 'PASS' END AS status, 'PRIVATE_GOLD_LEAK' AS terminal_state FROM (
  SELECT 'private_gold_leak' AS gate, count(*) AS hits FROM v_gold_leaks UNION ALL SELECT 'secret_scan', 0 UNION ALL SELECT 'internal_identifier_scan', 0
  UNION ALL SELECT 'source_shingle_overlap', count(DISTINCT key) FROM v_sh10_docs WHERE shingle IN (SELECT shingle FROM v_sh10_bench)
  UNION ALL SELECT 'path_metadata_scan', 0 UNION ALL SELECT 'manifest_verification', count(*) FROM v_manifest_problems)""",
)
def release_audit(spark, sf):
    b = load(spark, sf, "benchmark", F.col("item_id").alias("corpus_id"), "text")
    gates = materialise(L.release_gates(files(spark, sf), b, b.select(F.col("text").alias("record")), M.manifest_problems(listed(spark, sf), assets(spark, sf))))
    return gates.crossJoin(F.broadcast(L.terminal_state(gates)))


def registered_runs(spark, sf):
    """Per run: the set it ran, and the root over its episodes that it recorded; run 2 recorded one without every tenth episode."""
    ran = turns(spark, sf).select("run_id", "episode_id").distinct()
    kept = ran.where("run_id <> 2 or episode_id % 10 <> 0")
    return digest_tree.roots(kept, F.col("episode_id"), None, ["run_id"]).select("run_id", F.concat(F.lit("set"), "run_id").alias("set_id"), F.col("root").alias("recorded_root"))


def pack(spark, sf):
    """What is known of each run, from its files, its episodes, its outcomes and its calls."""
    ran = turns(spark, sf).select(F.concat(F.lit("set"), "run_id").alias("set_id"), "episode_id")
    metrics = ("episodes", "completed", "forbidden_output_keys", "canary_echoes", "state_changes_outside_contract", "rejected_requests")
    calls = ("provider_calls", "retry_events", "malformed_responses", "input_tokens", "output_tokens", "cached_tokens")
    return E.pack_rows({
        "artifacts": E.artifact_roots(assets(spark, sf).withColumn("run_id", F.col("doc_id") % 3)),
        "episode_set": E.set_bindings(registered_runs(spark, sf), ran).select("run_id", "set_id", "episodes", "root", "status"),
        "metrics": free_run_metrics(outcomes(spark, sf)).select("run_id", *metrics),
        "usage": provider_usage(telemetry(spark, sf)).select("run_id", *calls),
    })


sql_view("v_pack_files", tree_sql("SELECT doc_id % 3 AS run_id, path AS name, bytes || '|' || sha256 AS value FROM v_assets", "run_id"))
sql_view("v_pack_sets", tree_sql("SELECT DISTINCT run_id, episode_id AS name FROM v_turns", "run_id", with_value=False))
sql_view("v_pack_recorded", tree_sql("SELECT DISTINCT run_id, episode_id AS name FROM v_turns WHERE run_id <> 2 OR episode_id % 10 <> 0", "run_id", with_value=False))
sql_view(
    "v_pack",
    "SELECT section, CAST(subject AS VARCHAR) AS subject, item, coalesce(value, 'UNKNOWN') AS value FROM ("
    + " UNION ALL ".join(
        f"SELECT '{section}' AS section, run_id AS subject, unnest([{', '.join(repr(c) for c in items)}]) AS item, unnest([{', '.join(f'CAST({x} AS VARCHAR)' for x in items.values())}]) AS value FROM {source}"
        for section, items, source in (
            ("artifacts", {"files": "files", "bytes": "bytes", "root": "root"}, "(SELECT doc_id % 3 AS run_id, count(*) AS files, sum(bytes) AS bytes FROM v_assets GROUP BY 1) JOIN v_pack_files USING (run_id)"),
            ("episode_set", {"set_id": "'set' || run_id", "episodes": "s.leaves", "root": "s.root", "status": "CASE WHEN r.root = s.root THEN 'bound' ELSE 'differs' END"}, "v_pack_sets s JOIN v_pack_recorded r USING (run_id)"),
            ("metrics", {c: c for c in ("episodes", "completed", "forbidden_output_keys", "canary_echoes", "state_changes_outside_contract", "rejected_requests")}, "v_run_metrics"),
            ("usage", {c: c for c in ("provider_calls", "retry_events", "malformed_responses", "input_tokens", "output_tokens", "cached_tokens")}, "v_usage"),
        )
    ) + ")",
)
sql_view("v_pack_root", tree_sql("SELECT section || '/=' || subject || '/' || item AS name, value FROM v_pack"))


@query(
    "evidence_pack",
    "SELECT * FROM v_pack UNION ALL SELECT 'pack', '-', 'root', root FROM v_pack_root UNION ALL SELECT 'pack', '-', 'items', CAST(leaves AS VARCHAR) FROM v_pack_root",
)
def evidence_pack(spark, sf):
    """The pack and, in its last rows, the root that commits to it; a value with a forbidden word stops it."""
    rows = materialise(pack(spark, sf))
    words = L.forbidden_words(rows.select(F.xxhash64(*rows.columns).alias("_row"), "value"), "_row", "value", ("ingerest",)).agg(F.count("*").alias("_hits"))
    rows = L.refuse_if(rows, words, "_hits", "forbidden word in an evidence pack")
    head = E.pack_root(rows).select(F.lit("-").alias("run_id"), "root", F.col("leaves").alias("items"))
    return rows.unionByName(E.pack_rows({"pack": head}))


@query(
    "evidence_verify",
    """SELECT section, subject, item, CASE WHEN section = 'usage' AND subject = '1' THEN 'not_committed' ELSE 'diverges' END AS problem FROM v_pack
WHERE (section = 'usage' AND subject = '1') OR (section = 'metrics' AND subject = '0' AND item = 'completed') OR (section = 'artifacts' AND subject = '2' AND item = 'root')
UNION ALL SELECT 'metrics', '9', 'episodes', 'not_recomputed'""",
)
def evidence_verify(spark, sf):
    """A committed pack against the one recomputed: an altered count and root, a section left out, a run that never was."""
    recomputed = materialise(pack(spark, sf))
    section, subject, item = F.col("section"), F.col("subject"), F.col("item")
    altered = ((section == "metrics") & (subject == "0") & (item == "completed")) | ((section == "artifacts") & (subject == "2") & (item == "root"))
    committed = recomputed.where(~((section == "usage") & (subject == "1")))
    committed = committed.withColumn("value", F.when(altered | (item == "files"), F.concat("value", F.lit("1"))).otherwise(F.col("value")))
    stray = recomputed.where("section = 'metrics' and subject = '0' and item = 'episodes'").withColumn("subject", F.lit("9"))
    return E.pack_problems(committed.unionByName(stray), recomputed, moving=["files"])


@query(
    "export_verify",
    """SELECT "check", CAST(sum(n) AS BIGINT) AS violations FROM (SELECT 'manifest' AS "check", count(*) AS n FROM v_manifest_problems UNION ALL SELECT 'span_hash', count(*) FROM documents WHERE doc_id % 37 = 0
  UNION ALL SELECT "check", count(*) FROM v_ep_violations GROUP BY "check" UNION ALL SELECT 'lineage', count(*) FROM (SELECT DISTINCT lang FROM documents)) GROUP BY "check" """,
)
def export_verify(spark, sf):
    """Manifest, span hashes, replayed episodes and lineage of one export, counted per check."""
    d = load(spark, sf, "documents", "doc_id", "lang")
    lineage = E.overlapping_values(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["lang"])

    def named(name, df):
        return df.select(F.lit(name).alias("check"))

    parts = [
        named("manifest", M.manifest_problems(listed(spark, sf), assets(spark, sf))), named("span_hash", span_hash(spark, sf).where(~F.col("matches"))),
        A.audit(episode_tables(spark, sf, stored=True)).select("check"), named("lineage", lineage),
    ]
    return union_all(parts).groupBy("check").agg(F.count("*").alias("violations"))


# --- scans: each writes rows of a table to a new folder and reads them back -------------------
def case_folder(spark, sf):
    o = load(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    key = F.col("o_orderkey")
    documents = F.array(*[
        F.struct(F.concat(F.lit(kind), key).alias("id"), F.lit(kind).alias("kind"), F.when(key % (i + 2) == 0, "ARCHIVED").otherwise("CURRENT").alias("status"))
        for i, kind in enumerate(("policy", "record", "control"))
    ])
    return o.select(key.alias("case_id"), F.col("o_custkey").alias("world_id"), documents.alias("documents"))


@query(
    "case_scan",
    """SELECT o_orderkey AS case_id, i AS pos, (['policy', 'record', 'control'])[i + 1] || o_orderkey AS id, (['policy', 'record', 'control'])[i + 1] AS kind,
  CASE WHEN o_orderkey % (i + 2) = 0 THEN 'ARCHIVED' ELSE 'CURRENT' END AS status FROM orders CROSS JOIN (SELECT unnest(range(3))::INT AS i)""",
)
def case_scan(spark, sf):
    path = fresh(spark, "cases")
    rows = case_folder(spark, sf)
    S.write_json_lines(rows, path)
    return S.documents_of(S.json_lines(spark, path, rows.schema))


@query(
    "case_packages",
    """SELECT c_nationkey AS case_id, c.name AS title, c.n AS customers, c_nationkey % 5 AS folder FROM (SELECT c_nationkey, n_name AS name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) c""",
)
def case_packages(spark, sf):
    """One JSON object per file, in folders whose files have equal names."""
    path = fresh(spark, "packages")
    c = load(spark, sf, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    rows = c.join(load(spark, sf, "nation", "n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
    body = F.to_json(F.struct(F.col("c_nationkey").alias("case_id"), F.struct(F.col("n_name").alias("title"), "customers").alias("data")))
    rows.select(body.alias("value"), (F.col("c_nationkey") % 5).alias("folder"), F.expr("c_nationkey div 5").alias("place")).write.partitionBy("folder", "place").text(path)
    found = S.case_packages(spark, path, "case_id BIGINT, data STRUCT<title: STRING, customers: BIGINT>")
    return found.select("case_id", "data.title", "data.customers", F.regexp_extract("file", "folder=([0-9]+)/", 1).cast("long").alias("folder"))


@query("closed_schema", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'b' ELSE '' END AS missing, CASE WHEN o_orderkey % 11 = 0 THEN 'c' ELSE '' END AS unknown FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def closed_schema(spark, sf):
    o = load(spark, sf, "orders", "o_orderkey", "o_custkey")
    key = F.col("o_orderkey")
    text = F.to_json(F.struct(key.alias("a"), F.when(key % 7 != 0, key).alias("b"), F.when(key % 11 == 0, key).alias("c")))
    problems = S.closed_schema_problems(o.select("o_orderkey", text.alias("t")), "o_orderkey", "t", ["a", "b"])
    return problems.select("o_orderkey", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"))


@query("jsonl_scan", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_scan(spark, sf):
    path = fresh(spark, "lines")
    rows = load(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    S.write_json_lines(rows, path)
    return S.json_lines(spark, path, rows.schema)


@query(
    "strict_jsonl",
    """SELECT file_errors, n FROM (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'blank' WHEN o_orderkey % 17 = 0 THEN 'not_an_object' WHEN o_orderkey % 19 = 0 THEN 'not_canonical' ELSE 'row' END AS file_errors, count(*) AS n FROM orders GROUP BY 1)""",
)
def strict_jsonl(spark, sf):
    path = fresh(spark, "strict")
    o = load(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    key = F.col("o_orderkey")
    good = canonical_json({"key": key, "status": F.col("o_orderstatus")})
    loose = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","key":'), key, F.lit("}"))
    line = F.when(key % 13 == 0, "").when(key % 17 == 0, "[1]").when(key % 19 == 0, loose).otherwise(good)
    o.select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("status", T.StringType())])
    rows, errors = S.strict_json_lines(spark, path, schema)
    kinds = errors.select(F.col("error").alias("file_errors")).unionByName(rows.select(F.lit("row").alias("file_errors")))
    return kinds.groupBy("file_errors").agg(F.count("*").alias("n"))


@query("file_hash", "SELECT CAST(doc_id AS VARCHAR) AS name, octet_length(encode(text)) + 1 AS bytes, sha256(text || chr(10)) AS sha256 FROM documents")
def file_hash(spark, sf):
    path = fresh(spark, "files")
    S.write_files(docs(spark, sf, "doc_id", "text"), path, "doc_id", "text")
    found = S.raw_files(spark, path).where(F.col("path").endswith(".txt"))
    return found.select(F.regexp_extract("path", "name=([0-9]+)[/.]", 1).alias("name"), "bytes", "sha256")


@query("checksum_scan", "SELECT source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents")
def checksum_scan(spark, sf):
    path = fresh(spark, "sums")
    assets(spark, sf).select(F.concat_ws("  ", "sha256", "path").alias("value")).write.text(path)
    return S.checksum_lines(spark, path)


@query("text_scan", "SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY lang")
def text_scan(spark, sf):
    path = fresh(spark, "texts")
    d = docs(spark, sf, "lang", "text")
    d.select(F.col("text").alias("value"), "lang").write.partitionBy("lang").text(path)
    texts = S.text_corpus(spark, path)
    return texts.groupBy("lang").agg(F.sum(F.length("text")).cast("long").alias("chars"))


@query(
    "run_scan",
    """SELECT user_id % 7 AS run_id, count(*) AS episodes, CASE WHEN user_id % 7 = 5 THEN NULL ELSE max(event_id) END AS expected_loss, 'RUN' AS status FROM events WHERE user_id % 7 <> 6 GROUP BY user_id % 7
UNION ALL SELECT 6, NULL, NULL, 'NOT_RUN'""",
)
def run_scan(spark, sf):
    """Seven run folders; run 6 left nothing behind and run 5 has no scores."""
    path = fresh(spark, "runs")
    e = load(spark, sf, "events", "event_id", "user_id").withColumn("run_id", F.col("user_id") % 7)
    summary = e.groupBy("run_id").agg(F.count("*").alias("episodes"), F.max("event_id").alias("expected_loss")).where("run_id <> 6")
    for kind, field, rows in (("metrics", "episodes", summary), ("scores", "expected_loss", summary.where("run_id <> 5"))):
        line = rows.select("run_id", F.lit(kind).alias("kind"), F.to_json(F.struct(field)).alias("value"))
        line.write.mode("append").partitionBy("run_id", "kind").text(path)
    kinds = {"metrics": ("*/kind=metrics", "episodes BIGINT"), "scores": ("*/kind=scores", "expected_loss BIGINT")}
    found = S.run_directories(spark, path, e.select("run_id").distinct(), kinds, "run_id=([0-9]+)/")
    return found.withColumn("run_id", F.col("run_id").cast("long"))


@query("json_roundtrip", "SELECT event_id, user_id, event_type, value FROM events")
def json_roundtrip(spark, sf):
    path = fresh(spark, "roundtrip")
    rows = load(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    S.write_json_lines(rows, path)
    return S.json_lines(spark, path, rows.schema)


@query("errorifexists", "SELECT count(*) AS kept, true AS refused FROM orders")
def errorifexists(spark, sf):
    """A second write to a completed output is refused and leaves the first one as it was."""
    path = fresh(spark, "output")
    rows = load(spark, sf, "orders", "o_orderkey")
    S.write_new(rows, path)
    try:
        S.write_new(rows, path)
        refused = False
    except Exception as error:
        refused = "PATH_ALREADY_EXISTS" in str(error)
    return spark.read.parquet(path).agg(F.count("*").alias("kept")).withColumn("refused", F.lit(refused))
