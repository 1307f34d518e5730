"""Queries over event logs (events), ledgers (lineitem) and histories (orders)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditframe.functions.canon import cents
from auditframe.functions.ordered import CHUNK, neighbour, positions, with_chunks
from auditframe.operators import audit as A
from auditframe.operators import contract as C
from auditframe.operators.sensitivity import sensitivity
from auditframe.plans.registry import query, sql_view, tree_sql
from auditframe.plans.strategy import k_of, load
from auditframe.session import in_buckets, materialise

KINDS = ("click", "error", "purchase", "signup", "view")


# --- complete episodes built from events ------------------------------------------
# An episode is a block of 16 event ids of one run, so it has at most 16 events; the
# windows below stay inside such a block.  Event ids that are multiples of the numbers
# below carry one planted fault each.
def episode_tables(spark, sf, *, faults: bool = True, stored: bool = False):
    e = load(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    key = F.col("event_id")
    block = Window.partitionBy("episode_id")
    turn = block.orderBy("event_id")

    def hit(n: int):
        return (key % n == 0) if faults else F.lit(False)

    d = e.select(
        F.concat(F.lit("e"), F.col("user_id") % 3, F.lit("_"), F.expr("event_id div 16")).alias("episode_id"),
        F.expr("event_id div 16").alias("block"),
        key,
        F.col("ts").cast("timestamp").alias("at"),
        "user_id",
        "event_type",
        cents(F.col("value")).alias("cents"),
        k_of(F.col("props")).alias("k"),
        F.when(F.col("user_id") % 2 == 0, "analyst").otherwise("supervisor").alias("role"),
    ).withColumns({
        "pos": F.row_number().over(turn),
        "previous_id": F.lag("event_id").over(turn),
        "first_id": F.min("event_id").over(block),
    })
    d = d.withColumn("is_duplicate", F.col("pos") % 5 == 0)
    if stored:
        d = in_buckets(d, "episode_id")
    request = F.when(F.col("is_duplicate"), F.col("previous_id")).when(hit(131), F.col("first_id")).otherwise(key)
    receipt = F.when(F.col("is_duplicate"), F.when(hit(109), key).otherwise(F.col("previous_id"))).otherwise(key)
    refs = F.array(F.concat(F.lit("ev"), key), F.concat(F.lit("evk"), F.col("k")))
    events = d.select(
        "episode_id", "pos",
        (F.col("pos") + F.when(hit(101), 1).otherwise(0)).alias("sequence"),
        key, "at",
        F.concat(F.lit("s"), F.col("k") % 3).alias("surface"),
        F.when(hit(103), "ghost").otherwise(F.concat(F.lit("u"), F.col("user_id"))).alias("actor_id"),
        F.concat(F.col("event_type"), F.lit("_"), F.when(hit(107), "nobody").otherwise(F.col("role"))).alias("action"),
        F.concat(F.lit("q"), request).alias("request_id"),
        F.concat(F.lit("rc"), receipt).alias("expected_receipt"),
        F.when(F.col("is_duplicate"), F.col("previous_id")).alias("duplicate_of"),
        F.when(hit(127), F.array().cast("array<string>")).otherwise(refs).alias("evidence_refs"),
    )
    primary = d.where(~F.col("is_duplicate")).withColumn("object_id", F.concat(F.lit("o"), F.col("k") % 3))
    step = F.row_number().over(Window.partitionBy("episode_id", "object_id").orderBy("pos"))
    moved = primary.withColumn("step", step)
    mutations = moved.select(
        "episode_id", F.col("pos").alias("event_pos"), F.lit(0).alias("pos"), "object_id",
        F.concat(F.lit("s"), F.col("step") - 1).alias("from_state"),
        F.concat(F.lit("s"), F.col("step")).alias("to_state"),
        (F.col("step") - 1 + F.when(hit(137), 5).otherwise(0)).alias("from_version"),
        F.col("step").alias("to_version"),
    )
    bought = primary.where(F.col("event_type") == "purchase")
    legs = F.array(
        F.struct(F.lit(0).alias("leg"), F.when(hit(139), "a9").otherwise("a1").alias("account_id"), F.col("cents").alias("amount_minor")),
        F.struct(F.lit(1).alias("leg"), F.lit("a2").alias("account_id"), (F.when(hit(113), 1).otherwise(0) - F.col("cents")).alias("amount_minor")),
    )
    ledger = bought.select("episode_id", F.col("pos").alias("event_pos"), F.lit("USD").alias("currency"), F.explode(legs).alias("x")).select(
        "episode_id", "event_pos", "currency", "x.*"
    )
    heads = d.groupBy("episode_id", "block").agg(F.min("at").alias("window_start"), F.min("event_id").alias("first_id"))
    # Planted: windows of blocks divisible by 37 are one day short of a week.
    days = F.when((F.col("block") % 37 == 0) if faults else F.lit(False), 6).otherwise(10)
    episodes = heads.select(
        "episode_id", "block", "window_start", "first_id",
        F.expr("window_start").alias("_s"), days.alias("_d"),
    ).select("episode_id", "block", "first_id", "window_start", F.timestamp_seconds(F.unix_seconds("_s") + F.col("_d") * 86400).alias("window_end"))
    fixed = F.array(
        F.struct(F.lit("intruder").alias("id"), F.lit("none").alias("role")),
        *[F.struct(F.lit(x).alias("id"), F.lit(None).cast("string").alias("role")) for x in ("a1", "a2", "o0", "o1", "o2")],
    )
    people = d.select("episode_id", F.concat(F.lit("u"), "user_id").alias("id"), "role").distinct()
    entities = people.unionByName(heads.select("episode_id", F.explode(fixed).alias("x")).select("episode_id", "x.*"))
    allowed = F.array(*[
        F.struct(F.lit(f"{kind}_{role}").alias("action"), F.lit(role).alias("role"))
        for kind in KINDS for role in ("analyst", "supervisor")
    ])
    authorizations = heads.select("episode_id", F.explode(allowed).alias("x")).select("episode_id", "x.*")
    objects = heads.select("episode_id", "block", F.explode(F.array(*[F.lit(f"o{i}") for i in range(3)])).alias("object_id"))
    counts = moved.groupBy("episode_id", "object_id").agg(F.count("*").alias("n"))
    ends = objects.join(counts, ["episode_id", "object_id"], "left")
    drift = F.when((F.col("block") % 29 == 0) & (F.col("object_id") == "o0") if faults else F.lit(False), 1).otherwise(0)
    n = F.coalesce("n", F.lit(0)).cast("int")
    initial = objects.select("episode_id", F.lit("initial").alias("which"), "object_id", F.lit("s0").alias("state"), F.lit(0).alias("version"))
    final = ends.select("episode_id", F.lit("final").alias("which"), "object_id", F.concat(F.lit("s"), n).alias("state"), (n + drift).alias("version"))
    first_ref = F.concat(F.lit("ev"), F.col("first_id"))
    lacking = (F.col("block") % 31 == 0) if faults else F.lit(False)
    tests = F.array(
        F.struct(F.lit("c1").alias("challenge_id"), F.array(first_ref).alias("required"),
                 F.when(lacking, F.array().cast("array<string>")).otherwise(F.array(first_ref)).alias("supplied"), F.lit("SUPPORTED").alias("expected_disposition")),
        F.struct(F.lit("c2").alias("challenge_id"), F.array(F.lit("ev_none")).alias("required"),
                 F.array(first_ref).alias("supplied"), F.lit("REFUSE_UNSUPPORTED").alias("expected_disposition")),
    )
    challenges = heads.select("episode_id", F.explode(tests).alias("x")).select("episode_id", "x.*")
    return {
        "episodes": episodes, "events": events, "mutations": mutations, "ledger": ledger, "entities": entities,
        "authorizations": authorizations, "states": initial.unionByName(final), "challenges": challenges,
    }


sql_view(
    "v_ep_base",
    """SELECT *, pos % 5 = 0 AS is_dup, 'o' || (k % 3) AS object_id FROM (
  SELECT 'e' || (user_id % 3) || '_' || (event_id // 16) AS episode_id, event_id // 16 AS block, event_id, ts, user_id, event_type,
    CAST(round(value * 100) AS BIGINT) AS cents, k, CASE WHEN user_id % 2 = 0 THEN 'analyst' ELSE 'supervisor' END AS role,
    row_number() OVER w AS pos, lag(event_id) OVER w AS previous_id,
    min(event_id) OVER (PARTITION BY user_id % 3, event_id // 16) AS first_id
  FROM v_ev WINDOW w AS (PARTITION BY user_id % 3, event_id // 16 ORDER BY event_id))""",
)
sql_view(
    "v_ep_primary",
    "SELECT *, row_number() OVER (PARTITION BY episode_id, object_id ORDER BY pos) AS step FROM v_ep_base WHERE NOT is_dup",
)
sql_view("v_ep_heads", "SELECT episode_id, block, min(event_id) AS first_id, min(ts) AS start FROM v_ep_base GROUP BY episode_id, block")
sql_view(
    "v_ep_refs",
    """SELECT DISTINCT episode_id, unnest(['ev' || event_id, 'evk' || k]) AS ref FROM v_ep_base WHERE event_id % 127 <> 0""",
)
sql_view(
    "v_ep_requests",
    """SELECT episode_id, pos, event_id, is_dup, previous_id,
  CASE WHEN is_dup THEN previous_id WHEN event_id % 131 = 0 THEN first_id ELSE event_id END AS request,
  CASE WHEN is_dup THEN CASE WHEN event_id % 109 = 0 THEN event_id ELSE previous_id END ELSE event_id END AS receipt FROM v_ep_base""",
)
sql_view(
    "v_ep_violations",
    """SELECT episode_id, NULL::VARCHAR AS event_id, 'long_horizon' AS "check" FROM v_ep_heads WHERE block % 37 = 0
UNION ALL SELECT DISTINCT episode_id, NULL, 'challenge' FROM (
  SELECT episode_id FROM v_ep_heads WHERE block % 31 = 0
  UNION ALL SELECT episode_id FROM v_ep_heads h WHERE NOT (block % 31 = 0) AND ('ev' || first_id) NOT IN (SELECT ref FROM v_ep_refs r WHERE r.episode_id = h.episode_id))
UNION ALL SELECT episode_id, NULL, 'challenge' FROM v_ep_heads h WHERE ('ev' || first_id) NOT IN (SELECT ref FROM v_ep_refs r WHERE r.episode_id = h.episode_id)
UNION ALL SELECT episode_id, event_id, 'chronology' FROM (
  SELECT episode_id, event_id, pos + (event_id % 101 = 0)::INT AS s, lag(pos + (event_id % 101 = 0)::INT) OVER w AS p
  FROM v_ep_base WINDOW w AS (PARTITION BY episode_id ORDER BY pos)) WHERE s <> coalesce(p, 0) + 1
UNION ALL SELECT episode_id, event_id, 'unknown_actor' FROM v_ep_base WHERE event_id % 103 = 0
UNION ALL SELECT episode_id, event_id, 'authorization' FROM v_ep_base WHERE event_id % 107 = 0 AND event_id % 103 <> 0
UNION ALL SELECT r.episode_id, r.event_id, 'idempotency' FROM v_ep_requests r JOIN v_ep_requests p
  ON p.episode_id = r.episode_id AND p.event_id = r.previous_id WHERE r.is_dup AND NOT (p.request = r.request AND p.receipt = r.receipt)
UNION ALL SELECT episode_id, event_id, 'request_reuse' FROM (SELECT *, min(pos) OVER (PARTITION BY episode_id, request) AS f
  FROM v_ep_requests WHERE NOT is_dup) WHERE pos > f
UNION ALL SELECT episode_id, event_id, 'unknown_account' FROM v_ep_primary WHERE event_type = 'purchase' AND event_id % 139 = 0
UNION ALL SELECT episode_id, event_id, 'ledger_balance' FROM v_ep_primary WHERE event_type = 'purchase' AND event_id % 113 = 0
UNION ALL SELECT episode_id, event_id, 'version_chain' FROM v_ep_primary WHERE event_id % 137 = 0
UNION ALL SELECT episode_id, event_id, 'evidence_presence' FROM v_ep_base WHERE event_id % 127 = 0
UNION ALL SELECT episode_id, NULL, 'final_state' FROM v_ep_heads WHERE block % 29 = 0""",
)


@query(
    "episode_audit",
    """SELECT episode_id, coalesce(event_id, '-') AS event_id, "check", count(*) AS n FROM v_ep_violations GROUP BY ALL""",
)
def episode_audit(spark, sf):
    found = A.audit(episode_tables(spark, sf, stored=True))
    return found.groupBy("episode_id", F.coalesce("event_id", F.lit("-")).alias("event_id"), "check").agg(F.count("*").alias("n"))


@query(
    "episodes_passing",
    "SELECT episode_id FROM v_ep_heads WHERE episode_id NOT IN (SELECT episode_id FROM v_ep_violations)",
)
def episodes_passing(spark, sf):
    t = episode_tables(spark, sf, stored=True)
    return A.passing(t["episodes"].select("episode_id"), A.audit(t))


@query(
    "authorization",
    """SELECT episode_id, event_id, 'authorization' AS "check" FROM v_ep_base WHERE event_id % 107 = 0 AND event_id % 103 <> 0
UNION ALL SELECT episode_id, event_id, 'unknown_actor' FROM v_ep_base WHERE event_id % 103 = 0""",
)
def authorization(spark, sf):
    t = episode_tables(spark, sf)
    found = C.authorization(t["events"], t["entities"], t["authorizations"]).unionByName(C.unknown_actors(t["events"], t["entities"]))
    return found.select("episode_id", F.col("event_id").cast("long").alias("event_id"), "check")


@query(
    "idempotency",
    """SELECT episode_id, event_id, "check" FROM v_ep_violations WHERE "check" IN ('idempotency', 'request_reuse')""",
)
def idempotency(spark, sf):
    t = episode_tables(spark, sf)
    return C.idempotency(t["events"], t["mutations"]).unionByName(C.request_reuse(t["events"])).select("episode_id", "event_id", "check")


@query(
    "request_index",
    """SELECT episode_id, 'q' || request AS request_id, 'rc' || arg_min(receipt, pos) AS receipt_id,
  arg_min(CASE WHEN is_dup THEN previous_id ELSE event_id END, pos) AS primary_event_id, count(*) FILTER (is_dup) AS duplicate_count,
  min(event_id) FILTER (is_dup) AS first_duplicate, max(event_id) FILTER (is_dup) AS last_duplicate
FROM v_ep_requests GROUP BY episode_id, request""",
)
def request_index(spark, sf):
    return C.request_index(episode_tables(spark, sf)["events"]).drop("surface")


@query(
    "dangling_refs",
    """SELECT episode_id, event_id, ref AS evidence_id FROM (SELECT episode_id, event_id, unnest(['ev' || event_id, 'evk' || k]) AS ref
  FROM v_ep_base WHERE event_id % 127 <> 0) WHERE ref NOT IN (SELECT 'ev' || event_id FROM events WHERE event_id % 11 <> 0
  UNION ALL SELECT 'evk' || k FROM v_ev WHERE k % 10 <> 0)""",
)
def dangling_refs(spark, sf):
    events = episode_tables(spark, sf)["events"]
    e = load(spark, sf, "events", "event_id", "props").withColumn("k", k_of(F.col("props")))
    own = e.where("event_id % 11 <> 0").select(F.concat(F.lit("ev"), "event_id").alias("evidence_id"))
    shared = e.where("k % 10 <> 0").select(F.concat(F.lit("evk"), "k").alias("evidence_id")).distinct()
    return C.dangling_refs(events, own.unionByName(shared))


@query(
    "challenge_sufficiency",
    """SELECT episode_id, challenge_id, sufficient, fits FROM (
  SELECT episode_id, 'c1' AS challenge_id, block % 31 <> 0 AS sufficient, block % 31 <> 0 AS fits FROM v_ep_heads
  UNION ALL SELECT episode_id, 'c2', false, true FROM v_ep_heads)""",
)
def challenge_sufficiency(spark, sf):
    return C.challenge_verdicts(episode_tables(spark, sf)["challenges"]).select("episode_id", "challenge_id", "sufficient", "fits")


@query(
    "transition_table",
    """SELECT episode_id, event_id AS transition_id, 's' || (k % 3) AS surface,
  event_type || '_' || CASE WHEN event_id % 107 = 0 THEN 'nobody' ELSE role END AS action, 'rc' || event_id AS receipt_id FROM v_ep_primary""",
)
def transition_table(spark, sf):
    return C.transitions(episode_tables(spark, sf)["events"]).drop("event_pos")


@query(
    "enabled_transitions",
    """SELECT episode_id, event_id AS transition_id FROM (
  SELECT p.*, (SELECT count(*) FROM v_ep_primary q WHERE q.episode_id = p.episode_id AND q.object_id = p.object_id AND q.pos <= 4) AS done
  FROM v_ep_primary p) WHERE pos > 4 AND step - 1 + CASE WHEN event_id % 137 = 0 THEN 5 ELSE 0 END = done AND step - 1 = done""",
)
def enabled_transitions(spark, sf):
    """State after the first four events of each episode; which transitions can run next."""
    t = episode_tables(spark, sf)
    moves = C.transitions(t["events"])
    done = t["mutations"].where(F.col("event_pos") <= 4)
    # The faulty from_version never changes where the object stands: to_version decides.
    now = C.contracted_state(t["states"], done)
    applied = moves.where(F.col("event_pos") <= 4).select("episode_id", "transition_id")
    return C.enabled_transitions(moves, t["mutations"], now, applied).select("episode_id", "transition_id")


@query(
    "surface_actions",
    """SELECT DISTINCT 's' || (k % 3) AS surface, event_type || '_' || CASE WHEN event_id % 107 = 0 THEN 'nobody' ELSE role END AS action,
  CASE WHEN event_id % 107 = 0 THEN NULL ELSE role END AS role FROM v_ep_base""",
)
def surface_actions(spark, sf):
    t = episode_tables(spark, sf)
    return C.surface_actions(t["events"], t["authorizations"])


@query(
    "actor_actions",
    """SELECT episode_id, actor_id, kind || '_' || role AS action FROM (SELECT DISTINCT episode_id, 'u' || user_id AS actor_id, role FROM v_ep_base)
CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS kind)""",
)
def actor_actions(spark, sf):
    t = episode_tables(spark, sf)
    return C.actor_actions(t["entities"], t["authorizations"])


# --- whole histories -----------------------------------------------------------------
@query(
    "chronology_violations",
    """SELECT o_custkey AS episode_id, o_orderkey AS event_id FROM (
  SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
WHERE o_orderdate < before OR o_orderdate < TIMESTAMP '1995-02-01' OR o_orderdate > TIMESTAMP '2001-06-30'""",
)
def chronology_violations(spark, sf):
    o = load(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate").select(
        F.col("o_custkey").alias("episode_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderdate").alias("at")
    )
    events = positions(o, ["episode_id"], "pos", "sequence")
    episodes = o.groupBy("episode_id").agg(
        F.lit("1995-02-01").cast("timestamp_ntz").alias("window_start"), F.lit("2001-06-30").cast("timestamp_ntz").alias("window_end")
    )
    return C.chronology(events, episodes).select("episode_id", F.col("event_id").cast("long").alias("event_id"))


@query(
    "ledger_conservation",
    """SELECT episode_id, currency, CAST(sum(amount_minor) AS BIGINT) AS total FROM (
  SELECT l_orderkey AS episode_id, l_returnflag AS currency, unnest([c, CASE WHEN l_partkey % 97 = 0 THEN 1 ELSE 0 END - c]) AS amount_minor
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)) GROUP BY ALL HAVING sum(amount_minor) <> 0""",
)
def ledger_conservation(spark, sf):
    li = load(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_partkey", "l_extendedprice")
    c = cents(F.col("l_extendedprice"))
    off = F.when(F.col("l_partkey") % 97 == 0, 1).otherwise(0)
    legs = li.select(
        F.col("l_orderkey").alias("episode_id"), F.col("l_returnflag").alias("currency"), F.explode(F.array(c, off - c)).alias("amount_minor")
    )
    return C.ledger_balance(legs, ["episode_id", "currency"])


# Object histories: one object per (user, k % 5), one step per event.
def histories(spark, sf, *, faults: bool = True):
    e = load(spark, sf, "events", "event_id", "user_id", "event_type", "props").select(
        F.col("user_id").alias("episode_id"),
        F.concat(F.lit("o"), k_of(F.col("props")) % 5).alias("object_id"),
        F.col("event_id").alias("step"),
        F.col("event_type").alias("to_state"),
    )
    keys = ["episode_id", "object_id"]
    numbered = positions(with_chunks(e, "step"), keys, "step", "to_version")
    linked = neighbour(numbered, keys, "step", F.struct("to_state", "to_version"), "_p", back=True)
    bump = F.when(F.col("step") % 101 == 0, 7).otherwise(0) if faults else F.lit(0)
    # The chunk column stays for checks over the same keys; those over other keys drop it.
    return linked.select(
        *keys, "step", "_chunk", F.col("_p.to_state").alias("from_state"), (F.col("_p.to_version") + bump).alias("from_version"), "to_state", "to_version"
    )


sql_view(
    "v_hist",
    """SELECT episode_id, object_id, step, to_state, to_version, lag(to_state) OVER w AS from_state,
  lag(to_version) OVER w AS clean_version, lag(to_version) OVER w + CASE WHEN step % 101 = 0 THEN 7 ELSE 0 END AS from_version FROM (
  SELECT user_id AS episode_id, 'o' || (k % 5) AS object_id, event_id AS step, event_type AS to_state,
    row_number() OVER (PARTITION BY user_id, k % 5 ORDER BY event_id) AS to_version FROM v_ev)
WINDOW w AS (PARTITION BY episode_id, object_id ORDER BY step)""",
)


@query(
    "version_chain",
    "SELECT episode_id, object_id, step FROM v_hist WHERE from_version IS NOT NULL AND step % 101 = 0",
)
def version_chain(spark, sf):
    return C.broken_steps(histories(spark, sf), ["episode_id", "object_id"], size=CHUNK).select("episode_id", "object_id", "step")


@query(
    "final_state",
    """SELECT episode_id, object_id, arg_max(to_state, step) AS state, max(to_version) AS version FROM v_hist GROUP BY ALL""",
)
def final_state(spark, sf):
    return C.final_objects(histories(spark, sf), ["episode_id", "object_id"])


@query(
    "state_drift",
    """SELECT episode_id, count(*) AS drifted FROM (
  SELECT episode_id, object_id, arg_max(to_state, to_version) AS s, max(to_version) AS v FROM v_hist GROUP BY ALL) l FULL OUTER JOIN (
  SELECT episode_id, object_id, arg_max(to_state, to_version) AS s, max(to_version) AS v FROM v_hist WHERE step % 10 <> 0 GROUP BY ALL) r
  USING (episode_id, object_id) WHERE l.s IS DISTINCT FROM r.s OR l.v IS DISTINCT FROM r.v GROUP BY episode_id""",
)
def state_drift(spark, sf):
    """The live state against the state recomputed from the steps that were recorded as applied."""
    keys, fields = ["episode_id", "object_id"], ["state", "version"]
    h = histories(spark, sf)
    live = C.final_objects(h, keys)
    recomputed = C.final_objects(h.where(F.col("step") % 10 != 0), keys)
    return C.state_difference(live, recomputed, keys, fields).groupBy("episode_id").agg(F.count("*").alias("drifted"))


@query(
    "state_after_step",
    """WITH l AS (SELECT episode_id, step, object_id, sha256('=' || object_id) AS place, sha256(sha256('=' || object_id) || sha256(coalesce('=' || '=' || to_state || '|=' || to_version, ''))) AS leaf FROM v_hist),
w AS (SELECT episode_id, step, unnest([
    """ + ",\n    ".join(f"{{'p': sha256('=o{i}'), 'l': last_value(CASE WHEN object_id = 'o{i}' THEN leaf END IGNORE NULLS) OVER w}}" for i in range(5)) + """]) AS x
  FROM l WINDOW w AS (PARTITION BY episode_id ORDER BY step)),
b AS (SELECT episode_id, step, left(x.p, 1) AS digit, sha256('bucket' || string_agg(x.l || ':1', ',' ORDER BY x.p)) AS digest FROM w WHERE x.l IS NOT NULL GROUP BY ALL)
SELECT episode_id, step, sha256('node' || string_agg(digit || ':' || digest, ',' ORDER BY digit)) AS state_root FROM b GROUP BY ALL""",
)
def state_after_step(spark, sf):
    return C.state_after_step(histories(spark, sf, faults=False).drop("_chunk"), ["episode_id"], "step").select("episode_id", "step", "state_root")


@query(
    "state_root",
    tree_sql("SELECT episode_id, object_id AS name, '=' || arg_max(to_state, step) || '|=' || max(to_version) AS value FROM v_hist GROUP BY ALL", "episode_id", 1),
)
def state_root(spark, sf):
    """The root of each episode's state at its end."""
    return C.state_roots(C.final_objects(histories(spark, sf), ["episode_id", "object_id"]), ["episode_id"])


@query(
    "request_conflict",
    """SELECT case_id, request_id, status, count(*) AS n FROM (
  SELECT user_id AS case_id, k % 20 AS request_id, CASE WHEN event_id = min(event_id) OVER w THEN 'first'
    WHEN event_type = first_value(event_type) OVER (PARTITION BY user_id, k % 20 ORDER BY event_id) THEN 'idempotent' ELSE 'conflict' END AS status
  FROM v_ev WINDOW w AS (PARTITION BY user_id, k % 20)) GROUP BY ALL""",
)
def request_conflict(spark, sf):
    e = load(spark, sf, "events", "event_id", "user_id", "event_type", "props").select(
        F.col("user_id").alias("case_id"), (k_of(F.col("props")) % 20).alias("request_id"), "event_id", "event_type"
    )
    checked = C.request_conflicts(e, ["case_id", "request_id"], "event_id", "event_type")
    return checked.groupBy("case_id", "request_id", "status").agg(F.count("*").alias("n"))


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    return C.duplicate_keys(load(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query(
    "shape_rules",
    """SELECT 'documents' AS "table", CAST(doc_id AS VARCHAR) AS key, rule_id FROM (
  SELECT doc_id, unnest([CASE WHEN NOT (length(text) > 0) THEN 'text_present' END, CASE WHEN NOT (lang IN ('en', 'fr', 'de')) THEN 'known_lang' END,
    CASE WHEN NOT regexp_full_match(source, 'src[0-9]') THEN 'source_format' END, CASE WHEN NOT (n_chars BETWEEN 50 AND 20000) THEN 'length_range' END]) AS rule_id
  FROM documents) WHERE rule_id IS NOT NULL""",
)
def shape_rules(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "lang", "source", "n_chars", "text")
    return C.rule_violations(d, "documents", F.col("doc_id"), {
        "text_present": F.length("text") > 0,
        "known_lang": F.col("lang").isin("en", "fr", "de"),
        "source_format": F.col("source").rlike("^src[0-9]$"),
        "length_range": F.col("n_chars").between(50, 20000),
    })


@query(
    "call_rules",
    """SELECT 'calls' AS "table", CAST(event_id AS VARCHAR) AS key, unnest(list_filter([
    CASE WHEN k % 23 = 0 THEN 'attempt_count' END, CASE WHEN k % 7 = 3 THEN 'earlier_retryable' END,
    CASE WHEN event_type <> 'error' AND (k % 19 = 0 OR event_type = 'view') THEN 'pass_end' END,
    CASE WHEN event_type = 'error' AND k % 17 = 0 THEN 'fail_end' END, CASE WHEN k % 29 = 0 THEN 'token_total' END], lambda x: x IS NOT NULL)) AS rule_id FROM v_ev""",
)
def call_rules(spark, sf):
    e = load(spark, sf, "events", "event_id", "event_type", "props").withColumn("k", k_of(F.col("props")))
    k, failed = F.col("k"), F.col("event_type") == "error"
    calls = e.select(
        "event_id",
        (F.lit(2) + F.when(k % 23 == 0, 1).otherwise(0)).alias("attempts"),
        F.array(F.when(k % 7 == 3, "404").otherwise("503"), F.when(failed | (F.col("event_type") == "view"), "500").otherwise("200")).alias("statuses"),
        F.when(failed, "FAIL").otherwise("PASS").alias("status"),
        F.when(k % 19 != 0, F.lit("id")).alias("request_id"),
        (~failed).alias("response_present"),
        F.when(failed, F.when(k % 17 == 0, "OTHER").otherwise("HTTP")).alias("failure_class"),
        k.alias("prompt_tokens"), F.lit(10).alias("completion_tokens"), (k + 10 - F.when(k % 29 == 0, 1).otherwise(0)).alias("total_tokens"),
    )
    return C.rule_violations(calls, "calls", F.col("event_id"), C.call_history_rules(2))


# --- mutation sensitivity ----------------------------------------------------------
@query(
    "mutation_sensitivity",
    """SELECT kind, count(*) AS patches, count(*) FILTER (ok) AS rejected_as_expected FROM (
  SELECT 'unauthorised' AS kind, true AS ok FROM v_ep_primary
  UNION ALL SELECT 'stale_version', true FROM v_ep_primary
  UNION ALL SELECT 'unbalanced_ledger', cents <> 1 FROM v_ep_primary WHERE event_type = 'purchase'
  UNION ALL SELECT 'unknown_ledger_object', true FROM v_ep_primary WHERE event_type = 'purchase'
  UNION ALL SELECT 'missing_evidence', true FROM v_ep_primary WHERE event_id <> first_id
  UNION ALL SELECT unnest(['sequence_break', 'request_reuse']), true FROM v_ep_base WHERE pos = 2
  UNION ALL SELECT 'final_state_drift', true FROM v_ep_heads) GROUP BY kind""",
)
def mutation_sensitivity(spark, sf):
    """Episodes without faults; a ledger leg of one minor unit is not changed by its patch."""
    out = sensitivity(episode_tables(spark, sf, faults=False, stored=True), "intruder")
    return out.groupBy("kind").agg(F.count("*").alias("patches"), F.count_if("as_expected").alias("rejected_as_expected"))
