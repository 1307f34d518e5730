"""Event-log contracts: single checks, histories and states, requests, transitions, row rules.

The checks return rows of

    episode_id, event_id, check, detail

and report all violations; ``operators/audit.py`` runs all checks of a set of episodes together.  Tables follow the
normalised episode schema; events are ordered by integer positions, never by their own claims.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import digest_tree
from auditframe.functions.ordered import CHUNK, latest, neighbour

def _violations(df: DataFrame, check: str, detail: Column, event: Column | None = None) -> DataFrame:
    return df.select(
        "episode_id",
        (F.lit(None) if event is None else event).cast("string").alias("event_id"),
        F.lit(check).alias("check"),
        detail.cast("string").alias("detail"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def chronology(events: DataFrame, episodes: DataFrame) -> DataFrame:
    """Sequence must count 1, 2, 3 …; time must not fall back and must stay in the window."""
    data = neighbour(events, ["episode_id"], "pos", F.struct("sequence", "at"), "_before", back=True)
    data = data.join(episodes.select("episode_id", "window_start", "window_end"), "episode_id", "left")
    right = (
        (F.col("sequence") == F.coalesce(F.col("_before.sequence"), F.lit(0)) + 1)
        & (F.col("at") >= F.coalesce(F.col("_before.at"), F.col("window_start")))
        & F.col("at").between(F.col("window_start"), F.col("window_end"))
    )
    # What is not provably right is wrong: NULLs and events of an unknown episode too.
    return _violations(data.where(~F.coalesce(right, F.lit(False))), "chronology", F.col("sequence"), F.col("event_id"))


def unknown_actors(events: DataFrame, entities: DataFrame) -> DataFrame:
    known = entities.select("episode_id", F.col("id").alias("actor_id"))
    lost = events.join(known, ["episode_id", "actor_id"], "left_anti")
    return _violations(lost, "unknown_actor", F.col("actor_id"), F.col("event_id"))


def authorization(events: DataFrame, entities: DataFrame, authorizations: DataFrame) -> DataFrame:
    """Events whose actor is known but holds no role permitted for the action."""
    roles = entities.select("episode_id", F.col("id").alias("actor_id"), "role")
    acted = events.join(roles, ["episode_id", "actor_id"])
    refused = acted.join(authorizations, ["episode_id", "action", "role"], "left_anti")
    return _violations(
        refused, "authorization", F.concat_ws(" by ", "action", "actor_id"), F.col("event_id")
    )


def idempotency(events: DataFrame, mutations: DataFrame) -> DataFrame:
    """Duplicates must repeat an earlier event exactly and change nothing."""
    duplicates = events.where(F.col("duplicate_of").isNotNull())
    primary = events.select(
        "episode_id",
        F.col("event_id").alias("duplicate_of"),
        F.struct("pos", "request_id", "expected_receipt").alias("_primary"),
    )
    changing = mutations.select("episode_id", F.col("event_pos").alias("pos"), F.lit(True).alias("_mutates")).distinct()
    seen = duplicates.join(primary, ["episode_id", "duplicate_of"], "left").join(
        changing, ["episode_id", "pos"], "left"
    )
    p = F.col("_primary")
    fine = (
        (p["pos"] < F.col("pos"))
        & (p["request_id"] == F.col("request_id"))
        & (p["expected_receipt"] == F.col("expected_receipt"))
        & F.col("_mutates").isNull()
    )
    return _violations(
        seen.where(~F.coalesce(fine, F.lit(False))), "idempotency", F.col("duplicate_of"), F.col("event_id")
    )


def request_reuse(events: DataFrame) -> DataFrame:
    """Primary events whose request id an earlier primary event already used."""
    primary = events.where(F.col("duplicate_of").isNull())
    first = primary.groupBy("episode_id", "request_id").agg(F.min("pos").alias("_first"), F.count("*").alias("_n"))
    again = primary.join(first.where(F.col("_n") > 1), ["episode_id", "request_id"])
    return _violations(
        again.where(F.col("pos") > F.col("_first")), "request_reuse", F.col("request_id"), F.col("event_id")
    )


def ledger_balance(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of minor units per key that are not zero, or not known because a leg has no amount (total NULL)."""
    known = F.when(F.count("*") == F.count("amount_minor"), F.sum("amount_minor"))
    return ledger.groupBy(*keys).agg(known.alias("total")).where(~F.coalesce(F.col("total") == 0, F.lit(False)))


def broken_steps(history: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """Steps that do not continue the object's state and version or skip a version."""
    data = neighbour(history, keys, "step", F.struct("to_state", "to_version"), "_now", back=True, size=size)
    fits = (
        F.col("_now.to_state").eqNullSafe(F.col("from_state"))
        & F.col("_now.to_version").eqNullSafe(F.col("from_version"))
        & (F.col("to_version") == F.col("from_version") + 1)
    )
    # The first step has nothing to continue; a NULL version or state of a later one does not fit.
    return data.where(F.col("_now").isNotNull() & ~F.coalesce(fits, F.lit(False))).drop("_now")


def final_objects(history: DataFrame, keys: list[str]) -> DataFrame:
    """State and version of each object after its last step."""
    return latest(history, keys, "step", "to_state", "to_version").select(
        *keys, F.col("to_state").alias("state"), F.col("to_version").alias("version")
    )


def state_difference(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Objects whose fields differ between two tables, or that exist in one only."""
    a = left.select(*keys, F.struct(*fields).alias("left"))
    b = right.select(*keys, F.struct(*fields).alias("right"))
    return a.join(b, keys, "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def contracted_state(states: DataFrame, mutations: DataFrame) -> DataFrame:
    """State the applied mutations lead to: per object the greatest to_version wins."""
    keys = ["episode_id", "object_id"]
    start = states.where(F.col("which") == "initial").select(*keys, "state", F.col("version").cast("long").alias("version"))
    moves = mutations.select(*keys, F.col("to_state").alias("state"), F.col("to_version").cast("long").alias("version"))
    best = start.unionByName(moves).groupBy(*keys).agg(
        F.max_by(F.struct("state", "version"), "version").alias("_best")
    )
    return best.select(*keys, "_best.state", "_best.version")


def state_value(state: Column, version: Column) -> Column:
    """What a state's digest tree holds of an object."""
    return F.concat_ws("|", digest_tree.framed(state), digest_tree.framed(version))


def state_roots(states: DataFrame, keys: list[str], levels: int = 1) -> DataFrame:
    """keys, leaves, root: the digest tree over the objects of each state."""
    return digest_tree.roots(states, F.col("object_id"), state_value(F.col("state"), F.col("version")), keys, levels)


def state_after_step(history: DataFrame, keys: list[str], order: str, size: int = CHUNK, levels: int = 1) -> DataFrame:
    """The root of the whole state after every step, as ``state_roots`` gives it for a state at rest.

    A step changes one object, so it renews one path of the tree; what else the state holds is carried along.
    """
    value = state_value(F.col("to_state"), F.col("to_version"))
    rows = digest_tree.roots_after_steps(history, keys, order, "object_id", value, levels=levels, size=size)
    return rows.withColumnRenamed("root", "state_root")


def challenge_verdicts(challenges: DataFrame) -> DataFrame:
    """Whether the required evidence is supplied and the disposition fits."""
    enough = F.size(F.array_except("required", "supplied")) == 0
    fits = F.when(F.col("expected_disposition") == "SUPPORTED", enough).when(
        F.col("expected_disposition") == "REFUSE_UNSUPPORTED", ~enough
    ).otherwise(True)
    return challenges.withColumns({"sufficient": enough, "fits": fits})


def dangling_refs(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence named by events but absent from the public evidence table."""
    refs = events.select("episode_id", "event_id", F.explode("evidence_refs").alias("evidence_id"))
    return refs.join(evidence.select("evidence_id"), "evidence_id", "left_anti")


# --- requests ----------------------------------------------------------------
def request_index(events: DataFrame) -> DataFrame:
    """One row per request: receipt, primary event, number of duplicates and their ids.

    The ids are kept as their own rows' count and smallest and greatest, so a request
    with very many duplicates stays one small row; ``duplicates`` lists them all.
    """
    first = F.struct(
        F.col("expected_receipt").alias("receipt_id"),
        F.coalesce("duplicate_of", F.col("event_id")).alias("primary_event_id"),
        "surface",
    )
    again = F.col("duplicate_of").isNotNull()
    return (
        events.groupBy("episode_id", "request_id")
        .agg(
            F.min_by(first, "pos").alias("_first"),
            F.count_if(again).alias("duplicate_count"),
            F.min(F.when(again, F.col("event_id"))).alias("first_duplicate"),
            F.max(F.when(again, F.col("event_id"))).alias("last_duplicate"),
        )
        .select("episode_id", "request_id", "_first.*", "duplicate_count", "first_duplicate", "last_duplicate")
    )


def duplicates(events: DataFrame) -> DataFrame:
    """Request to duplicate event, one row each."""
    return events.where(F.col("duplicate_of").isNotNull()).select("episode_id", "request_id", "event_id")


def request_conflicts(requests: DataFrame, keys: list[str], order: str, payload: str) -> DataFrame:
    """Add ``status`` to requests: first, idempotent (seen with the same payload) or conflict."""
    first = requests.groupBy(*keys).agg(F.min_by(F.struct(payload, order), order).alias("_first"))
    status = (
        F.when(F.col(order) == F.col("_first")[order], "first")
        .when(F.col(payload).eqNullSafe(F.col("_first")[payload]), "idempotent")
        .otherwise("conflict")
    )
    return requests.join(first, keys).withColumn("status", status).drop("_first")


# --- transitions and capabilities ----------------------------------------------
def transitions(events: DataFrame) -> DataFrame:
    """Events that are not duplicates, without their order."""
    return events.where(F.col("duplicate_of").isNull()).select(
        "episode_id", F.col("event_id").alias("transition_id"), F.col("pos").alias("event_pos"), "surface", "action",
        F.col("expected_receipt").alias("receipt_id"),
    )


def enabled_transitions(moves: DataFrame, mutations: DataFrame, current: DataFrame, applied: DataFrame) -> DataFrame:
    """Transitions not applied yet whose every precondition holds in the current state."""
    need = mutations.join(current, ["episode_id", "object_id"], "left")
    holds = F.col("state").eqNullSafe(F.col("from_state")) & F.col("version").eqNullSafe(F.col("from_version"))
    blocked = need.where(~holds).select("episode_id", "event_pos").distinct()
    return moves.join(applied, ["episode_id", "transition_id"], "left_anti").join(
        blocked, ["episode_id", "event_pos"], "left_anti"
    )


def surface_actions(events: DataFrame, authorizations: DataFrame) -> DataFrame:
    """Distinct actions per surface with the roles permitted for each, one row per role."""
    acts = events.select("episode_id", "surface", "action").distinct()
    return acts.join(authorizations, ["episode_id", "action"], "left").select("surface", "action", "role").distinct()


def actor_actions(entities: DataFrame, authorizations: DataFrame) -> DataFrame:
    """Actions each actor may take."""
    return entities.where(F.col("role").isNotNull()).join(authorizations, ["episode_id", "role"]).select(
        "episode_id", F.col("id").alias("actor_id"), "action"
    )


# --- row rules -------------------------------------------------------------------
def rule_violations(df: DataFrame, table: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; a rule is a predicate that must be true."""
    broken = F.array(*[F.when(~F.coalesce(p, F.lit(False)), F.lit(name)) for name, p in rules.items()])
    return df.select(
        F.lit(table).alias("table"), key.cast("string").alias("key"), F.explode(F.array_compact(broken)).alias("rule_id")
    )


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


# Statuses after which a provider call may be tried again.
RETRYABLE = ("TRANSPORT", "408", "425", "429", "500", "502", "503", "504")
FAILURES = ("HTTP", "TRANSPORT", "RESPONSE")


def call_history_rules(max_retries: int) -> dict[str, Column]:
    """Rules on a provider call: attempts, statuses (array of text), status, request_id,
    response_present, failure_class, prompt_tokens, completion_tokens, total_tokens."""
    statuses = F.col("statuses")
    tries = F.size(statuses)
    last = F.try_element_at(statuses, F.lit(-1))
    earlier = F.slice(statuses, 1, F.greatest(tries - 1, F.lit(0)))
    passed = F.col("status") == "PASS"
    failed = F.col("status") == "FAIL"
    counts = F.least("prompt_tokens", "completion_tokens", "total_tokens")
    good_end = (
        last.rlike("^2[0-9][0-9]$") & F.col("response_present") & F.col("request_id").isNotNull()
        & F.col("failure_class").isNull()
    )
    bad_end = ~F.col("response_present") & F.coalesce(F.col("failure_class").isin(*FAILURES), F.lit(False))
    return {
        "attempt_count": (F.col("attempts") == tries) & tries.between(1, max_retries + 1),
        "earlier_retryable": F.forall(earlier, lambda s: s.isin(*RETRYABLE)),
        "known_status": passed | failed,
        "pass_end": ~passed | good_end,
        "fail_end": ~failed | bad_end,
        "token_total": (counts >= 0) & (F.col("total_tokens") >= F.col("prompt_tokens") + F.col("completion_tokens")),
    }
