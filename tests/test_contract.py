"""Each contract check on one small episode, the first violation, and the patch library."""
from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from auditframe.operators import audit as A
from auditframe.operators import contract as C
from auditframe.operators.sensitivity import EXPECTED_CHECK, sensitivity
from tests.conftest import rows
from tests.patching import found_by_copies

START = dt.datetime(2036, 1, 1)
DDL = {
    "episodes": "episode_id STRING, window_start TIMESTAMP, window_end TIMESTAMP",
    "events": "episode_id STRING, pos INT, sequence INT, event_id STRING, at TIMESTAMP, surface STRING, actor_id STRING, action STRING, request_id STRING, expected_receipt STRING, duplicate_of STRING, evidence_refs ARRAY<STRING>",
    "mutations": "episode_id STRING, event_pos INT, pos INT, object_id STRING, from_state STRING, to_state STRING, from_version INT, to_version INT",
    "ledger": "episode_id STRING, event_pos INT, leg INT, account_id STRING, currency STRING, amount_minor BIGINT",
    "entities": "episode_id STRING, id STRING, role STRING",
    "authorizations": "episode_id STRING, action STRING, role STRING",
    "states": "episode_id STRING, which STRING, object_id STRING, state STRING, version INT",
    "challenges": "episode_id STRING, challenge_id STRING, required ARRAY<STRING>, supplied ARRAY<STRING>, expected_disposition STRING",
}


def episode():
    def event(pos, **change):
        base = dict(
            episode_id="e", pos=pos, sequence=pos, event_id=f"v{pos}", at=START + dt.timedelta(days=pos), surface="s", actor_id="u", action="open", request_id=f"q{pos}",
            expected_receipt=f"rc{pos}", duplicate_of=None, evidence_refs=[f"ev{pos}"],
        )
        return {**base, **change}

    return {
        "episodes": [dict(episode_id="e", window_start=START, window_end=START + dt.timedelta(days=7))],
        "events": [event(1), event(2), event(3, request_id="q2", expected_receipt="rc2", duplicate_of="v2"), event(4)],
        "mutations": [
            dict(episode_id="e", event_pos=1, pos=0, object_id="o", from_state="new", to_state="open", from_version=1, to_version=2),
            dict(episode_id="e", event_pos=4, pos=0, object_id="o", from_state="open", to_state="shut", from_version=2, to_version=3),
        ],
        "ledger": [
            dict(episode_id="e", event_pos=2, leg=0, account_id="a1", currency="USD", amount_minor=500),
            dict(episode_id="e", event_pos=2, leg=1, account_id="a2", currency="USD", amount_minor=-500),
        ],
        "entities": [dict(episode_id="e", id="u", role="maker"), dict(episode_id="e", id="x", role="none")] + [dict(episode_id="e", id=i, role=None) for i in ("a1", "a2", "o")],
        "authorizations": [dict(episode_id="e", action="open", role="maker")],
        "states": [
            dict(episode_id="e", which="initial", object_id="o", state="new", version=1), dict(episode_id="e", which="final", object_id="o", state="shut", version=3),
        ],
        "challenges": [
            dict(episode_id="e", challenge_id="c1", required=["ev1"], supplied=["ev1"], expected_disposition="SUPPORTED"),
            dict(episode_id="e", challenge_id="c2", required=["no"], supplied=["ev1"], expected_disposition="REFUSE_UNSUPPORTED"),
        ],
    }


def tables(spark, data):
    return {n: spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in ddl.split(", ")) for r in data[n]], ddl) for n, ddl in DDL.items()}


def test_honest_episode_passes(spark):
    t = tables(spark, episode())
    assert rows(A.audit(t)) == []
    assert rows(A.passing(t["episodes"].select("episode_id"), A.audit(t))) == [("e",)]


CHANGES = [
    ("episodes", 0, dict(window_end=START + dt.timedelta(days=6, hours=23)), "long_horizon"),
    ("events", 1, dict(sequence=1), "chronology"), ("events", 3, dict(at=START + dt.timedelta(days=2)), "chronology"), ("events", 3, dict(at=START + dt.timedelta(days=8)), "chronology"),
    ("events", 0, dict(actor_id="ghost"), "unknown_actor"), ("events", 0, dict(actor_id="x"), "authorization"), ("events", 0, dict(action="other"), "authorization"),
    ("events", 2, dict(expected_receipt="rc9"), "idempotency"), ("events", 2, dict(duplicate_of="v4"), "idempotency"), ("mutations", 1, dict(event_pos=3), "idempotency"),
    ("events", 3, dict(request_id="q1"), "request_reuse"), ("events", 3, dict(expected_receipt="rc1"), "duplicate_receipt"),
    ("ledger", 0, dict(account_id="a9"), "unknown_account"), ("ledger", 0, dict(amount_minor=1), "ledger_balance"), ("ledger", 0, dict(currency="EUR"), "ledger_balance"),
    ("mutations", 1, dict(object_id="z"), "unknown_object"), ("mutations", 1, dict(from_version=1), "version_chain"), ("mutations", 1, dict(from_state="new"), "version_chain"),
    ("mutations", 1, dict(to_version=5), "version_chain"), ("events", 3, dict(evidence_refs=[]), "evidence_presence"), ("states", 1, dict(version=4), "final_state"),
    # What is not known is not right.
    ("events", 3, dict(sequence=None), "chronology"), ("events", 3, dict(at=None), "chronology"), ("ledger", 0, dict(amount_minor=None), "ledger_balance"),
    ("mutations", 1, dict(from_version=None), "version_chain"), ("mutations", 1, dict(to_version=None), "version_chain"), ("events", 3, dict(evidence_refs=None), "evidence_presence"),
    ("challenges", 0, dict(supplied=["ev2"]), "challenge"), ("challenges", 1, dict(required=["ev1"]), "challenge"), ("challenges", 1, dict(supplied=["ev9"]), "challenge"),
]


def test_each_change_trips_its_check(spark):
    """One copy of the episode per change, all audited together, and one that is unchanged."""
    merged = {name: [] for name in DDL}
    for n, (table, row, change, _) in enumerate([*CHANGES, ("events", 0, {}, None)]):
        data = episode()
        data[table][row].update(change)
        for name, part in data.items():
            merged[name] += [{**r, "episode_id": f"e{n}"} for r in part]
    found = set(rows(A.audit(tables(spark, merged)), "episode_id", "check"))
    missed = [(n, c) for n, (*_, c) in enumerate(CHANGES) if (f"e{n}", c) not in found]
    assert not missed and not [e for e, _ in found if e == f"e{len(CHANGES)}"]


def test_events_of_an_unknown_episode_are_reported(spark):
    data = episode()
    data["events"].append({**data["events"][0], "episode_id": "stray"})
    assert ("stray", "chronology") in rows(A.audit(tables(spark, data)), "episode_id", "check")


def test_patches_are_rejected_for_the_right_reason(spark):
    out = rows(sensitivity(tables(spark, episode()), "x"), "kind", "event_pos", "found", "as_expected")
    assert all(ok for *_, ok in out)
    # Three primary events; event 1 carries the challenge evidence, so it keeps its own.
    assert sorted(k for k, *_ in out) == sorted(
        ["unauthorised"] * 3 + ["stale_version"] * 2 + ["unbalanced_ledger", "unknown_ledger_object"] + ["missing_evidence"] * 2 + ["sequence_break", "request_reuse", "final_state_drift"]
    )
    assert {(k, f) for k, _, f, _ in out} == set(EXPECTED_CHECK.items())


def random_episodes(n, seed):
    """Episodes with random faults: duplicates of any event, shared and missing requests, objects with several steps, mixed ledgers."""
    rng, merged = random.Random(seed), {name: [] for name in DDL}
    for k in range(n):
        e, data = f"r{k:03}", {name: [] for name in DDL}
        size = rng.randint(1, 6)
        objects = {o: [1, "s0"] for o in rng.sample("abc", rng.randint(1, 3))}
        data["states"] += [dict(episode_id=e, which="initial", object_id=o, state="s0", version=1) for o in objects]
        data["episodes"].append(dict(episode_id=e, window_start=START, window_end=START + dt.timedelta(days=rng.choice([6, 7, 9]))))
        for p in range(1, size + 1):
            again = rng.randint(1, size) if rng.random() < 0.3 else None
            data["events"].append(dict(
                episode_id=e, pos=p, sequence=p if rng.random() < 0.9 else rng.choice([1, None]), event_id=f"{e}v{p}", at=START + dt.timedelta(days=p if rng.random() < 0.9 else 0), surface="s",
                actor_id=rng.choice(["u", "u", "u", "x", "ghost", None]) if rng.random() < 0.3 else "u", action=rng.choice(["open", "open", "shut", "odd"]) if rng.random() < 0.3 else "open",
                request_id=f"q{again or p}" if rng.random() < 0.9 else rng.choice(["q1", "q2", None]), expected_receipt=f"rc{again or p}" if rng.random() < 0.9 else "rc1",
                duplicate_of=again and f"{e}v{again}", evidence_refs=rng.choice([[f"ev{p}"], [f"ev{p}", "shared"], [f"ev{p}"] * 2, [], None]) if rng.random() < 0.4 else [f"ev{p}"],
            ))
            if not again or rng.random() < 0.2:
                for m in range(rng.randint(0, 3)):
                    o = rng.choice(list(objects)) if rng.random() < 0.95 else "z"
                    version, state = objects.setdefault(o, [1, "s0"]) if o != "z" else [1, "s0"]
                    off = rng.choice([0] * 9 + [1])
                    data["mutations"].append(dict(episode_id=e, event_pos=p, pos=m, object_id=o, from_state=state, to_state=f"s{p}{m}", from_version=version + off, to_version=version + 1))
                    if o != "z":
                        objects[o] = [version + 1, f"s{p}{m}"]
            if rng.random() < 0.5:
                amount = rng.choice([500, 1, None])
                for leg, (account, value) in enumerate([("a1", amount), (rng.choice(["a2", "a2", "a9"]), amount and -amount + rng.choice([0, 0, 0, 1]))]):
                    data["ledger"].append(dict(episode_id=e, event_pos=p, leg=leg, account_id=account, currency=rng.choice(["USD"] * 5 + ["EUR"]), amount_minor=value))
        data["states"] += [dict(episode_id=e, which="final", object_id=o, state=s, version=v + rng.choice([0] * 9 + [1])) for o, (v, s) in objects.items() if rng.random() < 0.95]
        data["entities"] += [dict(episode_id=e, id="u", role="maker"), dict(episode_id=e, id="x", role=rng.choice(["none", "keeper"]))] + [dict(episode_id=e, id=i, role=None) for i in rng.sample(["a1", "a2", "phantom", "a1", "a2"], 4)]
        data["entities"] = [dict(t) for t in {tuple(r.items()) for r in data["entities"]}]
        data["authorizations"] += [dict(episode_id=e, action=a, role=r) for a, r in (("open", "maker"), ("shut", "maker"), ("open", "keeper"))]
        refs = [[f"ev{rng.randint(1, size)}"], ["shared"], ["no"]]
        data["challenges"] += [dict(episode_id=e, challenge_id=f"c{i}", required=rng.choice(refs), supplied=rng.choice(refs), expected_disposition=rng.choice(["SUPPORTED", "REFUSE_UNSUPPORTED", "OTHER"])) for i in range(2)]
        for name, part in data.items():
            merged[name] += part
    return merged


def audit_by_hand(data):
    """episode, event, check of every violation, from plain loops; one row per check and event where a check counts once."""
    out = []
    of = lambda name, e: [r for r in data[name] if r["episode_id"] == e]
    for episode in data["episodes"]:
        e = episode["episode_id"]
        events, ids, grants = sorted(of("events", e), key=lambda r: r["pos"]), {r["id"] for r in of("entities", e)}, {(r["action"], r["role"]) for r in of("authorizations", e)}
        say = lambda check, event=None: out.append((e, event, check))  # noqa: B023, E731
        if (episode["window_end"] - episode["window_start"]).days < 7:
            say("long_horizon")
        primary = [v for v in events if not v["duplicate_of"]]
        for receipt in {v["expected_receipt"] for v in primary}:
            if sum(v["expected_receipt"] == receipt for v in primary) > 1:
                say("duplicate_receipt")
        exposed = {r for v in events for r in v["evidence_refs"] or []}
        for c in of("challenges", e):
            enough = not set(c["required"]) - set(c["supplied"])
            wrong = {"SUPPORTED": not enough, "REFUSE_UNSUPPORTED": enough}.get(c["expected_disposition"], False)
            if wrong or set(c["supplied"]) - exposed:
                say("challenge")
        names = {v["pos"]: v["event_id"] for v in events}
        sequence, before = 0, episode["window_start"]
        for v in events:
            if v["sequence"] is None or v["sequence"] != sequence + 1 or not before <= v["at"] <= episode["window_end"] or v["at"] < episode["window_start"]:
                say("chronology", v["event_id"])
            sequence, before = v["sequence"] or 0, v["at"]
            if v["actor_id"] not in ids:
                say("unknown_actor", v["event_id"])
            elif not any((v["action"], r["role"]) in grants for r in of("entities", e) if r["id"] == v["actor_id"] and r["role"]):
                say("authorization", v["event_id"])
            if v["duplicate_of"]:
                first = next(w for w in events if w["event_id"] == v["duplicate_of"])
                same = first["pos"] < v["pos"] and first["request_id"] == v["request_id"] is not None and first["expected_receipt"] == v["expected_receipt"]
                if not same or any(m["event_pos"] == v["pos"] for m in of("mutations", e)):
                    say("idempotency", v["event_id"])
            elif v["request_id"] and any(w["request_id"] == v["request_id"] and w["pos"] < v["pos"] for w in primary):
                say("request_reuse", v["event_id"])
            if not v["evidence_refs"]:
                say("evidence_presence", v["event_id"])
        totals = {}
        for leg in of("ledger", e):
            if leg["account_id"] not in ids:
                say("unknown_account", names[leg["event_pos"]])
            totals.setdefault((leg["event_pos"], leg["currency"]), []).append(leg["amount_minor"])
        for (pos, _), amounts in totals.items():
            if None in amounts or sum(amounts):
                say("ledger_balance", names[pos])
        now = {r["object_id"]: (r["state"], r["version"]) for r in of("states", e) if r["which"] == "initial"}
        initial = set(now)
        for m in sorted(of("mutations", e), key=lambda r: (r["event_pos"], r["pos"])):
            if m["object_id"] not in initial:
                say("unknown_object", names[m["event_pos"]])
            if m["object_id"] in now and (now[m["object_id"]] != (m["from_state"], m["from_version"]) or m["to_version"] != m["from_version"] + 1):
                say("version_chain", names[m["event_pos"]])
            now[m["object_id"]] = (m["to_state"], m["to_version"])
        final = {r["object_id"]: (r["state"], r["version"]) for r in of("states", e) if r["which"] == "final"}
        for o in set(now) | set(final):
            if now.get(o) != final.get(o):
                say("final_state")
    return sorted(out, key=repr)


def test_audit_equals_plain_loops(spark):
    data = random_episodes(60, 11)
    got = rows(A.audit(tables(spark, data)), "episode_id", "event_id", "check")
    assert got == audit_by_hand(data)
    assert {c for *_, c in got} == {c for c, _ in A.CHECK_ORDER} - {"duplicate_key"}


def test_patches_by_delta_equal_patched_copies(spark):
    t = tables(spark, random_episodes(40, 12))
    out = sensitivity(t, "x").persist()
    want = dict(rows(found_by_copies(t, out.select("episode_id", "kind", "event_pos", "patch_id"), "x"), "patch_id", "found"))
    got = dict(rows(out, "patch_id", "found"))
    assert got == {p: want.get(p) for p in got}
    assert len(got) > 300 and {r.kind for r in out.collect()} == set(EXPECTED_CHECK)


def test_an_event_of_more_than_a_million_mutations_keeps_its_place(spark):
    """Mutation 2^20 + 3 of event 1 comes before event 2, also across ranges."""
    n = (1 << 20) + 3
    step = F.col("id").cast("int")
    first = spark.range(n).select(
        F.lit("e").alias("episode_id"), F.lit(1).alias("event_pos"), step.alias("pos"), F.lit("o").alias("object_id"), F.concat(F.lit("s"), step).alias("from_state"),
        F.concat(F.lit("s"), step + 1).alias("to_state"), step.alias("from_version"), (step + 1).alias("to_version"),
    )
    after = spark.createDataFrame([("e", 2, 0, "o", f"s{n}", "end", n, n + 1)], DDL["mutations"])
    data = episode()
    data["events"], data["ledger"], data["challenges"] = data["events"][:2], [], []
    data["states"] = [dict(episode_id="e", which="initial", object_id="o", state="s0", version=0), dict(episode_id="e", which="final", object_id="o", state="end", version=n + 1)]
    t = tables(spark, data)
    wrong = after.withColumns({"object_id": F.lit("p"), "from_version": F.lit(n - 1)})
    data_p = [("e", which, "p", "s0" if which == "initial" else "end", 0 if which == "initial" else n + 1) for which in ("initial", "final")]
    t["states"] = t["states"].unionByName(spark.createDataFrame(data_p, DDL["states"]))
    # Object o goes on where its millionth step left it; object p, beside it, does not fit.
    t["mutations"] = first.unionByName(after).unionByName(wrong.withColumn("pos", F.lit(1)))
    assert rows(A.audit(t), "event_id", "check", "detail") == [("v2", "version_chain", "p")]


def test_audit_of_empty_tables(spark):
    t = tables(spark, {name: [] for name in DDL})
    assert rows(A.audit(t)) == [] and rows(sensitivity(t, "x")) == []


def test_state_digest_follows_the_state(make):
    ddl = "episode_id STRING, object_id STRING, step BIGINT, from_state STRING, from_version BIGINT, to_state STRING, to_version BIGINT"
    h = make(ddl, ("e", "a", 1, None, None, "s", 1), ("e", "b", 2, None, None, "s", 1), ("e", "a", 3, "s", 1, "t", 2), ("f", "b", 1, None, None, "s", 1), ("f", "a", 2, None, None, "t", 2))
    got = {(r.episode_id, r.step): r.state_root for r in C.state_after_step(h, ["episode_id"], "step", size=2).collect()}
    assert got["e", 3] == got["f", 2] != got["e", 2]


def test_enabled_transitions_and_contracted_state(spark):
    t = tables(spark, episode())
    moves = C.transitions(t["events"])
    applied = moves.where("event_pos = 1").select("episode_id", "transition_id")
    now = C.contracted_state(t["states"], t["mutations"].where("event_pos = 1"))
    assert rows(now) == [("e", "o", "open", 2)]
    # Event 2 changes nothing, so it is always enabled; event 4 needs version 2.
    assert rows(C.enabled_transitions(moves, t["mutations"], now, applied), "transition_id") == [("v2",), ("v4",)]
    start = C.contracted_state(t["states"], t["mutations"].where("false"))
    assert rows(C.enabled_transitions(moves, t["mutations"], start, applied.where("false")), "transition_id") == [("v1",), ("v2",)]


def test_call_rules(make):
    ddl = "id INT, attempts INT, statuses ARRAY<STRING>, status STRING, request_id STRING, response_present BOOLEAN, failure_class STRING, prompt_tokens INT, completion_tokens INT, total_tokens INT"
    d = make(
        ddl, (1, 2, ["429", "200"], "PASS", "r", True, None, 1, 2, 3), (2, 2, ["404", "200"], "PASS", "r", True, None, 1, 2, 3), (3, 4, ["429"] * 4, "FAIL", None, False, "HTTP", 1, 2, 3),
        (4, 1, ["500"], "PASS", None, True, None, 1, 2, 2), (5, 1, ["TRANSPORT"], "FAIL", None, False, "TRANSPORT", 0, 0, 0), (6, 1, ["500"], "LATER", None, False, "X", 0, 0, None),
    )
    got = rows(C.rule_violations(d, "calls", F.col("id"), C.call_history_rules(2)), "key", "rule_id")
    assert got == [("2", "earlier_retryable"), ("3", "attempt_count"), ("4", "pass_end"), ("4", "token_total"), ("6", "known_status"), ("6", "token_total")]
