from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from auditframe.operators import allocation as A
from auditframe.operators import claims as K
from auditframe.operators import leak as L
from auditframe.operators import panel as P
from auditframe.operators import stats as St
from tests.conftest import rows

CLAIM = "task_id INT, claim_id INT, pos INT, subject STRING, relation STRING, object STRING, polarity STRING, qualifiers MAP<STRING,STRING>, evidence_ids ARRAY<STRING>"
PROP = "task_id INT, evidence_id STRING, subject STRING, relation STRING, object STRING, polarity STRING, qualifiers MAP<STRING,STRING>"
SAID = ("Ann", "holds", "A", "affirmed", {"at": "10:00:00"})


@pytest.fixture
def props(make):
    return make(PROP, (1, "e1", "Ann", "holds", "A", "affirmed", {"at": "10:00:00"}), (1, "e2", " Ann ", "holds", "A", "affirmed", {"at": "10:00:00"}), (1, "e3", "Bob", "holds", "A", "affirmed", {}))


def test_claim_edge_cases(make, props):
    def claim(i, ids, **change):
        said = dict(zip(("subject", "relation", "object", "polarity", "qualifiers"), SAID))
        return (1, i, i, *{**said, **change}.values(), ids)

    c = make(
        CLAIM, claim(1, ["e1"]), claim(2, ["e1", "e2"]), claim(3, ["e1", "e3"]), claim(4, ["e1"], polarity="negated"), claim(5, ["e1"], relation="owns"),
        claim(6, ["e1"], qualifiers={"at": "10:00:01"}), claim(7, []), claim(8, ["e1", "e1"]), claim(9, ["e9"]), claim(10, ["e1"], subject="Ann  "),
    )
    supplied = props.select("task_id", "evidence_id").distinct()
    assert [i for _, i, ok in rows(K.claim_support(c, props)) if ok] == [1, 10, 2, 8]
    assert dict(rows(K.claim_errors(c, props, supplied), "claim_id", "error_code")) == {
        1: None, 2: None, 3: "UNSUPPORTED_ADDITION", 4: "UNSUPPORTED_ADDITION", 5: "UNSUPPORTED_ADDITION", 6: "UNSUPPORTED_ADDITION", 7: "VALIDATION_REJECTED",
        8: "VALIDATION_REJECTED", 9: "EVIDENCE_OUTSIDE_SET", 10: None,
    }


def test_refusals(make, props):
    cover = make("task_id INT, evidence_id STRING, subject STRING, relation STRING, qualifiers MAP<STRING,STRING>", (1, "e3", "Bob", "holds", {}), (2, "e3", "Bob", "holds", {}), (3, "e3", "Bob", "holds", {}))
    ddl = "task_id INT, subject STRING, relation STRING, object STRING, polarity STRING, qualifiers MAP<STRING,STRING>, evidence_ids ARRAY<STRING>"
    r = make(ddl, (1, "Bob", "holds", "A", "affirmed", {}, ["e3"]), (2, "Bob", "holds", "Z", "affirmed", {}, ["e1", "e3"]), (3, "Bob", "holds", "Z", "affirmed", {"x": "y"}, ["e3"]))
    assert rows(K.refusal_verdicts(r, props, cover)) == [(1, "contradicted"), (2, "accepted"), (3, "uncovered")]


def test_rendering(make):
    c = make(
        CLAIM, (1, 1, 1, "Ann [x]", "holds", "A", "affirmed", {"b": "2", "a": "1"}, ["e2", "e1"]), (1, 2, 2, "Bob", "holds", "B", "negated", {}, ["e1", "e3"]), (1, 3, 3, "Cy", "holding of", "C", "unknown", {}, ["e2"]),
    )
    m = K.citation_markers(c)
    assert rows(m, "evidence_id", "marker", "claims") == [("e1", "[2]", 2), ("e2", "[1]", 2), ("e3", "[3]", 1)]
    assert [s for _, s in rows(K.rendered_claims(c, m), "claim_id", "sentence")] == [
        "Ann (x) holds A (a=1, b=2). [1] [2]", "Bob does not holds B. [2] [3]", "Cy has unknown holding of C. [1]",
    ]


def test_refusals_carry_their_markers(make):
    ddl = "task_id INT, subject STRING, relation STRING, object STRING, evidence_ids ARRAY<STRING>"
    r = make(ddl, (1, "Ann", "holds", "A", ["e2", "e1", "e2"]), (2, "Bob [y]", "holds", "B", ["e9"]))
    m = K.citation_markers(K.cited_refusals(r))
    assert rows(m, "task_id", "evidence_id", "marker", "citation_id", "claims") == [(1, "e1", "[2]", "citation-002", 0), (1, "e2", "[1]", "citation-001", 0), (2, "e9", "[1]", "citation-001", 0)]
    assert rows(K.rendered_refusals(r, m), "task_id", "sentence") == [
        (1, "The supplied evidence does not establish that Ann holds A. [1] [2] [1]"), (2, "The supplied evidence does not establish that Bob (y) holds B. [1]"),
    ]


def test_needles_equal_brute_force(make):
    texts = [(1, "see case-12 and case-7."), (2, "case-123"), (3, "xxabcdefghijklmyy"), (4, "the quick brown fox jumps over"), (5, "quick browny fox")]
    needles = ["case-12", "case-7", "case-99"]
    t, n = make("id INT, t STRING", *texts), make("needle STRING", *[(x,) for x in needles])
    assert rows(L.shaped_leaks(t, "id", "t", n, r"case-\d+"), "id", "needle") == [(1, "case-12"), (1, "case-7")]
    phrases = ["quick brown fox", "he quick brow", "abcdefghijkl", "see case-12 a", "brown foxes!!", "wn fox jumps "]
    got = rows(L.substring_leaks(t, "id", "t", make("needle STRING", *[(p,) for p in phrases])), "id", "needle")
    assert got == sorted(((i, p) for i, s in texts for p in phrases if p in s), key=repr)


def test_publish_fails_closed(make):
    report = make("model STRING, complete INT, secret STRING", ("m1", 3, "x"), ("m2", 4, "case-12"))
    needles = make("needle STRING", ("case-12",))
    assert rows(L.publish(report, ["model", "complete"], needles)) == [("m1", 3), ("m2", 4)]
    leaking = L.publish(report, ["model", "secret"], needles)
    for read in (leaking.collect, leaking.count, leaking.select("model").collect, leaking.select("secret").collect):
        with pytest.raises(Exception, match="private identifier"):
            read()
    embedded = L.publish(make("model STRING", ("xSettlementsx",)), ["model"], make("needle STRING", ("Settlement",)))
    with pytest.raises(Exception, match="private identifier"):
        embedded.count()


def test_needles_of_any_length(make):
    texts = make("id INT, t STRING", (1, "a fox ran"), (2, "afoxb"), (3, "fo x"), (4, ""))
    got = rows(L.substring_leaks(texts, "id", "t", make("needle STRING", ("fox",), ("x",), ("",))), "id", "needle")
    assert got == [(1, "fox"), (1, "x"), (2, "fox"), (2, "x"), (3, "x")]


def test_gold_record_leaked_from_its_middle(make):
    record = "".join(chr(97 + (k * k) % 26) + str(k) for k in range(90))
    files = make("path STRING, text STRING", ("a", "zz" + record[73:133] + "zz"), ("b", "zz" + record[73:132] + "zz"), ("c", "short whole"))
    gold = make("record STRING", (record,), ("short whole",))
    assert rows(L.gold_leaks(files, "path", "text", gold), "path") == [("a",), ("c",)]


def test_supplement_and_pairs_refuse_whatever_is_read(make):
    main, extra = make("model STRING, n INT", ("m1", 1)), make("model STRING, n INT", ("m1", 2))
    both = P.supplement(main, extra)
    for read in (both.count, both.select("n").collect):
        with pytest.raises(Exception, match="overwrite"):
            read()
    with pytest.raises(Exception, match="identical episodes"):
        St.paired(make("arm_id STRING, episode_id INT, success BOOLEAN", ("t", 1, True), ("c", 2, True)), "t", "c").count()


def test_job_table_takes_any_number_of_arms(make):
    arms = make("arm_id STRING, checkpoint_sha256 STRING", *[(f"a{k}", "c") for k in range(1001)])
    jobs = A.job_table(arms, make("evaluation_seed INT", (1,), (2,)), make("episode_id INT", (1,), (2,), (3,)))
    assert jobs.select("job_id").distinct().count() == 6006


def test_markers_follow_the_claims_also_beyond_the_limit(make):
    ids = [f"e{k:02}" for k in range(40)]
    claims = make("task_id STRING, pos INT, claim_id STRING, evidence_ids ARRAY<STRING>", ("t", 0, "c0", ids), ("t", 1, "c1", ["z"]))
    got = {r.evidence_id: r.marker_number for r in K.citation_markers(claims).collect()}
    assert got == {**{e: k + 1 for k, e in enumerate(ids)}, "z": 41}


def test_schema_and_json_keys(make):
    d = make("a INT, b STRUCT<c: INT, d: ARRAY<STRUCT<gold: INT>>>", (1, (2, [(3,)])))
    with pytest.raises(ValueError, match="gold"):
        L.safe_projection(d, ["a", "b"], ["gold"])
    assert L.safe_projection(d, ["a"], ["gold"]).columns == ["a"]
    j = make("i INT, j STRING", (1, '{"a": {"hidden_state" : 1}}'), (2, '{"mutations":[]}'), (3, '{"a":"hidden_state"}'), (4, "not json"), (5, '{"hidden\\u005fstate":1}'))
    keys = L.FORBIDDEN_OUTPUT_KEYS
    assert rows(j.select("i", L.has_forbidden_key(F.col("j"), keys), L.has_forbidden_top_key(F.col("j"), keys))) == [(1, True, False), (2, True, True), (3, False, False), (4, False, False), (5, True, True)]


def test_secrets_paths_and_canary(spark, make):
    t = make("i INT, t STRING", (1, "key AKIA" + "A" * 16), (2, "Authorization: Bearer abcdefghijklmnop"), (3, "clean"))
    assert rows(L.pattern_hits(t, "i", "t", {str(n): p for n, p in enumerate(L.SECRET_PATTERNS)})) == [(1, "0"), (2, "7")]
    p = make("path STRING", ("/etc/x",), ("a/../b",), ("a..b/c",), ("ok/x",))
    assert rows(L.path_problems(p, "path"), "path") == [("/etc/x",), ("a/../b",)]
    episodes = L.with_canary(make("run INT, ep STRING", (1, "e1"), (1, "e2")), F.lit("salt"), F.col("ep"))
    want = "CANARY-" + hmac.new(b"salt", b"e1", hashlib.sha256).hexdigest()[:16]
    responses = make("run INT, ep STRING, text STRING", (1, "e1", f"so {want}!"), (1, "e2", want))
    assert rows(L.canary_echoes(responses, episodes, ["run", "ep"]), "ep") == [("e1",)]


def test_contamination_and_gold(make):
    words = [f"w{i}" for i in range(20)]
    a = make("i INT, t STRING", (1, " ".join(words)), (2, "short text"), (3, ""))
    b = make("i INT, t STRING", (9, " ".join(words[3:17])), (8, "Short, TEXT"))
    r = L.contamination(a, b, "i", "t").collect()[0]
    assert (r.sealed_shingles, r.candidate_shingles, r.overlap_shingles, r.status) == (3, 9, 3, "FAIL")
    files = make("path STRING, text STRING", ("x/Oracle.json", "no"), ("y", "see " + "g" * 70), ("z", "g" * 30))
    assert rows(L.gold_leaks(files, "path", "text", make("record STRING", ("g" * 80,)))) == [("x/Oracle.json", "matches evaluator-only naming"), ("y", "embeds gold content")]


@pytest.mark.parametrize(
    ("failed", "state"),
    [((), "RELEASE_AUDIT_PASS"), (("manifest_verification",), "RELEASE_AUDIT_PASS_WITH_LIMITATIONS"), (("source_shingle_overlap", "manifest_verification"), "SOURCE_OVERLAP_DETECTED"),
     (("source_shingle_overlap", "secret_scan"), "SECRET_OR_IDENTIFIER_LEAK"), (("private_gold_leak", "secret_scan"), "PRIVATE_GOLD_LEAK")],
)
def test_terminal_state(make, failed, state):
    names = ("private_gold_leak", "secret_scan", "internal_identifier_scan", "source_shingle_overlap", "manifest_verification")
    g = make("gate STRING, status STRING", *[(n, "FAIL" if n in failed else "PASS") for n in names])
    assert rows(L.terminal_state(g)) == [(state,)]


def test_bootstrap_is_reproducible_and_guards_coverage(make):
    ddl = "arm_id STRING, episode_id INT, success BOOLEAN"
    s = make(ddl, *[("t", i, i % 3 > 0) for i in range(60)], *[("c", i, i % 2 > 0) for i in range(60)])
    one = St.paired_bootstrap(St.paired(s, "t", "c"), "episode_id", seed="x").collect()
    two = St.paired_bootstrap(St.paired(s.repartition(5), "t", "c"), "episode_id", seed="x").collect()
    assert one == two and one[0].cluster_count == 60 and one[0].ci95_low <= one[0].effect <= one[0].ci95_high
    with pytest.raises(ValueError):
        St.paired_bootstrap(s, "episode_id", seed="x", samples=199)
    with pytest.raises(Exception, match="identical episodes"):
        St.paired(s.where("NOT (arm_id = 'c' AND episode_id = 3)"), "t", "c").collect()


def test_verdicts_treat_unmeasured_as_unsupported(make):
    ddl = "is_baseline BOOLEAN, completion_rate DOUBLE, forbidden_output_keys INT, canary_echoes INT, unauthorized_rejections INT, schema_or_malformed_rejections INT, state_changes_outside_contract INT"
    good, none = make("as_expected BOOLEAN", (True,)), make("check STRING")
    base = (True, 1.0, 0, 0, 0, 0, 0)
    assert dict(rows(St.verdicts(make(ddl, base), good, none))) == {"H0": "SUPPORTED", "H1": "SUPPORTED", "H2": "NOT_RUN", "H3": "NOT_RUN"}
    model = (False, 0.4, 0, 0, 9, 0, None)
    assert dict(rows(St.verdicts(make(ddl, model), good.where("false"), none))) == {"H0": "FALSIFIED", "H1": "FALSIFIED", "H2": "FALSIFIED", "H3": "FALSIFIED"}


def test_needles_are_anchored_at_their_rarest_word(make):
    texts = make("id INT, t STRING", *[(i, f"internationalisation is common, item {i} of lot {i // 10}.") for i in range(200)])
    needles = make("needle STRING", ("common, item 17 of",), (", item 18 of lot 1.",), ("x nowhere y",), ("mmon",))
    got = {r.needle: (r._word, r._n) for r in L.rarest_words(needles, L.words_of(texts, "id", "t")).collect()}
    # An item's number stands in its own text and in the ten of the lot of that number; "item", "lot" and "common" in all.
    assert got == {"common, item 17 of": ("17", 11), ", item 18 of lot 1.": ("1", 11), "mmon": (None, None)}
    found = rows(L.substring_leaks(texts, "id", "t", needles), "needle", "id")
    assert found == sorted([("common, item 17 of", 17), (", item 18 of lot 1.", 18), *[("mmon", i) for i in range(200)]], key=repr)


def test_panel_report_stops_at_what_is_not_bound(make):
    report, pair = make("model STRING, score DOUBLE", ("m", 1.0)), "model STRING, case_id STRING"
    plan, records = make(pair, ("m", "a"), ("m", "b")), make(pair, ("m", "a"))
    sealed = make("case_id STRING, case_sha256 STRING", ("a", "1"), ("b", "2"))
    turns = "model STRING, turn INT, turn_sha256 STRING, body_sha256 STRING, provider_error BOOLEAN"
    entries = make("model STRING, turn INT, sha256 STRING, response_sha256 STRING", ("m", 1, "s", "r"))

    def audit(records=records, answers=sealed, turn=("m", 1, "s", "r", False)):
        return P.audited(report, plan, records, P.answer_bindings(sealed, answers), P.response_commitments(entries, make(turns, turn), ["model", "turn"]))

    assert rows(audit()) == [("m", 1.0)]
    for reason, case in (
        ("response commitment", {"turn": ("m", 1, "s", "tampered", False)}), ("response commitment", {"turn": ("m", 1, "tampered", "r", False)}), ("response commitment", {"turn": ("m", 2, "s", "r", False)}),
        ("answers do not bind", {"answers": sealed.where("case_id = 'a'")}), ("answers do not bind", {"answers": make("case_id STRING, case_sha256 STRING", ("a", "1"), ("b", "9"))}),
        ("outside the plan", {"records": make(pair, ("m", "z"))}), ("there twice", {"records": make(pair, ("m", "a"), ("m", "a"))}),
    ):
        for read in (lambda d: d.count(), lambda d: d.select("score").collect()):
            with pytest.raises(Exception, match=reason):
                read(audit(**case))


def test_a_patch_that_passes_turns_the_first_hypothesis(make):
    run = "is_baseline BOOLEAN, completion_rate DOUBLE, forbidden_output_keys INT, canary_echoes INT, unauthorized_rejections INT, schema_or_malformed_rejections INT, state_changes_outside_contract INT"
    runs = make(run, (True, 1.0, 0, 0, 0, 0, 0), (False, 0.5, 0, 0, 3, 1, None))
    good, bad = make("as_expected BOOLEAN", (True,), (True,)), make("as_expected BOOLEAN", (True,), (False,))
    one, none = make("check STRING", ("chronology",)), make("check STRING")
    verdict = lambda patches, found: dict(rows(St.verdicts(runs, patches, found)))
    assert verdict(good, none) == {"H0": "SUPPORTED", "H1": "SUPPORTED", "H2": "SUPPORTED", "H3": "FALSIFIED"}
    assert verdict(bad, none)["H1"] == verdict(good, one)["H1"] == verdict(good.limit(0), none)["H1"] == "FALSIFIED"


def test_readiness_counts_jobs_by_what_is_known(make):
    ddl = "job_id STRING, arm_id STRING, evaluation_seed INT, episode_id STRING, checkpoint_sha256 STRING"
    jobs = make(ddl, *[(f"j{i}", "a", i, "e", "c") for i in range(6)])
    started = make("job_id STRING", ("j0",), ("j1",), ("j4",), ("j4",), ("jx",))
    records = make(ddl, ("j0", "a", 0, "e", "c"), ("j1", "a", 1, "e", "other"), ("j2", "a", 2, "e", "c"), ("j2", "a", 2, "e", None), ("j3", "a", 3, "e", "c"), ("j3", "a", 3, "e", "c"), ("jx", "a", 9, "e", "c"))
    assert rows(A.readiness(jobs, started, records)) == [(6, 2, 2, 1, 2, "BLOCKED_MISSING_OR_INVALID_INPUTS")]
    good = records.where("job_id in ('j0', 'j3')")
    assert rows(A.readiness(jobs, started.where("job_id = 'j0'"), good), "verified", "pending", "status") == [(2, 4, "READY_TO_EXECUTE")]
