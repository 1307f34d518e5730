"""Hand-computed values, and the exhaustive 8 x 16 matrix through answers, and citations."""
from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from auditframe.operators import replay as Y
from auditframe.operators import rules as R
from tests.conftest import rows

RECORD = dict(
    instruction_total=1000, block_quantity=1000, statement_balance=1000, opening_balance=100, exposure=1000, collateral=400, threshold=100,
    minimum_transfer=1, requested_mask=15, approved_mask=7, revoked_mask=2, cutoff_minute=50, approved_issuers=[1, 2], opening_sequence=5,
)
DDL = (
    "case_id BIGINT, family STRING, policy_id STRING, record_id STRING, control_id STRING, approval_limit BIGINT, escalation_owner STRING, "
    "supporting_evidence_verified BOOLEAN, risk_amount BIGINT, instruction_total BIGINT, block_quantity BIGINT, statement_balance BIGINT, opening_balance BIGINT, "
    "exposure BIGINT, collateral BIGINT, threshold BIGINT, minimum_transfer BIGINT, requested_mask BIGINT, approved_mask BIGINT, revoked_mask BIGINT, cutoff_minute INT, "
    "approved_issuers ARRAY<BIGINT>, opening_sequence BIGINT"
)
FACTS = (
    "case_id BIGINT, event_id STRING, pos BIGINT, amount BIGINT, completed BOOLEAN, quantity BIGINT, effective_minute INT, revision INT, notional BIGINT, "
    "issuer BIGINT, valid BOOLEAN, sequence BIGINT, acknowledged BOOLEAN"
)


def case(case_id, family, verified=True, risk=10, **change):
    r = {**RECORD, **change}
    return (case_id, family, f"p{case_id}", f"r{case_id}", f"c{case_id}", 10, "queue", verified, risk, *r.values())


def fact(case_id, event_id, pos, amount=0, completed=True, quantity=0, minute=0, revision=0, notional=0, issuer=0, valid=True, sequence=0, ack=True):
    return (case_id, event_id, pos, amount, completed, quantity, minute, revision, notional, issuer, valid, sequence, ack)


def targets(make, cases, facts):
    got = R.case_measures(make(DDL, *cases), make(FACTS, *facts))
    return dict(rows(got, "case_id", "value"))


def test_hand_computed_values(make):
    cases = [
        case(1, "margin", minimum_transfer=501), case(2, "margin", minimum_transfer=500), case(3, "permissions"), case(4, "temporal"), case(5, "settlement"),
        case(6, "allocations"), case(7, "reconciliation"), case(8, "lifecycle"), case(9, "evidence"), case(10, "temporal"), case(11, "lifecycle"),
    ]
    facts = [
        fact(4, "a", 0, sequence=6), fact(4, "b", 1, sequence=8), fact(4, "c", 2, sequence=7, ack=False),
        # The last row of an event wins, wherever the others stand.
        fact(5, "a", 0, amount=999), fact(5, "a", 1, amount=300), fact(5, "b", 2, amount=50, completed=False), fact(5, "c", 3, amount=100),
        fact(6, "a", 0, quantity=300), fact(6, "b", 1, quantity=200), fact(7, "a", 0, amount=-50), fact(7, "b", 1, amount=20),
        fact(8, "a", 0, minute=50, revision=1, notional=7), fact(8, "b", 1, minute=50, revision=2, notional=8), fact(8, "c", 2, minute=51, revision=9, notional=9),
        fact(8, "d", 3, minute=50, revision=2, notional=10),  # a tie: the event seen first stays
        fact(9, "a", 0, issuer=1), fact(9, "b", 1, issuer=1), fact(9, "c", 2, issuer=2, valid=False), fact(9, "d", 3, issuer=3),
        fact(11, "a", 0, minute=60, notional=4),
    ]
    want = {1: 0, 2: 500, 3: 5, 4: 6, 5: 600, 6: 500, 7: 930, 8: 8, 9: 1, 10: 5, 11: None}
    assert targets(make, cases, facts) == want
    inputs, last = make(DDL, *cases), R.last_facts(make(FACTS, *facts))
    each = {
        2: R.margin_value(inputs), 3: R.permission_value(inputs), 4: R.temporal_value(inputs, last), 5: R.settlement_value(inputs, last),
        6: R.allocation_value(inputs, last), 7: R.reconciliation_value(inputs, last), 8: R.lifecycle_value(inputs, last), 9: R.evidence_value(inputs, last),
    }
    for case_id, df in each.items():
        assert df.where(F.col("case_id") == case_id).collect()[0].value == want[case_id]


def test_conservation_after_execution(make):
    cases = [case(1, "settlement"), case(2, "allocations"), case(3, "reconciliation")]
    facts = [fact(1, "a", 0, amount=300), fact(2, "a", 0, quantity=10), fact(3, "a", 0, amount=5)]
    objects = R.business_objects(R.case_measures(make(DDL, *cases), make(FACTS, *facts)))
    assert rows(objects, "case_id", "remaining", "residual") == [(1, 0, None), (2, 0, None), (3, None, 0)]


def test_governing_document_must_be_unique_and_in_force(make):
    docs = make(
        "case_id BIGINT, doc_id STRING, kind STRING, status STRING, effective_minute INT",
        (1, "a", "policy", "CURRENT", 50), (1, "b", "policy", "ARCHIVED", 1), (1, "c", "policy", "CURRENT", 51), (1, "d", "record", "CURRENT", 1), (1, "e", "record", "CURRENT", 2),
    )
    cases = make("case_id BIGINT, cutoff_minute INT", (1, 50))
    assert rows(R.authoritative(docs, cases)) == [(1, "policy", "a")]
    assert rows(R.authoritative_violations(docs, cases)) == [(1, "control", 0), (1, "record", 2)]


# --- the 8 x 16 matrix ----------------------------------------------------------------------
@pytest.fixture(scope="module")
def matrix(spark):
    """Every family with every combination of the four conditions."""
    cases, facts = [], []
    for n, (family, flags) in enumerate(itertools.product(R.FAMILIES, itertools.product([False, True], repeat=4))):
        stale, duplicate, material, missing = flags
        cases.append(case(n, family, verified=not missing, risk=11 if material else 10, instruction_total=1000 + stale))
        facts += [fact(n, "a", 0, 300, quantity=30, minute=10, notional=3, issuer=1, sequence=6), fact(n, "b", 1, 200, quantity=20, minute=20, notional=4, issuer=2, sequence=7)]
        if duplicate:
            facts.append(fact(n, "a", 2, 300, quantity=30, minute=10, notional=3, issuer=1, sequence=6))
    inputs = spark.createDataFrame(cases, DDL)
    return R.resolve_cases(inputs, spark.createDataFrame(facts, FACTS)).cache()


def test_matrix_routes(matrix):
    """Missing evidence escalates, a material risk asks for approval, the rest executes."""
    assert dict(rows(matrix.groupBy("route").count())) == {"escalate": 64, "approve": 32, "execute": 32}


def test_split_by_parity_is_disjoint(spark):
    flags = spark.createDataFrame(list(itertools.product([False, True], repeat=4)), "a BOOLEAN, b BOOLEAN, c BOOLEAN, d BOOLEAN")
    split = R.compositional_split(flags, ["a", "b", "c", "d"])
    assert dict(rows(split.groupBy("split").count())) == {"development": 8, "evaluation": 8}


# --- citations -----------------------------------------------------------------------
DOCS = [("p", "hp"), ("r", "hr"), ("c", "hc")]


def test_citation_validity(make):
    a = make(
        "model STRING, case_id BIGINT, pos INT, citations ARRAY<STRUCT<id: STRING, sha256: STRING>>",
        ("m", 1, 3, DOCS), ("m", 1, 1, DOCS), ("m", 1, 4, DOCS[:1]), ("m", 1, 5, []), ("m", 1, 6, [("p", "wrong")]), ("m", 1, 7, [("nope", "hp")]),
    )
    reads = make("model STRING, case_id BIGINT, pos INT, doc_id STRING", ("m", 1, 0, "p"), ("m", 1, 1, "r"), ("m", 1, 2, "c"))
    docs = make("case_id BIGINT, doc_id STRING, sha256 STRING", *[(1, i, h) for i, h in DOCS])
    got = Y.citation_validity(a, reads, docs, make("case_id BIGINT, evidence ARRAY<STRING>", (1, ["p", "r", "c"])))
    assert rows(got, "pos", "valid", "complete") == [(1, False, False), (3, True, True), (4, True, False), (5, False, False), (6, False, False), (7, False, False)]
