"""Registered queries against their SQL on the smallest tables.

A few from every module by default; AUDITFRAME_ALL=1 runs all of them.
"""
from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from auditframe.plans import ORACLES, QUERIES
from tests.oracle import DATA, compare, connect

SOME = (
    "strategy_run", "usage_nullsafe", "authoritative_docs", "gold_cases", "ledger_conservation", "version_chain", "panel_grouping_sets", "panel_medians",
    "claim_errors", "citation_markers", "refusal_citations", "contamination", "paired_bootstrap", "cost_cards", "readiness", "manifest_diff", "requirement_status", "jsonl_scan", "dedup_stream",
    "manifest_digest", "manifest_proofs", "evidence_pack", "evidence_verify", "evidence_export", "state_after_step", "state_root", "set_variation", "episode_audit",
    "mutation_sensitivity", "panel_audit", "public_summary", "case_packages", "request_sessions_stream", "version_stream", "log_manifest", "split_disjoint",
)
#: Queries that find nothing in the smallest tables.
NOTHING_SMALL = ("secret_scan", "shortlist_siblings")
NAMES = list(QUERIES) if os.environ.get("AUDITFRAME_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(DATA.format("0.001"))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problem = compare(spark, con, name, QUERIES[name], ORACLES[name], DATA.format("0.001"))
    assert problem is None or (problem == "no rows" and name in NOTHING_SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
