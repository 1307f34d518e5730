"""Named queries over the test tables, each with its SQL counterpart."""
from auditframe.plans.registry import ORACLES, QUERIES
from auditframe.plans import (  # noqa: F401  registers their queries
    claims, contract, evidence, experiment, leak, panel, replay, rules, strategy, streams,
)

__all__ = ["ORACLES", "QUERIES"]
