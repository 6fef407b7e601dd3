"""Imports every query module so the registry is filled."""

from logsift.plans import (  # noqa: F401
    q_deadletter, q_evidence, q_fetch, q_intake, q_lines, q_outcomes, q_pods, q_reports, q_rules, q_store, q_streaming,
    q_templates,
)
from logsift.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
