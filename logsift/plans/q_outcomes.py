"""Registered queries: verdicts, accuracy, shadow scoring, promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.operators import outcomes as O
from logsift.plans import oracle_views as ov
from logsift.plans.registry import query
from logsift.plans.views import v_casebook, v_verdict

_VIEWS = ov.with_views(ov.V_CASEBOOK, ov.V_VERDICT, ov.V_OUTCOME)


def outcomes_df(spark, sf_dir):
    return O.record_outcomes(v_verdict(spark, sf_dir), v_casebook(spark, sf_dir))


@query("outcomes_recorded", _VIEWS + " SELECT * FROM v_outcome")
def outcomes_recorded(spark, sf_dir):
    """Validated verdicts, latest per event, denormalised from the casebook."""
    out, _ = outcomes_df(spark, sf_dir)
    return out


@query("outcome_rejects", _VIEWS + """
, j AS (SELECT v.*, upper(trim(coalesce(v.verdict, ''))) AS vv, c.event_id IS NOT NULL AS has_case
        FROM v_verdict v LEFT JOIN (SELECT event_id FROM v_casebook) c USING (event_id))
SELECT event_id, verdict, verified_by, verified_at, notes, corrected_action,
       CASE WHEN vv NOT IN ('CORRECT', 'INCORRECT', 'PARTIAL')
            THEN 'verdict must be one of (''CORRECT'', ''INCORRECT'', ''PARTIAL''), got ''' || vv || ''''
            ELSE 'No casebook found for event ' || event_id END AS reject_reason
FROM j WHERE vv NOT IN ('CORRECT', 'INCORRECT', 'PARTIAL') OR NOT has_case""")
def outcome_rejects(spark, sf_dir):
    """Verdicts refused: unknown verdict word or no casebook for the event."""
    _, rej = outcomes_df(spark, sf_dir)
    return rej


@query("accuracy_by_code", _VIEWS + " SELECT * FROM v_acc2")
def accuracy_by_code(spark, sf_dir):
    """Accuracy per (reason code, enrolment type, source kind)."""
    out, _ = outcomes_df(spark, sf_dir)
    return O.accuracy(out)


@query("shadow_scores", _VIEWS + " SELECT * FROM v_shadow2")
def shadow_scores(spark, sf_dir):
    """Shadowed runbooks: agreement, would-be accuracy, agent accuracy."""
    out, _ = outcomes_df(spark, sf_dir)
    return O.shadow_scores(out)


def _pct(x):
    return f"printf('%.1f', {x} * 100.0) || '%'"


@query("promotion_readiness", _VIEWS + f"""
SELECT *, CASE WHEN verdicts > 0 AND would_be_accuracy < agent_accuracy THEN 'DO NOT PROMOTE'
               WHEN verdicts < 20 THEN 'NOT READY' ELSE 'READY' END AS readiness,
       CASE WHEN verdicts > 0 AND would_be_accuracy < agent_accuracy
              THEN 'DO NOT PROMOTE: would be ' || {_pct('would_be_accuracy')} || ' against the agents'' ' || {_pct('agent_accuracy')}
                   || CASE WHEN verdicts < 20 THEN ' (on only ' || CAST(verdicts AS VARCHAR) || ' verified outcome(s))' ELSE '' END
            WHEN verdicts < 20 THEN 'NOT READY: only ' || CAST(verdicts AS VARCHAR) || ' verified outcome(s), need 20'
            ELSE 'READY: add ' || reason_code || ' to RUNBOOK_SERVE_ALLOWLIST' END AS readiness_text
FROM v_shadow2 WHERE shadowed >= 1""")
def promotion_readiness(spark, sf_dir):
    """Promotion gate per shadowed runbook (min 20 verified outcomes)."""
    out, _ = outcomes_df(spark, sf_dir)
    return O.promotion_readiness(O.shadow_scores(out))


@query("agent_vs_runbook", _VIEWS + """
, a AS (SELECT reason_code, enrolment_type, accuracy AS agent_accuracy, total AS agent_n FROM v_acc2 WHERE resolution_source = 'agent'),
r AS (SELECT reason_code, enrolment_type, accuracy AS runbook_accuracy, total AS runbook_n FROM v_acc2 WHERE resolution_source = 'runbook')
SELECT a.reason_code, a.enrolment_type, agent_accuracy, agent_n, runbook_accuracy, runbook_n,
       round(runbook_accuracy - agent_accuracy, 4) AS delta,
       CASE WHEN runbook_accuracy - agent_accuracy >= 0 THEN 'runbook OK' ELSE 'runbook WORSE' END AS comparison
FROM a JOIN r USING (reason_code, enrolment_type)""")
def agent_vs_runbook(spark, sf_dir):
    """Agent against runbook accuracy on the same code and type."""
    out, _ = outcomes_df(spark, sf_dir)
    return O.agent_vs_runbook(O.accuracy(out))


@query("pending_verdicts", _VIEWS + """
SELECT c.* FROM v_casebook c
WHERE status IN ('COMPLETED', 'REJECTED', 'NEEDS_MANUAL_REVIEW', 'FAILED_PERMANENT', 'DLQ', 'FAILED_TIMEOUT',
                 'FAILED_SYNTHESIS_PARSE', 'FAILED_SHUTDOWN')
  AND NOT EXISTS (SELECT 1 FROM v_outcome o WHERE o.event_id = c.event_id)""")
def pending_verdicts(spark, sf_dir):
    """Terminal casebooks still waiting for an operator verdict."""
    out, _ = outcomes_df(spark, sf_dir)
    return O.pending_verdicts(v_casebook(spark, sf_dir), out)
