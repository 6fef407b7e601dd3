"""Registered queries: the case lifecycle fold and stale sweep (the batch
definitions the streaming jobs apply per micro-batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.plans import oracle_views as ov
from logsift.plans.registry import query
from logsift.plans.views import v_status_event
from logsift.streaming.lifecycle import fold_status, sweep_stale

V_STATUS_EVENT = """
so AS (SELECT * FROM orders),
v_status_event AS (
  SELECT 'EV' || CAST(o_orderkey AS VARCHAR) AS case_id, o_orderdate AS status_at, 'LOGS_FETCHED' AS status FROM so
  UNION ALL SELECT 'EV' || CAST(o_orderkey AS VARCHAR), o_orderdate + INTERVAL 1 MINUTE, 'IN_PROGRESS' FROM so
  UNION ALL SELECT 'EV' || CAST(o_orderkey AS VARCHAR), o_orderdate + INTERVAL 3 MINUTE, 'FAILED_TIMEOUT' FROM so WHERE o_orderkey % 9 = 0
  UNION ALL SELECT 'EV' || CAST(o_orderkey AS VARCHAR), o_orderdate + INTERVAL 5 MINUTE,
           CASE o_orderkey % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'REJECTED' ELSE 'NEEDS_MANUAL_REVIEW' END FROM so WHERE o_orderkey % 6 <> 5
  UNION ALL SELECT 'EV' || CAST(o_orderkey AS VARCHAR), o_orderdate + INTERVAL 7 MINUTE, 'LOGS_FETCHED' FROM so WHERE o_orderkey % 8 = 0
  UNION ALL SELECT 'EV' || CAST(o_orderkey AS VARCHAR), o_orderdate + INTERVAL 8 MINUTE, 'DLQ' FROM so WHERE o_orderkey % 25 = 0)"""

_TERM = "('COMPLETED', 'REJECTED', 'NEEDS_MANUAL_REVIEW', 'FAILED_PERMANENT', 'DLQ', 'FAILED_TIMEOUT', 'FAILED_SYNTHESIS_PARSE', 'FAILED_SHUTDOWN')"

_FOLD = f"""
f AS (
  SELECT case_id,
    arg_min(status, status_at) FILTER (WHERE status IN ('FAILED_TIMEOUT', 'DLQ')) AS prot,
    arg_max(status, status_at) FILTER (WHERE status IN {_TERM}) AS term,
    arg_max(status, status_at) FILTER (WHERE status NOT IN {_TERM} AND status <> 'LOGS_FETCHED') AS live,
    max(status_at) FILTER (WHERE status = 'LOGS_FETCHED') AS fetched_at,
    max(status_at) FILTER (WHERE status NOT IN {_TERM} AND status <> 'LOGS_FETCHED') AS live_at,
    max(status_at) AS updated_at
  FROM v_status_event GROUP BY case_id),
cur AS (
  SELECT case_id, coalesce(prot, term, live, CASE WHEN fetched_at IS NOT NULL THEN 'LOGS_FETCHED' END) AS status,
         live_at AS started_at, updated_at
  FROM f)"""


@query("case_status", ov.with_views(V_STATUS_EVENT, _FOLD) + " SELECT * FROM cur")
def case_status(spark, sf_dir):
    """Current status per case: protected terminal first, then latest
    terminal, LOGS_FETCHED never overwriting a later state."""
    return fold_status(v_status_event(spark, sf_dir))


NOW = "1998-08-03 00:00:00"


@query("stale_sweep", ov.with_views(V_STATUS_EVENT, _FOLD) + f"""
SELECT case_id, TIMESTAMP '{NOW}' AS status_at, 'FAILED_TIMEOUT' AS status FROM cur
WHERE status = 'IN_PROGRESS' AND epoch(TIMESTAMP '{NOW}') - epoch(started_at) > 1800""")
def stale_sweep(spark, sf_dir):
    """Cases stuck IN_PROGRESS for more than 30 minutes -> FAILED_TIMEOUT."""
    cur = fold_status(v_status_event(spark, sf_dir))
    return sweep_stale(cur, F.lit(NOW).cast("timestamp")).withColumn("status_at", F.col("status_at").cast("timestamp_ntz"))
