"""Registered queries: log records, redaction and evidence selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.operators import evidence, records
from logsift.plans import oracle_views as ov
from logsift.plans.registry import query
from logsift.plans.views import v_flow_log, v_log

CTX_BEFORE, CTX_AFTER = evidence.ERROR_CONTEXT_BEFORE, evidence.ERROR_CONTEXT_AFTER


def prepared_log(spark, sf_dir):
    return records.prepare_records(v_log(spark, sf_dir), allow=("flow_id", "ref_id"))


_REDUCED_SQL = ov.with_views(ov.V_FLOW_LOG, ov.V_REC, f"""
n AS (
  SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY ts, line_id) AS rn,
         count(*) OVER (PARTITION BY flow_id) AS n_lines,
         min(CASE WHEN level = 'ERROR' THEN 1 END) OVER (PARTITION BY flow_id) AS has_err
  FROM v_rec),
e AS (
  SELECT *, min(CASE WHEN level = 'ERROR' THEN rn END) OVER (PARTITION BY flow_id) AS fe,
            max(CASE WHEN level = 'ERROR' THEN rn END) OVER (PARTITION BY flow_id) AS le
  FROM n),
rendered AS (
  SELECT *, '[' || timestamp || '] [' ||
         CASE WHEN coalesce(pod_name, '') <> '' THEN app_name || '@' || pod_name ELSE app_name END
         || '] [' || level || '] ' || message AS tl,
         '  [' || timestamp || '] [' || level || '] ' || message AS sl
  FROM e)
SELECT flow_id, 'full' AS route, 'trace' AS section, ts, line_id, tl AS line
FROM rendered WHERE n_lines < 50
UNION ALL
SELECT flow_id, 'error_context', 'context', ts, line_id,
       CASE WHEN level = 'ERROR' THEN ' *** ' ELSE '     ' END || tl
FROM rendered WHERE n_lines >= 50 AND has_err = 1 AND rn BETWEEN fe - {CTX_BEFORE} AND le + {CTX_AFTER}
UNION ALL
SELECT flow_id, 'reduced', 'boundary_first', ts, line_id, sl
FROM rendered WHERE n_lines >= 50 AND has_err IS NULL AND rn = 1
UNION ALL
SELECT flow_id, 'reduced', 'boundary_last', ts, line_id, sl
FROM rendered WHERE n_lines >= 50 AND has_err IS NULL AND rn = n_lines AND n_lines > 1
UNION ALL
SELECT flow_id, 'reduced', 'decision', ts, line_id, sl
FROM rendered WHERE n_lines >= 50 AND has_err IS NULL AND regexp_matches(message, '{evidence.DECISION_VOCABULARY_RE}')
""")


@query("reduced_evidence", _REDUCED_SQL)
def reduced_evidence(spark, sf_dir):
    """Flagship: records -> level -> redaction -> route -> evidence lines."""
    lines = records.prepare_records(v_flow_log(spark, sf_dir), allow=("flow_id", "ref_id"))
    return evidence.reduce_evidence(lines, before=CTX_BEFORE, after=CTX_AFTER)


@query("redaction_totals", ov.with_views(ov.V_LOG, ov.V_REC) + """
SELECT label, CAST(sum(n) AS BIGINT) AS redacted FROM (
  SELECT 'VID' AS label, c_vid AS n FROM v_rec UNION ALL SELECT 'AADHAAR', c_aadhaar FROM v_rec
  UNION ALL SELECT 'MOBILE', c_mob FROM v_rec UNION ALL SELECT 'EMAIL', c_email FROM v_rec) WHERE n > 0 GROUP BY label""")
def redaction_totals(spark, sf_dir):
    """Redaction hits per pattern label over every log record."""
    return records.redaction_totals(prepared_log(spark, sf_dir))
