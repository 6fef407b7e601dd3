"""Registered queries: index fetch, source chain, recall diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.operators import fetch as FE
from logsift.plans import oracle_views as ov
from logsift.plans.registry import query
from logsift.plans.views import v_log

APPS = ["svc-0", "svc-1"]
PHRASES = ["decision: packet status"]
NOW = "2024-01-31 00:00:00"
DAYS = 20


def _ids(spark, sf_dir):
    return v_log(spark, sf_dir).select("flow_id", F.col("ref_id").alias("identifier")).distinct()


_TOK = """
ids AS (SELECT DISTINCT flow_id, ref_id AS identifier FROM v_log),
hit AS (SELECT DISTINCT i.flow_id, l.line_id FROM v_log l JOIN ids i ON contains(l.message, i.identifier)),
lhit AS (SELECT DISTINCT i.flow_id, l.line_id FROM v_log l JOIN ids i ON contains(lower(l.message), lower(i.identifier)))"""


@query("index_fetch", ov.with_views(ov.V_LOG, _TOK) + f"""
, src AS (SELECT * FROM v_log WHERE app_name IN ('svc-0', 'svc-1') AND ts >= TIMESTAMP '{NOW}' - INTERVAL {DAYS} DAY
          AND NOT contains(message, 'decision: packet status'))
SELECT h.flow_id, s.line_id, s.timestamp, s.app_name, false AS truncated FROM hit h JOIN src s USING (line_id)""")
def index_fetch(spark, sf_dir):
    """Per id: matching records after app filter, look-back and boilerplate
    exclusion; all of them."""
    since = F.lit(NOW).cast("timestamp_ntz") - F.expr(f"INTERVAL {DAYS} DAYS")
    out = FE.index_fetch(_ids(spark, sf_dir), v_log(spark, sf_dir), APPS, since, PHRASES)
    return out.select("flow_id", "line_id", "timestamp", "app_name", "truncated")


@query("source_chain", ov.with_views(ov.V_LOG, _TOK) + """
, res AS (
  SELECT flow_id, 'kubernetes' AS source, 1 AS priority, CAST(substr(md5(flow_id), 1, 1) AS VARCHAR) NOT IN ('0', '1', '2', '3') AS ok,
         (SELECT count(*) FROM hit h WHERE h.flow_id = i.flow_id AND h.line_id % 2 = 0) AS records FROM (SELECT DISTINCT flow_id FROM ids) i
  UNION ALL
  SELECT flow_id, 'elastic', 2, true, (SELECT count(*) FROM hit h WHERE h.flow_id = i.flow_id) FROM (SELECT DISTINCT flow_id FROM ids) i),
r AS (SELECT *, ok AND records > 0 AS win, source || ' (' || CASE WHEN NOT ok THEN 'failed' ELSE 'returned no records' END || ')' AS tried FROM res),
p AS (SELECT flow_id, min(priority) FILTER (WHERE win) AS wp, count(*) AS n FROM r GROUP BY flow_id)
SELECT p.flow_id,
  CASE WHEN wp IS NOT NULL THEN (SELECT source FROM r WHERE r.flow_id = p.flow_id AND r.priority = wp)
       ELSE (SELECT arg_max(source, priority) FROM r WHERE r.flow_id = p.flow_id) END AS source,
  wp IS NOT NULL AS has_records,
  CASE WHEN wp IS NOT NULL AND (SELECT count(*) FROM r WHERE r.flow_id = p.flow_id AND r.priority < wp) > 0
         THEN 'tried ' || (SELECT string_agg(tried, ', ' ORDER BY priority) FROM r WHERE r.flow_id = p.flow_id AND r.priority < wp)
              || ' first without success; the trace below came from ' || (SELECT source FROM r WHERE r.flow_id = p.flow_id AND r.priority = wp) || '.'
       WHEN wp IS NULL AND (n > 1 OR NOT (SELECT arg_max(ok, priority) FROM r WHERE r.flow_id = p.flow_id))
         THEN 'no source returned logs; tried ' || (SELECT string_agg(tried, ', ' ORDER BY priority) FROM r WHERE r.flow_id = p.flow_id) || '.'
  END AS fallback_gap
FROM p""")
def source_chain(spark, sf_dir):
    """Source fallback per id: pod logs first, index second."""
    ids = _ids(spark, sf_dir)
    lines = v_log(spark, sf_dir)
    from logsift.operators.pods import match_ids
    hits = match_ids(lines, ids, line="message", key=("line_id",))
    k8s = hits.groupBy("flow_id").agg(F.count_if(F.col("line_id") % 2 == 0).alias("records"))
    es = hits.groupBy("flow_id").agg(F.count(F.lit(1)).alias("records"))
    flows = ids.select("flow_id").distinct()
    res = (flows.join(k8s, "flow_id", "left").select(
        "flow_id", F.lit("kubernetes").alias("source"), F.lit(1).alias("priority"),
        (~F.substring(F.md5("flow_id"), 1, 1).isin("0", "1", "2", "3")).alias("ok"),
        F.coalesce("records", F.lit(0)).alias("records"))
        .unionByName(flows.join(es, "flow_id", "left").select(
            "flow_id", F.lit("elastic").alias("source"), F.lit(2).alias("priority"), F.lit(True).alias("ok"),
            F.coalesce("records", F.lit(0)).alias("records"))))
    return FE.source_chain(res)


@query("recall_variants", ov.with_views(ov.V_LOG, _TOK) + """
, j AS (SELECT l.flow_id, l.line_id, h.line_id IS NOT NULL AS ex, v.app_name, v.message
        FROM lhit l LEFT JOIN hit h USING (flow_id, line_id) JOIN v_log v ON v.line_id = l.line_id),
c AS (SELECT flow_id, count(*) FILTER (WHERE ex AND app_name IN ('svc-0', 'svc-1') AND NOT contains(message, 'decision: packet status')) AS a,
             count(*) FILTER (WHERE ex AND NOT contains(message, 'decision: packet status')) AS b,
             count(*) FILTER (WHERE app_name IN ('svc-0', 'svc-1')) AS c, count(*) AS d,
             list_sort(list_distinct(list(app_name) FILTER (WHERE app_name NOT IN ('svc-0', 'svc-1')))) AS other
      FROM j GROUP BY flow_id),
a AS (SELECT i.flow_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d, coalesce(other, []) AS other
      FROM (SELECT DISTINCT flow_id FROM ids) i LEFT JOIN c USING (flow_id))
SELECT flow_id, a, b, c, d,
  CASE WHEN d = 0 THEN 'ES HAS NOTHING for this id -- genuine ingestion loss or wrong index'
       WHEN a = 0 AND b > 0 THEN 'APP FILTER IS THE CULPRIT -- logs exist but are filtered out'
       WHEN a = 0 AND c > 0 THEN 'QUERY SYNTAX IS THE CULPRIT -- quoted query_string does not match'
       WHEN b > a AND len(other) > 0 THEN 'APP FILTER DROPS EVIDENCE from: ' || array_to_string(other, ', ')
       WHEN d > a THEN 'WIDER QUERY FINDS MORE -- both filter and syntax contribute'
       ELSE 'QUERY IS FINE -- production query returns everything ES has' END AS verdict
FROM a""")
def recall_variants(spark, sf_dir):
    """Four query variants counted per id in one pass, with the verdict."""
    return FE.recall_variants(_ids(spark, sf_dir), v_log(spark, sf_dir), APPS, PHRASES)


@query("service_rollup", ov.with_views(ov.V_LOG, _TOK) + """
SELECT l.flow_id, v.app_name, count(*) AS docs FROM lhit l JOIN v_log v USING (line_id) GROUP BY ALL""")
def service_rollup(spark, sf_dir):
    """Which services logged each id (top 50 per id)."""
    return FE.service_rollup(_ids(spark, sf_dir), v_log(spark, sf_dir))
