"""Registered queries: pod selection and pod-log retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.operators import pods as PO
from logsift.plans import oracle_views as ov
from logsift.plans.registry import query
from logsift.plans.views import v_log, v_pod, v_service

CAP = PO.MAX_PODS_PER_SERVICE


def _targets(spark, sf_dir, cap=None):
    pods = PO.eligible_containers(PO.pod_inventory(v_pod(spark, sf_dir)))
    matched = PO.match_services(v_service(spark, sf_dir), pods)
    kept, gaps = PO.cap_per_service(matched, cap)
    return PO.merge_round_robin(kept), gaps


@query("pod_targets", ov.with_views(ov.V_POD) + f"""
, kept AS (SELECT * FROM pr),
first AS (SELECT namespace, pod, arg_min(ord, rank * 100000 + ord) AS ford, min(rank * 100000 + ord) AS f FROM kept GROUP BY ALL),
mp AS (SELECT namespace, pod, ford, row_number() OVER (ORDER BY f, pod) AS merge_pos FROM first)
SELECT m.service, m.namespace, m.pod, m.container, CASE WHEN m.container = 'app' THEN m.app_restarts ELSE 0 END AS restart_count,
       k.rank, mp.merge_pos
FROM pm m JOIN kept k ON k.service = m.service AND k.pod = m.pod
JOIN mp ON mp.namespace = m.namespace AND mp.pod = m.pod AND mp.ford = m.ord""")
def pod_targets(spark, sf_dir):
    """(pod, container) targets: Pending and sidecars dropped, services matched
    by name or labels, all pods of a service ranked newest first, round-robin
    merged."""
    t, _ = _targets(spark, sf_dir)
    return t.select("service", "namespace", "pod", "container", "restart_count", F.col("rank").cast("bigint").alias("rank"),
                    F.col("merge_pos").cast("bigint").alias("merge_pos"))


@query("pod_truncation_gaps", ov.with_views(ov.V_POD) + f"""
SELECT 'TRUNCATED' AS gap_type,
       'service ' || service || ' matched ' || CAST(n AS VARCHAR) || ' pods; only the {CAP} most recently started were read (K8S_MAX_PODS).' AS detail,
       service FROM pr WHERE rank = 1 AND n > {CAP}""")
def pod_truncation_gaps(spark, sf_dir):
    """TRUNCATED gap, with the number of pods, for every service that matches
    more than the cap of 20."""
    return _targets(spark, sf_dir, CAP)[1]


def _pod_lines(spark, sf_dir):
    lg = v_log(spark, sf_dir).withColumns({"file": F.col("pod_name"), "chunk": (F.col("line_id") / 1000).cast("bigint"),
                                            "pos": F.struct("ts", "line_id")})
    return PO.number_lines(lg, "file", "chunk", "pos")


@query("pod_match_context", ov.with_views(ov.V_LOG) + """
, nl AS (SELECT *, pod_name AS file, row_number() OVER (PARTITION BY pod_name ORDER BY CAST(line_id / 1000 AS BIGINT), ts, line_id) AS line_no
         FROM v_log),
ids AS (SELECT DISTINCT flow_id, ref_id AS identifier FROM v_log),
m AS (SELECT DISTINCT i.flow_id, nl.file, nl.line_no FROM nl JOIN ids i ON contains(nl.message, i.identifier)),
p AS (SELECT DISTINCT flow_id, file, unnest(range(line_no - 5, line_no + 21)) AS line_no FROM m)
SELECT p.flow_id, nl.file, nl.line_no, nl.line_id, nl.message FROM p JOIN nl USING (file, line_no)""")
def pod_match_context(spark, sf_dir):
    """Per flow: lines of each pod log within 5 before / 20 after any line
    containing one of the flow's identifiers (range expansion)."""
    lines = _pod_lines(spark, sf_dir)
    ids = v_log(spark, sf_dir).select("flow_id", F.col("ref_id").alias("identifier")).distinct()
    m = PO.match_ids(lines, ids, line="message", key=("file", "line_no"))
    ctx = PO.match_context(lines, m.join(lines.select("file", "line_no"), ["file", "line_no"]))
    return ctx.select("flow_id", "file", "line_no", "line_id", "message")


@query("pod_read_report", ov.with_views(ov.V_LOG) + """
, ids AS (SELECT DISTINCT ref_id FROM v_log),
hit AS (SELECT DISTINCT line_id FROM v_log JOIN ids ON contains(message, ids.ref_id))
SELECT pod_name AS pod, app_name AS container, count(*) AS lines,
       count(*) FILTER (WHERE hit.line_id IS NOT NULL) AS matched_lines,
       CAST(sum(strlen(message) + 1) AS BIGINT) AS bytes
FROM v_log LEFT JOIN hit USING (line_id) GROUP BY ALL""")
def pod_read_report(spark, sf_dir):
    """Per (pod, container): lines read, lines naming any identifier, bytes.
    Containment is that of ``match_ids``."""
    lg = v_log(spark, sf_dir)
    ids = lg.select(F.lit("any").alias("flow_id"), F.col("ref_id").alias("identifier")).distinct()
    hit = PO.match_ids(lg, ids, line="message", key=("line_id",)).select("line_id").distinct() \
        .withColumn("_m", F.lit(True))
    j = lg.join(hit, "line_id", "left")
    return j.groupBy(F.col("pod_name").alias("pod"), F.col("app_name").alias("container")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.coalesce(F.col("_m"), F.lit(False))).alias("matched_lines"),
        F.sum(F.octet_length("message") + 1).cast("bigint").alias("bytes"))


REQUESTED_START = "2024-01-03 00:00:00"


@query("pod_replaced_gaps", ov.with_views(ov.V_POD) + f"""
, t AS (SELECT DISTINCT pod, CAST(st AS TIMESTAMP) AS st FROM pcont),
s AS (SELECT pod, min(st) AS st FROM t WHERE st > TIMESTAMP '{REQUESTED_START}' GROUP BY pod)
SELECT 'POD_REPLACED' AS gap_type,
       'pod ' || pod || ' started ' || strftime(st, '%Y-%m-%dT%H:%M:%S+00:00') || ', after the requested window began at '
       || strftime(TIMESTAMP '{REQUESTED_START}', '%Y-%m-%dT%H:%M:%S+00:00')
       || '. An earlier pod served part of this window; its logs are gone.' AS detail, pod
FROM s""")
def pod_replaced_gaps(spark, sf_dir):
    """POD_REPLACED: one gap per eligible pod that started after the window
    began (an earlier pod's logs are gone)."""
    pods = PO.eligible_containers(PO.pod_inventory(v_pod(spark, sf_dir)))
    return PO.pod_replaced_gaps(pods, F.lit(REQUESTED_START).cast("timestamp"))
