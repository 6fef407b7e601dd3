"""Registered queries: raw line parsing, parse quality, dump normalising."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.operators import lines as L
from logsift.plans import oracle_views as ov
from logsift.plans.registry import query
from logsift.plans.views import v_dump_line, v_raw_line

PARSED_COLS = ["namespace", "pod", "instance", "line_id", "timestamp", "level", "message", "app_name",
               "level_parsed", "was_json"]


def parsed_lines(spark, sf_dir):
    return L.parse_log_lines(v_raw_line(spark, sf_dir))


@query("parse_pod_lines", ov.with_views(ov.V_RAW_LINE, ov.V_PARSED) +
       " SELECT " + ", ".join(PARSED_COLS) + " FROM v_parsed")
def parse_pod_lines(spark, sf_dir):
    """Kubelet split + JSON/plain parse + level normalise/scan, blank lines dropped."""
    return parsed_lines(spark, sf_dir).select(*PARSED_COLS)


@query("parse_quality", ov.with_views(ov.V_RAW_LINE, ov.V_PARSED) + """
SELECT namespace, pod, count(*) AS total, count(*) FILTER (WHERE level_parsed) AS level_parsed,
       count(*) FILTER (WHERE was_json) AS json_lines,
       round(1.0 - (count(*) FILTER (WHERE level_parsed))::DOUBLE / count(*), 9) AS level_failure_rate,
       round((count(*) FILTER (WHERE was_json))::DOUBLE / count(*), 9) AS json_ratio
FROM v_parsed GROUP BY namespace, pod""")
def parse_quality(spark, sf_dir):
    """Per-pod parse counters and rates (additive counters)."""
    q = L.parse_quality(parsed_lines(spark, sf_dir), ["namespace", "pod"])
    return q.withColumns({"level_failure_rate": F.round("level_failure_rate", 9),
                          "json_ratio": F.round("json_ratio", 9)})


DUMP_COLS = ["file", "chunk", "line_no", "format", "timestamp", "pod", "app", "body", "out_line"]


def normalised_dump(spark, sf_dir):
    return L.normalise_dump(v_dump_line(spark, sf_dir))


@query("dump_normalise", ov.with_views(ov.V_DUMP_LINE, ov.V_DUMP) + " SELECT * FROM v_dump")
def dump_normalise(spark, sf_dir):
    """Mixed-format dump -> dated, pod/app-attributed lines (carry-forward)."""
    return normalised_dump(spark, sf_dir).select(*DUMP_COLS)


@query("dump_profile", ov.with_views(ov.V_DUMP_LINE, ov.V_DUMP) + """
SELECT pod, app, format, count(*) AS lines, CAST(sum(strlen(out_line) + 1) AS BIGINT) AS bytes,
       min(timestamp) AS oldest, max(timestamp) AS newest
FROM v_dump GROUP BY pod, app, format""")
def dump_profile(spark, sf_dir):
    """Per pod/app/format line and byte counts with the time span."""
    from logsift.operators.reports import dump_profile as prof
    return prof(normalised_dump(spark, sf_dir))


SHARD_BYTES = 2048


@query("dump_shards", ov.with_views(ov.V_DUMP_LINE, ov.V_DUMP) + f"""
, n AS (
  SELECT *, row_number() OVER (PARTITION BY file, pod ORDER BY chunk, line_no) - 1 AS idx,
         coalesce(sum(strlen(out_line) + 1) OVER (PARTITION BY file, pod ORDER BY chunk, line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_before
  FROM v_dump),
nx AS (SELECT a.file, a.pod, a.idx, min(b.idx) AS nxt FROM n a JOIN n b ON a.file = b.file AND a.pod = b.pod
       AND b.s_before >= a.s_before + {SHARD_BYTES} GROUP BY ALL),
bd AS (SELECT file, pod, idx FROM nx WHERE idx = 0 UNION SELECT DISTINCT file, pod, 0 FROM n),
rec AS (
  WITH RECURSIVE walk(file, pod, idx) AS (
    SELECT file, pod, idx FROM bd
    UNION ALL
    SELECT nx.file, nx.pod, nx.nxt FROM walk JOIN nx ON nx.file = walk.file AND nx.pod = walk.pod AND nx.idx = walk.idx
    WHERE nx.nxt IS NOT NULL)
  SELECT DISTINCT file, pod, idx FROM walk),
seg AS (
  SELECT n.*, (SELECT count(*) FROM rec r WHERE r.file = n.file AND r.pod = n.pod AND r.idx <= n.idx) - 1 AS shard FROM n)
SELECT file, line_no, pod, shard, CASE WHEN shard = 0 THEN pod ELSE pod || '-p' || CAST(shard AS VARCHAR) END AS shard_pod
FROM seg""")
def dump_shards(spark, sf_dir):
    """Byte-budget shards of each pod's normalised dump lines (a new shard
    once the current one holds >= 2048 bytes); shard names carry ``-pN``."""
    from logsift.operators.windows import greedy_segments
    d = normalised_dump(spark, sf_dir).withColumn("_bytes", F.octet_length("out_line") + 1)
    s = greedy_segments(d, "_bytes", ["file", "pod"], "chunk", "line_no", SHARD_BYTES, out="shard")
    return s.select("file", "line_no", "pod", "shard",
                    F.when(F.col("shard") == 0, F.col("pod"))
                    .otherwise(F.concat(F.col("pod"), F.lit("-p"), F.col("shard").cast("string"))).alias("shard_pod"))
