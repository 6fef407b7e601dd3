"""Registered queries: operational metrics, evaluation, retention, grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.operators import reports as RP
from logsift.operators.outcomes import TERMINAL_STATUSES
from logsift.plans import oracle_views as ov
from logsift.plans.registry import query
from logsift.plans.views import table, v_casebook, v_status_event

_TERM_SQL = "(" + ", ".join(f"'{s}'" for s in TERMINAL_STATUSES) + ")"
_BOUNDS = RP.DURATION_BUCKETS


def _durations(spark, sf_dir):
    ev = v_status_event(spark, sf_dir)
    agg = ev.groupBy("case_id").agg(
        F.min("status_at").alias("t0"), F.min(F.when(F.col("status").isin(*TERMINAL_STATUSES), F.col("status_at"))).alias("t1"),
        F.min_by(F.col("status"), F.when(F.col("status").isin(*TERMINAL_STATUSES), F.col("status_at"))).alias("first_terminal"))
    return agg.where(F.col("t1").isNotNull()).select(
        "case_id", "first_terminal", (F.unix_seconds(F.col("t1").cast("timestamp")) - F.unix_seconds(F.col("t0").cast("timestamp")))
        .cast("double").alias("seconds"))


_DUR_SQL = """
, dur AS (
  SELECT case_id, arg_min(status, status_at) FILTER (WHERE status IN {term}) AS first_terminal,
         CAST(epoch(min(status_at) FILTER (WHERE status IN {term})) - epoch(min(status_at)) AS DOUBLE) AS seconds
  FROM v_status_event GROUP BY case_id HAVING min(status_at) FILTER (WHERE status IN {term}) IS NOT NULL)"""


@query("duration_histogram", ov.with_views(__import__("logsift.plans.q_streaming", fromlist=["V_STATUS_EVENT"]).V_STATUS_EVENT)
       + _DUR_SQL.format(term=_TERM_SQL) + """
, agg AS (SELECT first_terminal, count(*) AS count, sum(seconds) AS sum, """
       + ", ".join(f"count(*) FILTER (WHERE seconds <= {b}) AS le_{i}" for i, b in enumerate(_BOUNDS)) +
       """ FROM dur GROUP BY first_terminal)
""" + " UNION ALL ".join(
    f"SELECT first_terminal, 'duration_seconds' AS metric, '{float(b)}' AS le, le_{i} AS bucket_count, count, sum FROM agg"
    for i, b in enumerate(_BOUNDS)) + " UNION ALL SELECT first_terminal, 'duration_seconds', '+Inf', count, count, sum FROM agg")
def duration_histogram(spark, sf_dir):
    """Time to first terminal status, cumulative buckets 1..600 s, per outcome."""
    return RP.histogram(_durations(spark, sf_dir), "seconds", ["first_terminal"])


@query("status_counters", ov.with_views(ov.V_CASEBOOK) +
       " SELECT status, resolution_source, count(*) AS value, 'cases_total' AS metric FROM v_casebook GROUP BY ALL")
def status_counters(spark, sf_dir):
    """Cases by status and resolution source (a labelled counter)."""
    return RP.counter(v_casebook(spark, sf_dir), ["status", "resolution_source"], "cases_total")


@query("eval_recall", """
WITH cases AS (
  SELECT l.doc_id AS refid,
         list_filter(string_split(regexp_replace(trim(d.text), '\\s+', ' ', 'g'), ' ')[1:3], lambda w: w <> '') ||
         CASE WHEN l.doc_id % 4 = 0 THEN ['zz-not-there'] ELSE [] END AS kw
  FROM labels l JOIN documents d USING (doc_id)),
outs AS (SELECT doc_id AS refid, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS output FROM documents)
SELECT refid, len(list_filter(kw, lambda k: contains(lower(coalesce(output, '')), lower(k)))) AS found, len(kw) AS expected,
       CASE WHEN len(kw) = 0 THEN 1.0 ELSE len(list_filter(kw, lambda k: contains(lower(coalesce(output, '')), lower(k)))) / len(kw) END AS recall,
       CASE WHEN (CASE WHEN len(kw) = 0 THEN 1.0 ELSE len(list_filter(kw, lambda k: contains(lower(coalesce(output, '')), lower(k)))) / len(kw) END) >= 0.8
            THEN 'PASS' ELSE 'FAIL' END AS result
FROM cases LEFT JOIN outs USING (refid)""")
def eval_recall(spark, sf_dir):
    """Evidence recall: expected keywords (from labelled documents) found in
    each case's output text (whole documents); PASS at 80 %."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.slice(F.split(F.regexp_replace(F.trim(F.col("text")), r"\s+", " "), " "), 1, 3), lambda w: w != "")
    kw = F.concat(words, F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("zz-not-there"))).otherwise(F.array().cast("array<string>")))
    cases = labels.join(docs, "doc_id").select(F.col("doc_id").alias("refid"), kw.alias("expected_evidence_keywords"))
    outs = docs.select(F.col("doc_id").alias("refid"),
                       F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text")).alias("output"))
    out = RP.keyword_recall(cases, outs)
    return out.withColumns({"found": F.col("found").cast("bigint"), "expected": F.col("expected").cast("bigint")})


RET_NOW = "1998-09-01 00:00:00"
RET_DAYS = 90


@query("retention_report", ov.with_views(ov.V_CASEBOOK) + f"""
, p AS (
  SELECT *, CASE WHEN status IS NULL OR status NOT IN {_TERM_SQL} THEN 'SKIPPED_ACTIVE'
                 WHEN updated_at <= TIMESTAMP '{RET_NOW}' - INTERVAL {RET_DAYS} DAY THEN 'ELIGIBLE' ELSE 'SKIPPED_RECENT' END AS retention,
         strlen(event_id) + strlen(reason_code) + 200 AS size_bytes
  FROM v_casebook)
SELECT count(*) FILTER (WHERE retention = 'ELIGIBLE') AS eligible, count(*) FILTER (WHERE retention = 'SKIPPED_RECENT') AS skipped_recent,
       count(*) FILTER (WHERE retention = 'SKIPPED_ACTIVE') AS skipped_active,
       CAST(coalesce(sum(size_bytes) FILTER (WHERE retention = 'ELIGIBLE'), 0) AS BIGINT) AS reclaimable_bytes
FROM p""")
def retention_report(spark, sf_dir):
    """Retention: terminal casebooks older than 90 days are eligible (outcomes
    are kept); counts and reclaimable bytes."""
    cb = v_casebook(spark, sf_dir).withColumn("size_bytes", F.length("event_id") + F.length("reason_code") + 200)
    plan = RP.retention_plan(cb, F.lit(RET_NOW).cast("timestamp_ntz"), RET_DAYS, TERMINAL_STATUSES)
    return RP.reclaimable(plan)
