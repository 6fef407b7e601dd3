"""Registered queries: the case store built from the casebooks of all orders,
then upserted, looked up and pruned."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.operators.outcomes import TERMINAL_STATUSES
from logsift.plans import oracle_views as ov
from logsift.plans.q_reports import _TERM_SQL, RET_DAYS, RET_NOW
from logsift.plans.registry import query
from logsift.plans.views import table, v_casebook
from logsift.session import scratch_path
from logsift.sources.casestore import RAW, CaseStore, raw_trace

LOOKED_UP = "EV7"


def _books(spark, sf_dir):
    """Casebooks of all orders, and the later ones of the cases that were
    still in progress."""
    first = v_casebook(spark, sf_dir).select(F.col("event_id").alias("case_id"), "status", F.col("updated_at").cast("timestamp").alias("updated_at"),
                                             "reason_code", "agent_action", "confidence")
    later = first.where(F.col("status") == "IN_PROGRESS").withColumns({
        "status": F.when(F.col("confidence") < 0.5, "NEEDS_MANUAL_REVIEW").otherwise("COMPLETED"),
        "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAYS")})
    return first, later


def _trace(books):
    """Two trace lines a case."""
    line = lambda seq, level, text: F.struct(F.lit(seq).alias("seq"), F.lit(level).alias("level"), text.alias("message"))
    lines = books.select("case_id", F.col("updated_at").cast("date").cast("string").alias("timestamp"),
                         F.explode(F.array(line(0, "INFO", F.col("status")), line(1, "ERROR", F.col("reason_code")))).alias("l"))
    return raw_trace(lines.select("case_id", "timestamp", F.lit("packet-svc").alias("app_name"), "l.*"), "case_id", "seq")


def _store(spark, sf_dir):
    store = CaseStore(spark, scratch_path(spark, "case-store"), buckets=16)
    first, later = _books(spark, sf_dir)
    store.save_terminal(first, ("books", 0))
    store.save_trace(RAW, _trace(first))
    store.save_terminal(later, ("books", 1))
    store.save_terminal(first, ("books", 0))          # a replay of an applied batch changes nothing
    return store


_STORE_SQL = ov.with_views(ov.V_CASEBOOK) + """
, first AS (SELECT event_id AS case_id, status, CAST(updated_at AS TIMESTAMP) AS updated_at, reason_code, agent_action, confidence FROM v_casebook),
books AS (
  SELECT case_id, CASE WHEN status <> 'IN_PROGRESS' THEN status WHEN confidence < 0.5 THEN 'NEEDS_MANUAL_REVIEW' ELSE 'COMPLETED' END AS status,
         CASE WHEN status = 'IN_PROGRESS' THEN updated_at + INTERVAL 1 DAY ELSE updated_at END AS updated_at,
         reason_code, agent_action, confidence FROM first),
trace AS (
  SELECT case_id, CAST(CAST(updated_at AS DATE) AS VARCHAR) AS ts, status, reason_code FROM first)"""


@query("casebook_upserts", _STORE_SQL + """
SELECT case_id, status, updated_at, reason_code, agent_action, confidence FROM books""")
def casebook_upserts(spark, sf_dir):
    """The casebook table after a first batch, a second one that finishes the
    open cases, and a replay of the first."""
    return _store(spark, sf_dir).casebooks.read()


@query("case_lookup", _STORE_SQL + f"""
SELECT case_id, b.status, updated_at, b.reason_code, agent_action, confidence,
       concat_ws(chr(10), '[' || ts || '] [packet-svc] [INFO] ' || t.status, '[' || ts || '] [packet-svc] [ERROR] ' || t.reason_code) AS raw_logs
FROM books b JOIN trace t USING (case_id) WHERE case_id = '{LOOKED_UP}'""")
def case_lookup(spark, sf_dir):
    """One case in full by its id: the casebook and its raw trace."""
    one = _store(spark, sf_dir).case(LOOKED_UP)
    return one.withColumn("raw_logs", F.array_join("raw_logs", "\n"))


_PRUNED_SQL = _STORE_SQL + f"""
, plan AS (SELECT *, status IN {_TERM_SQL} AND updated_at <= TIMESTAMP '{RET_NOW}' - INTERVAL {RET_DAYS} DAY AS gone FROM books)"""


@query("retention_kept", _PRUNED_SQL + """
SELECT 'casebooks' AS kept_in, case_id, status, 1::BIGINT AS n FROM plan WHERE NOT gone
UNION ALL SELECT 'statuses', case_id, status, 1 FROM plan WHERE NOT gone
UNION ALL SELECT 'raw_logs', case_id, NULL, 2 FROM plan WHERE NOT gone
UNION ALL SELECT 'outcomes', case_id, 'CORRECT', 1 FROM plan WHERE confidence >= 0.9""")
def retention_kept(spark, sf_dir):
    """What every table of the store holds after retention: outcomes stay."""
    store = _store(spark, sf_dir)
    store.outcomes.upsert(store.casebooks.read().where("confidence >= 0.9").select("case_id", F.lit("CORRECT").alias("verdict")))
    store.prune(F.lit(RET_NOW).cast("timestamp"), RET_DAYS, TERMINAL_STATUSES)
    count = lambda name, df, status: df.groupBy("case_id").agg(F.max(status).alias("status"), F.count("*").alias("n")).select(
        F.lit(name).alias("kept_in"), "case_id", "status", "n")
    return (count("casebooks", store.casebooks.read(), F.col("status"))
            .unionAll(count("statuses", store.statuses.read(), F.col("status")))
            .unionAll(count("raw_logs", store.artefacts[RAW].read(), F.lit(None).cast("string")))
            .unionAll(count("outcomes", store.outcomes.read(), F.col("verdict"))))


@query("retention_logs_only", _PRUNED_SQL + """
SELECT case_id, status, NOT gone AS logs_kept FROM plan""")
def retention_logs_only(spark, sf_dir):
    """Log-only retention: every casebook stays, old finished cases lose
    their logs."""
    store = _store(spark, sf_dir)
    store.prune(F.lit(RET_NOW).cast("timestamp"), RET_DAYS, TERMINAL_STATUSES, logs_only=True)
    logs = store.artefacts[RAW].read().select("case_id").distinct().withColumn("l", F.lit(True))
    return store.casebooks.read().join(logs, "case_id", "left").select("case_id", "status", F.coalesce("l", F.lit(False)).alias("logs_kept"))


@query("checkpoints_kept", """
SELECT 'EV' || CAST(c_custkey * 37 AS VARCHAR) AS case_id FROM customer WHERE c_custkey * 37 NOT IN (SELECT o_orderkey FROM orders)""")
def checkpoints_kept(spark, sf_dir):
    """Resumable checkpoints left after those of cases with a casebook went."""
    store = _store(spark, sf_dir)
    store.checkpoints.upsert(table(spark, sf_dir, "customer").select(
        F.concat(F.lit("EV"), (F.col("c_custkey") * 37).cast("string")).alias("case_id")).distinct())
    store.prune_checkpoints()
    return store.checkpoints.read()
