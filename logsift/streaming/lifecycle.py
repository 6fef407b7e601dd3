"""Case lifecycle as a fold over status events (batch definition; the
streaming jobs apply it per micro-batch against the stored events)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.outcomes import PROTECTED_TERMINAL_STATUSES, TERMINAL_STATUSES

# --- fixed values (must equal the behaviour being matched) -----------------
IN_PROGRESS = "IN_PROGRESS"
LOGS_FETCHED = "LOGS_FETCHED"
MAX_IN_PROGRESS_AGE_SECONDS = 1800
FAILED_TIMEOUT = "FAILED_TIMEOUT"
FAILED_SHUTDOWN = "FAILED_SHUTDOWN"
# ---------------------------------------------------------------------------


def fold_status(events: DataFrame, key: str = "case_id", ts: str = "status_at", status: str = "status") -> DataFrame:
    """Current status per case from (case, at, status) events:
    a protected terminal status (timeout / DLQ) recorded first wins over any
    later success; otherwise the latest terminal status; otherwise the latest
    non-terminal status, where LOGS_FETCHED never overwrites a later state.
    All partial aggregates (min_by / max_by), so one hot case is cheap."""
    s, t = F.col(status), F.col(ts)
    prot = s.isin(*PROTECTED_TERMINAL_STATUSES)
    term = s.isin(*TERMINAL_STATUSES)
    agg = events.groupBy(key).agg(
        F.min_by(F.when(prot, s), F.when(prot, t)).alias("_prot"),
        F.max_by(F.when(term, s), F.when(term, t)).alias("_term"),
        F.max_by(F.when(~term & (s != LOGS_FETCHED), s), F.when(~term & (s != LOGS_FETCHED), t)).alias("_live"),
        F.max(F.when(s == LOGS_FETCHED, t)).alias("_fetched_at"),
        F.max(F.when(~term & (s != LOGS_FETCHED), t)).alias("_live_at"),
        F.max(t).alias("updated_at"))
    # LOGS_FETCHED is only written over nothing (or itself), so any other
    # live state wins whatever its time.
    live = F.coalesce(F.col("_live"), F.when(F.col("_fetched_at").isNotNull(), F.lit(LOGS_FETCHED)))
    return agg.select(key, F.coalesce(F.col("_prot"), F.col("_term"), live).alias("status"),
                      F.col("_live_at").alias("started_at"), "updated_at")


def sweep_stale(current: DataFrame, now: Column, max_age: int = MAX_IN_PROGRESS_AGE_SECONDS,
                shutting_down: bool = False) -> DataFrame:
    """Cases stuck IN_PROGRESS beyond the deadline become FAILED_TIMEOUT
    (FAILED_SHUTDOWN when the service is draining): new terminal events.  The
    age counts from the start of the run, so events that change nothing (a
    late LOGS_FETCHED) do not renew it."""
    stale = (F.col("status") == IN_PROGRESS) & (
        F.lit(shutting_down) | (F.unix_seconds(now) - F.unix_seconds(F.col("started_at").cast("timestamp")) > max_age))
    return current.where(stale).select(
        "case_id", now.alias("status_at"), F.lit(FAILED_SHUTDOWN if shutting_down else FAILED_TIMEOUT).alias("status"))
