"""What a deployment keeps per case, as keyed tables under one folder:
casebooks, statuses, log artefacts, snapshots and their meta rows, outcomes
and resumable checkpoints; lookup of one case, and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.sources.keyed import KeyedTable

# --- fixed values (must equal the behaviour being matched) -----------------
RAW, REDUCED, CAPTURED = "raw_logs.txt", "reduced_logs.txt", "raw_logs_k8s.jsonl"
LOG_ARTEFACTS = (RAW, REDUCED, CAPTURED)
# ---------------------------------------------------------------------------


def origin(app: Column, pod: Column) -> Column:
    """``app@pod``, or the app alone for lines without a pod."""
    return F.concat(F.coalesce(app, F.lit("")), F.when(pod.isNotNull() & (pod != ""), F.concat(F.lit("@"), pod)).otherwise(F.lit("")))


def raw_trace(lines: DataFrame, key: str, seq: str, ts: str = "timestamp") -> DataFrame:
    """Raw trace lines as stored: ``[time] [origin] [level] message``, one row
    a line."""
    pod = F.col("pod_name") if "pod_name" in lines.columns else F.lit(None).cast("string")
    text = F.concat(F.lit("["), F.coalesce(F.col(ts).cast("string"), F.lit("None")), F.lit("] ["), origin(F.col("app_name"), pod), F.lit("] ["),
                    F.coalesce(F.col("level"), F.lit("None")), F.lit("] "), F.coalesce(F.col("message"), F.lit("")))
    return lines.select(F.col(key).alias("case_id"), F.col(seq).cast("long").alias("seq"), text.alias("line"))


class CaseStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        table = lambda name, order=(): KeyedTable(spark, f"{path}/{name}", "case_id", order, buckets)
        self.casebooks, self.statuses, self.outcomes = table("casebooks"), table("statuses"), table("outcomes")
        self.checkpoints = table("checkpoints")
        self.artefacts = {name: table(name, ["seq"]) for name in LOG_ARTEFACTS}
        self.snapshots, self.snapshot_meta = self.artefacts[CAPTURED], table("raw_logs_k8s.meta")

    def save_terminal(self, books: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Upsert finished casebooks (case_id, status, updated_at, ...), then
        their status rows: a run that dies in between leaves an old status,
        never a terminal status without its casebook."""
        self.casebooks.upsert(books, batch)
        self.statuses.upsert(books.select("case_id", "status", "updated_at"), batch)

    def save_trace(self, name: str, lines: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Store the whole raw or reduced trace of every case in ``lines``
        (case_id, seq, line), in place of an earlier one."""
        self.artefacts[name].upsert(lines.select("case_id", F.col("seq").cast("long"), "line"), batch)

    def capture(self, records: DataFrame, gaps: DataFrame, captured_at: Column, source: str,
                batch: tuple[str, int] | None = None) -> None:
        """Capture-once snapshots: the records (case_id, seq, line) of cases
        not captured yet, then one meta row each with the capture time, the
        record count and the gaps (type, detail)."""
        count = records.groupBy("case_id").agg(F.count("*").alias("record_count"))
        listed = gaps.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("type", "detail"))).alias("gaps"))
        meta = (count.join(listed, "case_id", "full")
                .select("case_id", F.lit(source).alias("source"), captured_at.cast("timestamp").alias("captured_at"),
                        F.coalesce("record_count", F.lit(0)).alias("record_count"),
                        F.coalesce("gaps", F.array().cast("array<struct<type:string,detail:string>>")).alias("gaps")))
        self.snapshots.upsert(records.select("case_id", F.col("seq").cast("long"), "line"), batch, absent_only=True)
        self.snapshot_meta.upsert(meta, batch, absent_only=True)

    def case(self, case_id: str) -> DataFrame:
        """One case in full: its casebook columns, and its stored lines per
        artefact (a lookup opens one file a table).  No such case: no row."""
        out = self.casebooks.get(case_id)
        for name, table in self.artefacts.items():
            if table.manifest() is None:
                continue
            lines = table.get(case_id).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("_l"))
            out = (out.join(lines, "case_id", "left")
                   .withColumn(name.partition(".")[0], F.transform(F.coalesce("_l", F.array().cast("array<struct<seq:long,line:string>>")),
                                                                   lambda x: x["line"])).drop("_l"))
        return out

    def retention(self, now: Column, days: float, terminal: Sequence[str]) -> DataFrame:
        """Per casebook its retention state (see ``reports.retention_plan``)."""
        from logsift.operators.reports import retention_plan
        return retention_plan(self.casebooks.read(), now, days, terminal)

    def prune(self, now: Column, days: float, terminal: Sequence[str], logs_only: bool = False, dry_run: bool = False) -> DataFrame:
        """Retention: eligible cases lose their log artefacts, casebook and
        status; with ``logs_only`` the artefacts alone.  Outcomes always stay.
        Log tables go first: a run that dies in between leaves the casebook,
        so the next run finds the case again.  Returns the eligible ids."""
        plan = self.retention(now, days, terminal)
        gone = plan.where(F.col("retention") == "ELIGIBLE").select("case_id", "status")
        if dry_run:
            return gone
        gone = gone.checkpoint()                       # the tables that it was read from change below
        for table in [*self.artefacts.values(), self.snapshot_meta, *([] if logs_only else [self.statuses, self.casebooks])]:
            table.delete(gone)
        return gone

    def prune_checkpoints(self, dry_run: bool = False) -> DataFrame:
        """Drop the resumable checkpoints of cases that have a casebook."""
        stored, done = self.checkpoints.read(), self.casebooks.read()
        gone = stored.select("case_id").distinct()
        gone = gone.join(done.select("case_id"), "case_id", "left_semi") if done is not None else gone.limit(0)
        if dry_run:
            return gone
        gone = gone.checkpoint()
        self.checkpoints.delete(gone)
        return gone
