"""Structured Streaming jobs built from the batch operators.

Default form: ``foreachBatch`` + the batch functions + table writes keyed by
batch id (exactly-once with the streaming checkpoint).  No state server and
no extra ports: group state is the stored case table, re-aggregated for the
fingerprints a batch touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.functions import redact as R
from logsift.operators import deadletter as D
from logsift.operators import groups as G
from logsift.operators.catalogs import read_catalog
from logsift.sources.sinks import append_batch, handoff, insert_if_absent, latest_by_key, read_table

#: Columns that may hold text from outside; redacted before they are stored.
FREE_TEXT = ("payload", "key", "stacktrace", "exception_message", "root_message", "outer_message", "signature", "declared_message")

KAFKA_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("headers", T.ArrayType(T.StructType([T.StructField("key", T.StringType()),
                                                       T.StructField("value", T.BinaryType())])))])


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """Dead-letter topic with headers (the production source)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
            .option("includeHeaders", "true").option("startingOffsets", starting).load())


def decode_deadletters(raw: DataFrame) -> DataFrame:
    """Kafka rows -> the dead-letter record shape (value stays text; an
    undecodable value is not poison)."""
    return raw.select(
        F.col("topic").alias("dlt_topic"), F.col("partition").alias("dlt_partition"),
        F.col("offset").alias("dlt_offset"), F.col("timestamp").alias("dlt_timestamp"),
        F.trim(D.utf8(F.col("key"))).alias("key"), D.headers_from_kafka(F.col("headers")).alias("headers"),
        D.utf8(F.col("value")).alias("payload"))


def evidence_batch(batch: DataFrame, reason_codes: DataFrame | None, now, type_paths=None, packages=None,
                   boilerplate=None, terminal: DataFrame | None = None) -> DataFrame:
    """One micro-batch of dead-letter records -> evidence rows (the STR-01
    batch definition): typed headers, case id, failure, ids, window, gaps.
    Cases in ``terminal`` (finished or stored before) are dropped, and of
    several deliveries within the batch the first stays."""
    recs = D.parse_deadletters(batch).where(F.col("case_id").isNotNull())
    first = [c for c in ("dlt_partition", "dlt_offset") if c in recs.columns] or ["case_id"]
    recs = (recs.groupBy("case_id").agg(F.min_by(F.struct(*[c for c in recs.columns if c != "case_id"]), F.struct(*first)).alias("_r"))
            .select("case_id", "_r.*"))
    if terminal is not None:
        recs = recs.join(terminal.select("case_id").distinct(), "case_id", "left_anti")
    kw = {}
    if packages is not None:
        kw["packages"] = packages
    if boilerplate is not None:
        kw["boilerplate"] = boilerplate
    f = D.build_failures(recs, reason_codes, **kw)
    f = D.resolve_ref_ids(f, type_paths=type_paths)
    w = D.log_window(f, now)
    return w.withColumn("evidence_gaps", D.evidence_gaps(F.col("ref_id_mismatch"), F.col("ref_id"),
                                                         F.col("last_attempt_ms"), F.col("too_old")))


def keyless_rejects(batch: DataFrame) -> DataFrame:
    """Records without a usable case id, redacted, with the reason."""
    recs = D.parse_deadletters(batch).where(F.col("case_id").isNull())
    return redact_evidence(recs.drop("headers")).withColumn("reject_reason", F.lit("no case id: topic, partition or offset is missing"))


def redact_evidence(df: DataFrame, allow: Sequence[str] = ("case_id", "ref_id")) -> DataFrame:
    """Every free-text column redacted before anything is stored; the
    identifiers in ``allow`` survive."""
    kept = [F.col(c) for c in allow if c in df.columns]
    text = [f.name for f in df.schema.fields if f.name in FREE_TEXT and isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: R.redact(F.col(c), kept)[0] for c in text})


def start_deadletter_ingest(stream: DataFrame, out_dir: str, checkpoint: str, reason_codes_path: str | None = None,
                            now_fn=None, type_paths=None, packages=None, boilerplate=None, trigger_once: bool = True):
    """Dead-letter ingest: every micro-batch re-reads the reference catalog
    (new versions are picked up), suppresses cases already terminal, writes
    the evidence table and the hand-off records."""
    spark = stream.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        codes = read_catalog(spark, reason_codes_path) if reason_codes_path else None
        known = read_table(spark, f"{out_dir}/terminal")
        stored = read_table(spark, f"{out_dir}/evidence")
        if stored is not None:      # a replay of this batch replaces its own rows
            stored = stored.where(F.col("batch_id") != batch_id).select("case_id")
            known = stored if known is None else known.select("case_id").unionByName(stored)
        now = F.lit(now_fn()) if now_fn else F.current_timestamp()
        append_batch(keyless_rejects(batch), f"{out_dir}/rejects", batch_id)
        ev = evidence_batch(batch, codes, now, type_paths, packages, boilerplate, known)
        ev = redact_evidence(ev.drop("headers", "chain")).persist()
        append_batch(ev, f"{out_dir}/evidence", batch_id)
        append_batch(handoff(ev.select("case_id", "ref_id", "fingerprint", "failure_class", "evidence_gaps",
                                       "window_start", "window_end")), f"{out_dir}/handoff", batch_id)
        ev.unpersist()

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()


def update_groups(spark: SparkSession, cases_dir: str, groups_dir: str, batch_cases: DataFrame, batch_id: int) -> None:
    """Group state upsert: append the batch's cases, then re-aggregate only
    the fingerprints the batch touched (exact: counts distinct cases, so a
    redelivered case is not counted twice)."""
    append_batch(batch_cases, cases_dir, batch_id)
    touched = batch_cases.select("fingerprint").distinct()
    allc = spark.read.parquet(cases_dir).drop("batch_id").join(touched, "fingerprint", "left_semi")
    allc = allc.dropDuplicates(["case_id"])
    append_batch(G.group_rollup(allc, seq="seq"), groups_dir, batch_id)


def current_groups(spark: SparkSession, groups_dir: str) -> DataFrame:
    """Latest roll-up per fingerprint across batches."""
    return latest_by_key(spark.read.parquet(groups_dir), ["fingerprint"], "batch_id").drop("batch_id")


def capture_snapshots(spark: SparkSession, snap_dir: str, fetched: DataFrame, batch_id: int,
                      key: str = "flow_id") -> DataFrame:
    """Capture-once: the first successful capture per id is kept; later
    fetches for a captured id are served from the snapshot."""
    existing = read_table(spark, snap_dir)
    new = insert_if_absent(fetched, existing.drop("batch_id") if existing is not None else None, [key])
    append_batch(new, snap_dir, batch_id)
    return spark.read.parquet(snap_dir).drop("batch_id").join(fetched.select(key).distinct(), key, "left_semi")


def start_rejection_ingest(stream: DataFrame, out_dir: str, checkpoint: str, trigger_once: bool = True):
    """Rejection ingest: valid, eligible messages go to the hand-off table,
    poison to the dead-letter envelope table, both from one micro-batch; a
    case already terminal (or seen earlier) is skipped, so redelivery is
    idempotent."""
    from logsift.operators import intake as I
    from logsift.sources.sinks import dlq_envelope
    spark = stream.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        good, poison = I.parse_rejections(batch)
        terminal = read_table(spark, f"{out_dir}/terminal")
        seen = read_table(spark, f"{out_dir}/handoff_ids")
        known = terminal.select("event_id") if terminal is not None else None
        if seen is not None:
            s = seen.where(F.col("batch_id") != batch_id).select("event_id")      # a replay is not its own redelivery
            known = s if known is None else known.unionByName(s)
        term = known if known is not None else spark.createDataFrame([], "event_id string")
        e = I.eligibility(good.dropDuplicates(["eventId"]), term)
        ok = e.where(F.col("skip_reason").isNull())
        append_batch(handoff(I.narrow_payload(ok)), f"{out_dir}/handoff", batch_id)
        append_batch(ok.select(F.col("eventId").alias("event_id")), f"{out_dir}/handoff_ids", batch_id)
        append_batch(dlq_envelope(poison), f"{out_dir}/dlq", batch_id)
        append_batch(e.where(F.col("skip_reason").isNotNull()).select("eventId", "skip_reason"),
                     f"{out_dir}/skipped", batch_id)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()


def update_decisions(spark: SparkSession, cases_dir: str, out_dir: str, batch_cases: DataFrame, lines: DataFrame,
                     agent: DataFrame | None, batch_id: int) -> None:
    """Stateful reuse decisions per micro-batch: the stored cases of every
    fingerprint the batch touches are re-analysed together, so the running
    "recommendation exists" state is exact whatever the batch boundaries."""
    from logsift.operators.analysis import analyse_cases
    append_batch(batch_cases, cases_dir, batch_id)
    touched = batch_cases.select("fingerprint").distinct()
    allc = spark.read.parquet(cases_dir).drop("batch_id").join(touched, "fingerprint", "left_semi")
    out = analyse_cases(allc, lines, agent)
    append_batch(out.drop("chain", "headers"), out_dir, batch_id)
