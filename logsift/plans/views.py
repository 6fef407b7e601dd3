"""Deterministic views over the driver's test tables.

The parquet test tables carry no log lines, stack traces or casebooks, so
these views derive them with plain column expressions (the same expressions
are restated in SQL in ``oracle_views`` for the DuckDB check).  None of this
logic belongs to the operators; it only shapes inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RFC3339_US = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from logsift.session import ensure_parallelism
    return ensure_parallelism(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _cents(c):
    return F.round(c * 100).cast("bigint").cast("string")


def v_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index-style log records: one flow per user, one line per event."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    ref_id = F.concat(F.lit("1"), F.lpad(F.col("user_id").cast("string"), 11, "0"))
    # the identifier stands alone, before a full stop, between colons, after
    # a hyphen, and inside a longer run
    turn = F.floor(eid / 10) % 5
    named = (F.when(turn == 0, F.concat(F.lit(" refId="), ref_id))
             .when(turn == 1, F.concat(F.lit(" failed for "), ref_id, F.lit(".")))
             .when(turn == 2, F.concat(F.lit(" id:"), ref_id, F.lit(":failed")))
             .when(turn == 3, F.concat(F.lit(" svc-"), ref_id, F.lit(" x")))
             .otherwise(F.concat(F.lit(" run9"), ref_id, F.lit("7"))))
    suffix = (F.when(eid % 10 == 0, named)
              .when(eid % 10 == 1, F.concat(F.lit(" mobile 9"), F.lpad((eid % 1000000000).cast("string"), 9, "0")))
              .when(eid % 10 == 2, F.concat(F.lit(" vid "), F.lpad(eid.cast("string"), 16, "4")))
              .when(eid % 10 == 3, F.concat(F.lit(" aadhaar 2345 6789 "), F.lpad((eid % 10000).cast("string"), 4, "0")))
              .when(eid % 10 == 4, F.concat(F.lit(" contact user"), F.col("user_id").cast("string"), F.lit("@example.org")))
              .when(eid % 10 == 5, F.lit(" decision: packet status REJECTED"))
              .otherwise(F.lit("")))
    level_raw = (F.when(F.col("event_type") == "error", "error")
                 .when(F.col("event_type") == "signup", "warning")
                 .when(F.col("event_type") == "click", "debug")
                 .when(F.col("event_type") == "purchase", "INFO")
                 .otherwise("info"))
    return ev.select(
        F.concat(F.lit("flow-"), F.col("user_id").cast("string")).alias("flow_id"),
        eid.alias("line_id"),
        F.col("ts"),
        F.date_format("ts", RFC3339_US).alias("timestamp"),
        level_raw.alias("level_raw"),
        F.concat(F.lit("svc-"), (eid % 3).cast("string")).alias("app_name"),
        F.concat(F.lit("pod-"), (eid % 5).cast("string")).alias("pod_name"),
        ref_id.alias("ref_id"),
        F.concat(F.col("event_type"), F.lit(" value="), _cents(F.col("value")),
                 F.lit(" k="), F.get_json_object("props", "$.k"), suffix).alias("message"),
    )


def v_flow_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_log`` in flows that take every reduction route: 16 users of each 24
    share one long flow whose errors fall in the middle of the month, so both
    context bounds cut; four users' flows are halved and short; four users'
    flows are quiet, without errors."""
    log = v_log(spark, sf_dir)
    user = F.substring("ref_id", 2, 11).cast("bigint")
    turn = user % 12
    flow = (F.when(turn < 8, F.concat(F.lit("flow-long-"), F.floor(user / 24).cast("string")))
            .when(turn < 10, F.concat("flow_id", F.lit("-"), (F.col("line_id") % 2).cast("string"))).otherwise(F.col("flow_id")))
    quiet = (turn >= 10) | ((turn < 8) & ~F.dayofmonth("ts").between(12, 18))
    level = F.when((F.col("level_raw") == "error") & quiet, F.lit("warning")).otherwise(F.col("level_raw"))
    return log.withColumns({"flow_id": flow, "level_raw": level})


def _level_word(et):
    return (F.when(et == "error", "ERROR").when(et == "signup", "WARNING").when(et == "click", "debug")
            .when(et == "purchase", "Info").otherwise("info"))


def v_raw_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pod-log lines: kubelet prefix + JSON / plain / level-less text."""
    ev = table(spark, sf_dir, "events")
    eid, et = F.col("event_id"), F.col("event_type")
    tsu = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kts = F.concat(tsu, F.lit("123Z"))
    msg = F.concat(et, F.lit(" value="), _cents(F.col("value")), F.lit(" user="), F.col("user_id").cast("string"))
    app = F.concat(F.lit("svc-"), (eid % 3).cast("string"))
    lvl = _level_word(et)
    m4 = eid % 4
    body = (F.when(m4 == 0, F.concat(F.lit('{"@timestamp":"'), tsu, F.lit('Z","level":"'), lvl,
                                     F.lit('","message":"'), msg, F.lit('","application_name":"'), app, F.lit('"}')))
            .when(m4 == 1, F.concat(F.upper(lvl), F.lit(" [main] "), msg))
            .when(m4 == 2, F.concat(F.lit("processed "), msg))
            .otherwise(F.concat(F.lit('{"severity":"'), lvl, F.lit('","msg":"'), msg, F.lit('","service":"'), app,
                                F.lit('","ts":"'), tsu, F.lit('Z"}'))))
    m50 = eid % 50
    line = (F.when(m50 == 7, F.lit(""))
            .when(m50 == 11, F.concat(kts, F.lit(" [1,2]")))
            .when(m50 == 13, F.concat(kts, F.lit(' {"level": "ERROR", broken ')))
            .when(m4 == 3, body)
            .otherwise(F.concat(kts, F.lit(" "), body)))
    return ev.select(
        F.concat(F.lit("ns-"), (F.col("user_id") % 3).cast("string")).alias("namespace"),
        F.concat(F.lit("pod-"), (F.col("user_id") % 10).cast("string")).alias("pod"),
        F.when(eid % 9 == 0, "previous").otherwise("current").alias("instance"),
        eid.alias("line_id"), F.col("ts"), line.alias("line"))


def v_dump_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed-format dump: one file per 5 users, lines in event order."""
    ev = table(spark, sf_dir, "events")
    eid, et = F.col("event_id"), F.col("event_type")
    tsu = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    msg = F.concat(et, F.lit(" value="), _cents(F.col("value")))
    host = F.concat(F.lit("Host-"), (F.col("user_id") % 4).cast("string"), F.lit(".Pod"))
    app = F.concat(F.lit("App_"), (eid % 3).cast("string"))
    m6 = eid % 6
    line = (F.when(m6 == 0, F.concat(F.lit('{"@timestamp":"'), tsu, F.lit('+00:00","message":"'), msg,
                                     F.lit('","application_name":"'), app, F.lit('","HOSTNAME":"'), host, F.lit('"}')))
            .when(m6 == 1, F.concat(F.lit('"Jan 1, 2024 @ 00:00:00.000","{""timestamp"":""'),
                                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"",""msg"":""'), msg,
                                    F.lit('"",""app"":""'), app, F.lit('""}"')))
            .when(m6 == 2, F.concat(tsu, F.lit("Z "), msg))
            .when(m6 == 3, F.concat(F.lit("["), tsu, F.lit("+05:30], "), msg))
            .when(m6 == 4, F.concat(F.lit("  select x from t where id="), eid.cast("string")))
            .otherwise(F.lit("   ")))
    return ev.select(
        F.concat(F.lit("dump-"), (F.col("user_id") % 5).cast("string"), F.lit(".log")).alias("file"),
        (eid / 1000).cast("bigint").alias("chunk"),
        eid.alias("line_no"), line.alias("line"))


def v_deadletter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead-lettered records: header map, key, payload text, one per event."""
    from logsift.plans.dlt_fixture import TRACES, TYPE_A, TYPE_B
    ev = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    m8 = eid % 8
    trace = F.element_at(F.array(*[F.lit(t) for t in TRACES]), (m8 + 1).cast("int"))
    trace = F.replace(trace, F.lit("{n}"), (eid % 97 + 1).cast("string"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    orig_ms = ms - F.lit(43 * 3600 * 1000)
    ref = F.substring(F.md5(F.concat(F.lit("ref"), uid.cast("string"))), 1, 24)
    other = F.substring(F.md5(F.concat(F.lit("other"), eid.cast("string"))), 1, 24)
    pay_ref = F.when(eid % 11 == 0, other).otherwise(ref)
    topic = F.when(eid % 97 == 0, F.concat(F.lit("enrolment/"), F.repeat(F.lit("very-long-topic-"), 10)))\
        .otherwise(F.lit("enrolment.requests"))
    msg = (F.when(m8 == 6, F.lit("[SCORE_THRESHOLD_BREACH] score below threshold"))
           .when(m8 == 5, F.lit("Listener failed; nested [PACKET_STATUS_INVALID]"))
           .otherwise(F.lit("Listener failed")))
    type_id = F.when(eid % 2 == 0, F.lit(TYPE_A)).otherwise(F.lit(TYPE_B))
    entries = [
        ("kafka_original-topic", F.when(eid % 23 != 0, topic)),
        ("kafka_original-partition", F.when(eid % 23 != 0, F.concat(F.lit(" "), (eid % 6).cast("string"), F.lit(" ")))),
        ("kafka_original-offset", F.when(eid % 23 != 0, (eid * 10).cast("string"))),
        ("kafka_original-timestamp", F.when(eid % 19 == 0, F.lit("garbage")).otherwise(orig_ms.cast("string"))),
        ("kafka_dlt-original-consumer-group", F.concat(F.lit("grp-"), (eid % 2).cast("string"))),
        ("kafka_exception-fqcn", F.lit("org.springframework.kafka.listener.ListenerExecutionFailedException")),
        ("kafka_exception-cause-fqcn", F.lit("java.lang.RuntimeException")),
        ("kafka_exception-message", msg),
        ("kafka_exception-stacktrace", F.when(m8 != 6, trace)),
        ("retry_topic-attempts", F.lit("3")),
        ("retry_topic-original-timestamp", F.hex(orig_ms)),
        ("retry_topic-backoff-timestamp", F.when(eid % 7 != 0, F.hex(ms))),
        ("__TypeId__", type_id),
    ]
    hdr = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"))
                                               for k, v in entries]), lambda e: e["value"].isNotNull()))
    payload_a = F.concat(F.lit('{"event_id":"'), F.md5(eid.cast("string")), F.lit('","response":{"refId":"'), pay_ref,
                         F.lit('","requestId":"req-'), eid.cast("string"),
                         F.lit('","results":{"referenceId":"'), pay_ref, F.lit('","matches":[{"engine":"E'),
                         (eid % 3).cast("string"), F.lit('","candidates":[{"candidateRefId":"c'), eid.cast("string"),
                         F.lit('","score":'), (eid % 100).cast("string"), F.lit('}]}]}}}'))
    payload_b = F.concat(F.lit('{"eventId":"'), F.md5(eid.cast("string")), F.lit('","data":{"meta":{"refId":"'),
                         pay_ref, F.lit('","flag":true}},"items":[{"ref_id":"zz'), eid.cast("string"), F.lit('"}]}'))
    payload = (F.when(eid % 13 == 0, F.lit("not json {"))
               .when(eid % 2 == 0, payload_a).otherwise(payload_b))
    key = (F.when(eid % 5 == 0, F.lit(None).cast("string"))
           .when(eid % 5 == 1, F.lit("bad key!"))
           .otherwise(ref))
    out = ev.select(
        F.lit("enrolment.requests.dlt").alias("dlt_topic"), (eid % 4).cast("int").alias("dlt_partition"),
        eid.alias("dlt_offset"), F.timestamp_millis(ms + (eid % 600) * 1000 + 250).alias("dlt_timestamp"),
        key.alias("key"),
        hdr.alias("headers"), payload.alias("payload"), F.col("ts"), uid.alias("user_id"), eid.alias("event_id"))
    return out


def reason_codes(spark: SparkSession) -> DataFrame:
    from logsift.plans.dlt_fixture import REASON_CODES
    return spark.createDataFrame(REASON_CODES, "code string, description string, category string, "
                                 "category_source string, failure_class string, stage string, section string, "
                                 "numeric_id string")


def v_case_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0-6 service log lines around each dead-lettered record's last attempt,
    keyed by the record's correlation id; some name the declared failure,
    some another exception."""
    from logsift.plans.dlt_fixture import DECLARED_IN_LOGS
    ev = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    ref = F.substring(F.md5(F.concat(F.lit("ref"), uid.cast("string"))), 1, 24)
    j = F.col("j")
    k = (eid + j) % 5
    decl = F.element_at(F.array(*[F.lit(t) for t in DECLARED_IN_LOGS]), ((eid % 8) + 1).cast("int"))
    text = (F.when(k == 0, F.concat(F.lit("ERROR [svc] failure: "), decl))
            .when(k == 1, F.lit("ERROR [svc] org.example.db.PoolExhaustedException: pool exhausted"))
            .when(k == 2, F.concat(F.lit("INFO [svc] step "), j.cast("string"), F.lit(" done")))
            .when(k == 3, F.lit("WARN [svc] slow call in DedupServiceImpl.lookupMaster"))
            .otherwise(F.lit("FATAL [svc] worker stopped")))
    lines = ev.select(eid, uid, "ts", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j")).where(F.col("j") < eid % 7)
    return lines.select(
        ref.alias("ref_id"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - j * 40000000).alias("ts"),
        (eid * 10 + j).alias("line_id"), text.alias("line"))


def v_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded agent results for the dead-letter cases (one per record)."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    actions = F.array(*[F.lit(a) for a in ["NEEDS_MANUAL_REVIEW", "ROUTE_TO_DEV", "REDRIVE_AFTER_RECOVERY",
                                           "DATA_FIX_REQUIRED", "NO_ACTION"]])
    return ev.select(eid.alias("event_id"), (eid % 3 != 0).alias("agent_ok"),
                     F.element_at(actions, ((eid % 5) + 1).cast("int")).alias("agent_action"),
                     ((eid % 100) / 100.0).alias("agent_confidence"))


ACTIONS6 = ["REPLAY", "WHITELISTING", "QC_REPLAY", "RO_APPROVAL", "RESIDENT_PACKET_RESUBMIT", "MANUAL_REVIEW"]


def v_casebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rejection casebook per order: status, code, type, resolution,
    shadow runbook comparison."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    acts = F.array(*[F.lit(a) for a in ACTIONS6])
    code = F.concat(F.lit("RC_"), F.regexp_replace(F.upper(F.substring("o_orderpriority", 3, 100)), " ", "_"))
    etype = F.when(F.col("o_orderstatus") == "F", "NEW").when(F.col("o_orderstatus") == "O", "UPDATE")
    status = (F.when(k % 11 == 0, "IN_PROGRESS").when(k % 11 == 1, "LOGS_FETCHED").when(k % 11 == 2, "FAILED_TIMEOUT")
              .when(k % 11 == 3, "DLQ").when(k % 11 == 4, "REJECTED").when(k % 11 == 5, "NEEDS_MANUAL_REVIEW")
              .otherwise("COMPLETED"))
    action = F.element_at(acts, (k % 6 + 1).cast("int"))
    shadow_id = F.when(k % 3 == 0, F.concat(F.lit("RB_"), code, F.lit("_"), F.coalesce(etype, F.lit("ANY"))))
    shadow_action = F.when(shadow_id.isNotNull(), F.element_at(acts, ((k / 7).cast("bigint") % 6 + 1).cast("int")))
    return o.select(
        F.concat(F.lit("EV"), k.cast("string")).alias("event_id"), status.alias("status"),
        code.alias("reason_code"), etype.alias("enrolment_type"),
        F.when((k / 2).cast("bigint") % 4 == 1, F.concat(F.lit("runbook:"), code))
        .when((k / 2).cast("bigint") % 4 == 3, F.lit(None).cast("string"))
        .otherwise(F.lit("agent")).alias("resolution_source"),
        action.alias("agent_action"),
        F.when(k % 9 == 0, F.lit(None).cast("double")).otherwise((k % 100) / 100.0).alias("confidence"),
        (k % 13 == 0).alias("abstained"), shadow_action.alias("shadow_action"), shadow_id.alias("shadow_runbook_id"),
        F.when(shadow_id.isNotNull(), shadow_action == action).alias("shadow_agreed"),
        F.concat(F.lit("pf-"), (k % 3).cast("string")).alias("prompt_fingerprint"),
        F.col("o_orderdate").alias("updated_at"), F.col("o_custkey").alias("customer"),
        F.when(k % 17 == 0, F.lit("ESCALATED TO HUMAN REVIEW: low confidence")).otherwise(F.lit("resolved")).alias("synthesis"))


def v_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator verdicts: one per order (some words invalid, some for unknown
    events), plus a later revision for some."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    acts = F.array(*[F.lit(a) for a in ACTIONS6])
    raw = (F.when(c % 5 == 0, "CORRECT").when(c % 5 == 1, " incorrect ").when(c % 5 == 2, "PARTIAL")
           .when(c % 5 == 3, "correct").otherwise("MAYBE"))
    eid = F.when(k % 31 == 0, F.concat(F.lit("EVX"), k.cast("string"))).otherwise(F.concat(F.lit("EV"), k.cast("string")))
    first = o.select(eid.alias("event_id"), raw.alias("verdict"), F.concat(F.lit("op"), (c % 3).cast("string")).alias("verified_by"),
                     (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("verified_at"), F.lit("").alias("notes"),
                     F.when(c % 5 == 1, F.element_at(acts, ((k + 1) % 6 + 1).cast("int"))).alias("corrected_action"))
    second = o.where(k % 10 == 0).select(
        eid.alias("event_id"), F.lit("CORRECT").alias("verdict"), F.lit("op-review").alias("verified_by"),
        (F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("verified_at"), F.lit("revised").alias("notes"),
        F.lit(None).cast("string").alias("corrected_action"))
    return first.unionByName(second)


CODES5 = ["RC_URGENT", "RC_HIGH", "RC_MEDIUM", "RC_NOT_SPECIFIED", "RC_LOW"]


def v_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules table: one rule per part; the first 40 carry the casebooks'
    reason codes (8 rules per code at every scale), the rest other codes."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    codes = F.array(*[F.lit(c) for c in CODES5])
    code = F.when(k <= 40, F.element_at(codes, (k % 5 + 1).cast("int"))) \
        .otherwise(F.concat(F.lit("RC_PART_"), k.cast("string")))
    et = (F.when(k % 6 == 0, F.lit('{"statement":{"Condition":{"StringEquals":{"enrolmentType":"UPDATE"}}}}'))
          .when(k % 6 == 1, F.lit('{"statement":{"Condition":{"StringEquals":{"enrolmentType":"ENROLMENT"}}}}'))
          .when(k % 6 == 2, F.lit('{"statement":{"Condition":{"StringEquals":{"enrolmentType":"U"}}}}'))
          .when(k % 6 == 3, F.lit('{"statement":{"Condition":{}}}'))
          .when(k % 6 == 4, F.lit("{broken"))
          .otherwise(F.lit('{"statement":{"Effect":"Deny"}}')))
    return p.select(code.alias("reject_reason_code"), F.col("p_name").alias("rule_description"),
                    (F.col("p_size") % 7 != 0).alias("is_active"), et.alias("rule_data"), k.alias("rule_pos"))


def v_runbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runbooks (drafts and finals): one per part; the first 200 are for the
    casebook codes (a constant number per code at every scale)."""
    p = table(spark, sf_dir, "part")
    k, sz = F.col("p_partkey"), F.col("p_size")
    codes = F.array(*[F.lit(c) for c in CODES5])
    acts = F.array(*[F.lit(a) for a in ACTIONS6])
    code = F.when(k <= 200, F.element_at(codes, ((k / 7).cast("bigint") % 5 + 1).cast("int"))) \
        .otherwise(F.concat(F.lit("RC_PART_"), k.cast("string")))
    et = F.element_at(F.array(F.lit("NEW"), F.lit("UPDATE"), F.lit("ANY"), F.lit(" update "), F.lit(None).cast("string")),
                      (k % 5 + 1).cast("int"))
    version = ((k / 1000).cast("bigint") % 3 + 1).cast("int")
    res = F.struct(F.lit("desc").alias("rejection_description"),
                   F.when(sz % 11 == 0, F.lit(None).cast("string")).otherwise(F.lit("syn")).alias("synthesis"),
                   F.element_at(acts, (k % 6 + 1).cast("int")).alias("action"), F.lit("PENDING").alias("resident_action"))
    return p.select(
        F.concat(F.lit("RB_"), k.cast("string")).alias("runbook_id"), F.lit(None).cast("string").alias("schema_note"),
        F.when(sz % 9 == 0, "2.0").otherwise("1.1").alias("schema_version"), code.alias("reason_code"),
        et.alias("enrolment_type"), F.when(sz % 4 == 0, "draft").otherwise("final").alias("status"),
        version.alias("version"), F.concat(F.lit("sha256:"), F.sha2(F.col("p_name"), 256)).alias("rule_fingerprint"),
        res.alias("resolution")).drop("schema_note")


def v_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejection-topic values (JSON text), one per order, with poison."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    code = F.concat(F.lit("RC_"), F.regexp_replace(F.upper(F.substring("o_orderpriority", 3, 100)), " ", "_"))
    eid = F.when(k % 37 == 0, F.concat(F.lit("EV "), k.cast("string"), F.lit("/..")))\
        .otherwise(F.concat(F.lit("EV"), k.cast("string")))
    status = F.when(k % 5 == 0, F.lit("SUCCESS")).otherwise(F.lit("REJECTED"))
    first = F.when(k % 3 == 0, F.lit('{"type":"VALIDATION","errorReasonCode":""},')).otherwise(F.lit(""))
    etype = F.when(F.col("o_orderstatus") == "F", "NEW").when(F.col("o_orderstatus") == "O", "UPDATE").otherwise("")
    js = F.concat(
        F.lit('{"eventId":"'), eid, F.lit('","category":"PACKET","sourceTopic":"packets.rejected",'
                                          '"flowMetaData":{"stage":"BIO","subStage":"DEDUP"},'
                                          '"packetMetaData":{"refId":"'), F.lpad(k.cast("string"), 12, "0"),
        F.lit('","srn":"SRN'), F.col("o_custkey").cast("string"), F.lit('","enrolmentType":"'), etype,
        F.lit('"},'),
        F.when(k % 43 == 0, F.lit('"other":1')).otherwise(F.concat(
            F.lit('"packetExecutionSummary":{"packetStatus":"'), status, F.lit('","errorData":['), first,
            F.lit('{"type":"BUSINESS","errorReasonCode":"'), code, F.lit('"}]}'))),
        F.lit("}"))
    value = F.when(k % 41 == 0, F.concat(F.lit("garbage-"), k.cast("string"))).otherwise(js)
    return o.select(k.alias("msg_offset"), value.alias("value"))


def v_text_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, as a flow per document (whole texts)."""
    d = table(spark, sf_dir, "documents")
    ex = d.select("doc_id", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("seq", "message"))
    return ex.where(F.trim(F.col("message")) != "").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("flow_id"), F.col("seq").cast("bigint").alias("seq"),
        F.lpad(F.col("seq").cast("string"), 8, "0").alias("timestamp"), "message")


def v_pod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pod inventory: one pod per supplier, named after its nation."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    svc = F.lower(F.regexp_replace("n_name", " ", "-"))
    containers = (F.when(k % 13 == 0, F.lit(None).cast("array<string>"))
                  .when(k % 5 == 0, F.array(F.lit("istio-proxy")))
                  .when(k % 5 == 1, F.array(F.lit("app"), F.lit("istio-proxy")))
                  .otherwise(F.array(F.lit("app"), F.lit("worker"))))
    start = F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + k * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return s.select(
        F.concat(F.lit("ns-"), (F.col("s_nationkey") % 3).cast("string")).alias("namespace"),
        F.concat(svc, F.lit("-"), k.cast("string")).alias("pod"),
        F.when(k % 7 == 0, "Pending").when(k % 17 == 0, F.lit(None).cast("string")).otherwise("Running").alias("phase"),
        start.alias("start_time"),
        F.create_map(F.lit("app"), svc, F.lit("tier"), F.when(k % 2 == 0, "a").otherwise("b")).alias("labels"),
        containers.alias("containers"),
        F.create_map(F.lit("app"), (k % 4).cast("int")).alias("restart_counts"))


def v_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured services: one per nation; even ones match pods by name,
    odd ones by label selector.  One more per namespace matches all its pods,
    which the others match too."""
    n = table(spark, sf_dir, "nation")
    svc = F.lower(F.regexp_replace("n_name", " ", "-"))
    mode = F.when(F.col("n_nationkey") % 2 == 0, "name_contains").otherwise("label")
    space = n.select((F.col("n_nationkey") % 3).alias("k")).distinct()
    wide = space.select(F.concat(F.lit("platform-"), F.col("k").cast("string")).alias("service"),
                        (F.lit(100) + F.col("k")).alias("ord"), F.concat(F.lit("ns-"), F.col("k").cast("string")).alias("namespace"),
                        F.lit("name_contains").alias("mode"), F.lit("-").alias("value"),
                        F.lit(None).cast("map<string,string>").alias("selector"))
    return n.select(svc.alias("service"), F.col("n_nationkey").alias("ord"),
                    F.concat(F.lit("ns-"), (F.col("n_nationkey") % 3).cast("string")).alias("namespace"),
                    mode.alias("mode"), svc.alias("value"),
                    F.when(mode == "label", F.create_map(F.lit("app"), svc, F.lit("tier"), F.lit("a")))
                    .alias("selector")).unionByName(wide)


def v_status_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case status events over time, one small history per order."""
    o = table(spark, sf_dir, "orders")
    k, t0 = F.col("o_orderkey"), F.col("o_orderdate")
    cid = F.concat(F.lit("EV"), k.cast("string"))

    def ev(offset_min, status, cond=None):
        df = o if cond is None else o.where(cond)
        return df.select(cid.alias("case_id"), (t0 + F.expr(f"INTERVAL {offset_min} MINUTES")).alias("status_at"),
                         status.alias("status") if not isinstance(status, str) else F.lit(status).alias("status"))
    term = F.when(k % 4 == 0, "COMPLETED").when(k % 4 == 1, "REJECTED").otherwise("NEEDS_MANUAL_REVIEW")
    parts = [ev(0, "LOGS_FETCHED"), ev(1, "IN_PROGRESS"),
             ev(3, "FAILED_TIMEOUT", k % 9 == 0), ev(5, term, k % 6 != 5),
             ev(7, "LOGS_FETCHED", k % 8 == 0), ev(8, "DLQ", k % 25 == 0)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def v_code_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Java-like reason-code source derived from ``part``: stage and section
    comments, enum rows with declared categories, commented-out rows, then
    the id-keyed map block (some codes repeat the enum's)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    code = F.concat(F.lit("CODE_"), (k % 700).cast("string"))
    cats = F.array(F.lit("BUSINESS_VALIDATION_ERROR"), F.lit("BUSINESS_EXCEPTION"), F.lit("TECHNICAL_EXCEPTION"))
    prefixes = F.array(F.lit("17"), F.lit("37"), F.lit("12"), F.lit("23"))
    desc = F.regexp_replace(F.col("p_name"), '"', "")
    enum_line = F.concat(F.lit("    "), code, F.lit('("'), code, F.lit('", "'), desc, F.lit('", ReasonCategory.'),
                         F.element_at(cats, (k % 3 + 1).cast("int")), F.lit("),"))
    map_line = F.concat(F.lit("        tempMap.put("), F.element_at(prefixes, (k % 4 + 1).cast("int")),
                        F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(', new ReasonCode("'), code, F.lit('", "'),
                        desc, F.lit('"));'))
    line = (F.when(k % 50 == 1, F.concat(F.lit("// ## Stage "), (k / 50).cast("bigint").cast("string"), F.lit(" :: DONE")))
            .when(k % 10 == 2, F.concat(F.lit("// Section "), (k / 10).cast("bigint").cast("string")))
            .when(k % 37 == 3, F.concat(F.lit("// "), enum_line))
            .when(k == 1000, F.lit("    private static Map tempMap = new HashMap<>();"))
            .when(k > 1000, map_line).otherwise(enum_line))
    return p.select(F.lit("Codes.java").alias("file"), k.alias("line_no"), line.alias("line"))
