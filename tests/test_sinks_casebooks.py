import json
import tempfile

import pytest
from pyspark.sql import functions as F

from logsift.operators import casebooks as CB
from logsift.operators import pods as PO
from logsift.sources import sinks as SK


def test_dlq_envelope_and_handoff(spark):
    df = spark.createDataFrame([("raw{", "payload is not a JSON object")], "raw_text string, poison_reason string")
    env = json.loads(SK.dlq_envelope(df).collect()[0].value)
    assert env == {"original_payload": "raw{", "dlq_error": "payload is not a JSON object"}
    h = SK.handoff(spark.createDataFrame([("E1",)], "eventId string"), {"evidence_gaps": F.array(F.lit("NO_TIMESTAMP"))})
    assert json.loads(h.collect()[0].value) == {"eventId": "E1", "evidence_gaps": ["NO_TIMESTAMP"]}


def test_reason_code_csv_refuses_empty(spark):
    path = tempfile.mkdtemp(prefix="logsift-csv-")
    with pytest.raises(ValueError):
        SK.reason_code_csv(spark.createDataFrame([], "code string"), f"{path}/empty")
    SK.reason_code_csv(spark.createDataFrame([("C1", "d")], "code string, description string"), f"{path}/ok")
    back = spark.read.option("header", True).csv(f"{path}/ok").collect()[0].asDict()
    assert list(back) == SK.REASON_CODE_CSV_COLUMNS and back["code"] == "C1" and back["stage"] is None


def test_latest_by_key_and_replay_queue(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, s string")
    assert sorted(map(tuple, SK.latest_by_key(df, ["k"], "v").collect())) == [("a", 2, "y"), ("b", 1, "z")]
    noms = spark.createDataFrame([("1", "DLT_Redrive"), ("2", "other")], "id string, category string")
    assert [r.id for r in SK.replay_queue(noms, "dlt_redrive").collect()] == ["1"]


def test_gap_banner_extraction_and_rejection_casebook(spark):
    logs = PO.BANNER_HEADER + "\nTRUNCATED: x\n" + PO.BANNER_FOOTER + "\n\n--- Log Trace ---"
    df = spark.createDataFrame([("E1", "r", "RC", logs, True, False, "REPLAY", "NEW_PACKET", 0.9, None),
                                ("E2", "r", "RC", "no banner", False, False, None, None, None, None),
                                ("E3", "r", "RC", "", True, True, "MANUAL_REVIEW", "PENDING", 0.1, None)],
                               "event_id string, ref_id string, first_reason_code string, logs_text string, "
                               "valid boolean, abstained boolean, action string, resident_action string, "
                               "confidence double, status string")
    out = {r.event_id: r.casebook for r in CB.rejection_casebook(df).collect()}
    assert out["E1"].packet_status.status == "COMPLETED"
    assert out["E1"].packet_status.rejection_data.gaps == PO.BANNER_HEADER + "\nTRUNCATED: x\n" + PO.BANNER_FOOTER
    assert out["E2"].packet_status.status == "FAILED_SYNTHESIS_PARSE"
    assert out["E3"].packet_status.status == "NEEDS_MANUAL_REVIEW"


def test_fetch_rollup_ok_semantics(spark):
    per = spark.createDataFrame([("a", 0, 0, False, None, None), ("a", 0, 0, False, None, None),
                                 ("b", 0, 0, False, None, None), ("b", 5, 100, True, "2024-01-01T00:00:00Z", None)],
                                "flow_id string, records long, bytes long, read_ok boolean, oldest_ts string, start_time timestamp")
    got = {r.flow_id: (r.ok, r.pods_queried, r.pods_failed, r.records) for r in PO.fetch_rollup(per).collect()}
    assert got == {"a": (False, 2, 2, 0), "b": (True, 2, 1, 5)}


def test_logs_text_is_the_head_of_a_cases_lines_in_order(spark):
    lines = [("a", 2, 1, "third"), ("a", 1, 9, "second"), ("a", 1, 8, "first"), ("b", 1, 1, None), ("b", 2, 2, "x" * 50)]
    lines += [("c", 1, i, "") for i in range(100)]
    df = spark.createDataFrame(lines, "case_id string, ts int, line_id int, line string")
    for chars in (1, 6, 12, 30, 1000):
        got = {r.case_id: r.logs_text for r in CB.logs_text(df, chars=chars).collect()}
        assert got == {"a": "first\nsecond\nthird"[:chars], "b": ("\n" + "x" * 50)[:chars], "c": ("\n" * 99)[:chars]}


def test_registered_casebooks_hold_the_cases_log_lines(spark):
    from __spark_entry__ import SMOKE_DIR, queries
    from logsift.operators.corroborate import window_lines
    from logsift.plans.q_deadletter import dlt_analysis_df
    from logsift.plans.views import v_case_log
    got = {r.case_id: r.evidence_chars for r in queries()["dlt_casebooks"](spark, SMOKE_DIR).collect()}
    cases = dlt_analysis_df(spark, SMOKE_DIR)
    assert len(got) == cases.count()
    lines = {}
    for r in window_lines(cases.where("not fetch_skipped and ref_id is not null"), v_case_log(spark, SMOKE_DIR)).collect():
        lines.setdefault(r.case_id, []).append(r.line)
    assert lines
    bare = cases.withColumn("logs_text", F.lit(None).cast("string"))
    for r in bare.select("case_id", F.length(CB.evidence_document(bare)).alias("n")).collect():
        logs = "\n".join(lines.get(r.case_id, ["(no logs were fetched)"]))
        assert got[r.case_id] == r.n - len("(no logs were fetched)") + min(len(logs), CB.MAX_EVIDENCE_CHARS)
