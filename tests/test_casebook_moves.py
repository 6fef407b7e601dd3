"""What the casebooks leave on disk: a case's wide columns are written and
moved as rarely as may be, shuffle files go with the table they were made for."""

import datetime as dt
import os
import time
from glob import glob

import pytest
from pyspark.sql import functions as F

from logsift.operators import deadletter as D
from logsift.operators import groups as G
from logsift.operators.groups import dedupe_cases
from logsift.session import ensure_checkpoint_dir, materialize


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in files.mkString("\n").split("\n") if os.path.basename(n).startswith("shuffle_")}


def test_a_written_tables_shuffle_files_are_removed(spark):
    before = shuffle_files(spark)
    out = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("id").alias("n")))
    for _ in range(100):                       # removed in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert {(r.k, r.n) for r in out.collect()} == {(k, 143 if k < 6 else 142) for k in range(7)}


def test_the_cleanup_setting_is_as_before(spark):
    from logsift.session import SHUFFLE_CLEANUP
    for value in ("false", "true"):
        spark.conf.set(SHUFFLE_CLEANUP, value)
        materialize(spark.range(3))
        assert spark.conf.get(SHUFFLE_CLEANUP) == value
    spark.conf.unset(SHUFFLE_CLEANUP)


SCHEMA = "case_id string, seq int, payload string, tags array<string>, m map<string,int>"


@pytest.mark.parametrize("ids", [0, G.MAX_BROADCAST_IDS])
def test_dedupe_in_place_equals_the_aggregate(spark, monkeypatch, ids):
    monkeypatch.setattr(G, "MAX_BROADCAST_IDS", ids)
    rows = [("a", 2, "late", ["x"], {"k": 1}), ("a", 1, "early", ["y"], None), ("a", None, "never", None, None),
            ("b", 5, None, None, {"k": 2}), ("c", None, "no time", ["z"], None),
            ("d", None, "p", None, None), ("d", None, "q", None, None),
            (None, 3, "n3", None, None), (None, 1, "n1", None, None), ("e", 1, "same", [], None), ("e", 1, "same", [], None)]
    for some in (rows, rows[:2], rows[3:5], rows[7:8], []):
        cases = materialize(spark.createDataFrame(some, SCHEMA))
        got = dedupe_cases(cases, in_place=True)
        assert got.columns == cases.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, dedupe_cases(cases).collect()))
    assert {r.case_id: r.payload for r in dedupe_cases(materialize(spark.createDataFrame(rows, SCHEMA)), in_place=True)
            .collect()} == {"a": "early", "b": None, "c": None, "d": None, None: "n1", "e": "same"}


def test_dedupe_in_place_does_not_shuffle_cases_that_came_once(spark):
    cases = materialize(spark.range(500).select(F.col("id").cast("string").alias("case_id"), F.col("id").alias("seq"),
                                                F.repeat(F.lit("p"), 100).alias("payload")))
    got = dedupe_cases(cases, in_place=True)
    assert len(got.collect()) == 500
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning" not in final


@pytest.mark.parametrize("traces", [0, D.MAX_BROADCAST_TRACES])
def test_written_traces_give_the_same_failures(spark, monkeypatch, traces):
    monkeypatch.setattr(D, "MAX_BROADCAST_TRACES", traces)
    rows = [(i, [None, "", "a.b.CException: x\n\tat com.example.K.m(K.java:3)", "words"][i % 4], [None, "[CODE_A] y"][i % 3 % 2])
            for i in range(24)]
    df = spark.createDataFrame(rows, "n int, stacktrace string, exception_message string")
    plain, kept = D.build_failures(df, None), D.build_failures(df, None, materialize=True)
    assert kept.columns == plain.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, plain.collect()))


def test_casebooks_write_neither_payloads_nor_frames_of_links(spark, tmp_path):
    from __spark_entry__ import queries
    start = dt.datetime(2024, 1, 10)
    events = [(i, start + dt.timedelta(minutes=i), i % 9, "error", 1.5, '{"k": 1}') for i in range(60)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string") \
        .select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props") \
        .coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob(f"{folder}/stage-*"))
    got = {r.case_id: r for r in queries()["dlt_casebooks"](spark, str(tmp_path)).collect()}
    assert len(got) == 60
    assert {r.payload_keys for r in got.values()} == {"event_id,response", "eventId,data,items", None}
    assert all((r.candidate_total == 1) == (r.payload_keys == "event_id,response") for r in got.values())
    assert all(r.evidence_chars > 300 for r in got.values())
    tables = [spark.read.parquet(t) for t in set(glob(f"{folder}/stage-*")) - before]
    assert tables and not any("payload" in t.columns for t in tables)
    cases = [t for t in tables if {"case_id", "chain"} <= set(t.columns)]
    assert len(cases) == 2 and all(t.schema["chain"].dataType.elementType.names == ["fqcn", "message"] for t in cases)
