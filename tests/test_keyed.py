import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from logsift.sources.casestore import CAPTURED, RAW, REDUCED, CaseStore, raw_trace
from logsift.sources.keyed import ConcurrentWrite, KeyedTable


def folder():
    return tempfile.mkdtemp(prefix="logsift-keyed-")


def rows(spark, ids, v):
    return spark.createDataFrame([(f"k{i:05d}", v) for i in ids], "id string, v long")


def state(table):
    return {r.id: r.v for r in table.read().collect()}


def test_upsert_rewrites_only_touched_buckets(spark):
    t = KeyedTable(spark, folder(), "id", buckets=64)
    assert t.read() is None and t.files_of("k00001") == []
    t.upsert(rows(spark, range(2000), 1))
    before = t.manifest()["folders"]
    t.upsert(rows(spark, range(0, 20), 2))
    after = t.manifest()["folders"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 0 < len(changed) <= 20 and len(after) == 64
    assert state(t) == {f"k{i:05d}": 2 if i < 20 else 1 for i in range(2000)}
    assert {r.id: r.v for r in t.read(version=1).collect()} == {f"k{i:05d}": 1 for i in range(2000)}


def test_a_death_before_the_flip_leaves_the_old_state(spark, monkeypatch):
    t = KeyedTable(spark, folder(), "id", buckets=8)
    t.upsert(rows(spark, range(100), 1))

    def dies(self, state):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", dies)
        with pytest.raises(OSError):
            t.upsert(rows(spark, range(50), 2))
        with pytest.raises(OSError):
            t.delete(rows(spark, range(50), 2))
    assert state(t) == {f"k{i:05d}": 1 for i in range(100)}
    t.upsert(rows(spark, range(50), 2))
    assert state(t) == {f"k{i:05d}": 2 if i < 50 else 1 for i in range(100)}
    left = len(os.listdir(f"{t.path}/data"))
    assert t.vacuum(keep=1) and len(os.listdir(f"{t.path}/data")) < left and len(t.versions()) == 1
    assert len(state(t)) == 100


def test_two_writers_of_one_version(spark):
    path = folder()
    a, b = KeyedTable(spark, path, "id", buckets=4), KeyedTable(spark, path, "id", buckets=4)
    a.upsert(rows(spark, range(10), 1))
    stale = b.manifest()
    a.upsert(rows(spark, range(10), 2))
    with pytest.raises(ConcurrentWrite):
        b._publish(stale | {"version": stale["version"] + 1})
    assert set(state(b).values()) == {2}


def test_replay_absent_only_and_delete(spark):
    t = KeyedTable(spark, folder(), "id", buckets=8)
    t.upsert(rows(spark, range(10), 1), batch=("in", 5))
    t.upsert(rows(spark, range(10), 9), batch=("in", 5))                    # a replay changes nothing
    assert set(state(t).values()) == {1}
    t.upsert(rows(spark, range(5, 15), 3), absent_only=True)
    assert state(t) == {f"k{i:05d}": 1 if i < 10 else 3 for i in range(15)}
    t.delete(rows(spark, range(0, 14), 0))
    assert state(t) == {"k00014": 3}
    t.delete(rows(spark, [14], 0))
    assert state(t) == {}
    t.upsert(rows(spark, [], 1))
    assert state(t) == {}
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([("a", "b")], "id string, w string"))
    with pytest.raises(Exception, match="row without an id"):
        t.upsert(spark.createDataFrame([(None, 1)], "id string, v long"))


def test_lookup_opens_one_file(spark):
    t = KeyedTable(spark, folder(), "id", buckets=2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t.upsert(rows(spark, range(5000), 1).repartition(4))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(t.read().inputFiles()) >= 4
    assert len(t.files_of("k01234")) == 1 and len(t.get("k01234").inputFiles()) == 1
    assert [tuple(r) for r in t.get("k01234").collect()] == [("k01234", 1)]
    assert t.get("nobody").count() == 0


BOOKS = "case_id string, status string, updated_at timestamp, action string"
OLD, NEW = dt.datetime(2026, 1, 1), dt.datetime(2026, 6, 1)


def store(spark):
    s = CaseStore(spark, folder(), buckets=4)
    s.save_terminal(spark.createDataFrame([("a", "COMPLETED", OLD, "x"), ("b", "COMPLETED", NEW, "x"), ("c", "IN_PROGRESS", OLD, "x"),
                                           ("d", "DLQ", OLD, "y")], BOOKS))
    lines = spark.createDataFrame([(c, i, "t", "app", "pod-1" if i else None, "INFO", f"m{i}") for c in "abcd" for i in range(3)],
                                  "case string, n int, timestamp string, app_name string, pod_name string, level string, message string")
    s.save_trace(RAW, raw_trace(lines, "case", "n"))
    s.save_trace(REDUCED, spark.createDataFrame([("a", 0, "short")], "case_id string, seq long, line string"))
    s.capture(spark.createDataFrame([("a", 0, "r0"), ("a", 1, "r1")], "case_id string, seq long, line string"),
              spark.createDataFrame([("a", "TRUNCATED", "cut"), ("e", "NO_PODS", "none")], "case_id string, type string, detail string"),
              F.lit("2026-02-02 00:00:00"), "kubernetes")
    s.outcomes.upsert(spark.createDataFrame([("a", "CORRECT")], "case_id string, verdict string"))
    s.checkpoints.upsert(spark.createDataFrame([("a", 1), ("z", 2)], "case_id string, state long"))
    return s


def ids(df):
    return sorted(r.case_id for r in df.select("case_id").distinct().collect())


def test_case_in_full_and_capture_once(spark):
    s = store(spark)
    one = s.case("a").collect()
    assert len(one) == 1
    assert one[0].raw_logs == ["[t] [app] [INFO] m0", "[t] [app@pod-1] [INFO] m1", "[t] [app@pod-1] [INFO] m2"]
    assert one[0].reduced_logs == ["short"] and one[0].raw_logs_k8s == ["r0", "r1"] and one[0].action == "x"
    assert s.case("b").collect()[0].reduced_logs == [] and s.case("nobody").count() == 0
    meta = {r.case_id: (r.record_count, [g.type for g in r.gaps], r.source) for r in s.snapshot_meta.read().collect()}
    assert meta == {"a": (2, ["TRUNCATED"], "kubernetes"), "e": (0, ["NO_PODS"], "kubernetes")}
    s.capture(spark.createDataFrame([("a", 0, "other")], "case_id string, seq long, line string"),
              spark.createDataFrame([], "case_id string, type string, detail string"), F.lit("2026-03-03 00:00:00"), "kubernetes")
    assert s.case("a").collect()[0].raw_logs_k8s == ["r0", "r1"]


def test_a_death_between_casebook_and_status(spark, monkeypatch):
    s = store(spark)
    upsert = KeyedTable.upsert

    def dies(self, *a, **k):
        if self is s.statuses:
            raise OSError("lost")
        return upsert(self, *a, **k)
    monkeypatch.setattr(KeyedTable, "upsert", dies)
    with pytest.raises(OSError):
        s.save_terminal(spark.createDataFrame([("c", "COMPLETED", NEW, "z")], BOOKS))
    books, status = ({r.case_id: r.status for r in t.read().collect()} for t in (s.casebooks, s.statuses))
    assert books["c"] == "COMPLETED" and status["c"] == "IN_PROGRESS"


def test_prune(spark):
    s = store(spark)
    now, terminal = F.lit(dt.datetime(2026, 6, 10)), ["COMPLETED", "DLQ"]
    assert ids(s.prune(now, 30, terminal, dry_run=True)) == ["a", "d"] and ids(s.casebooks.read()) == ["a", "b", "c", "d"]
    untouched = s.artefacts[REDUCED].manifest()["version"]
    assert ids(s.prune(now, 30, terminal, logs_only=True)) == ["a", "d"]
    assert ids(s.casebooks.read()) == ["a", "b", "c", "d"] and ids(s.artefacts[RAW].read()) == ["b", "c"]
    assert s.artefacts[REDUCED].manifest()["version"] == untouched + 1 and s.artefacts[CAPTURED].read().count() == 0
    s.prune(now, 30, terminal)
    assert ids(s.casebooks.read()) == ["b", "c"] == ids(s.statuses.read()) and ids(s.outcomes.read()) == ["a"]
    assert ids(s.prune(now, 30, terminal)) == []
    assert ids(s.prune_checkpoints(dry_run=True)) == []
    s.checkpoints.upsert(spark.createDataFrame([("b", 1)], "case_id string, state long"))
    assert ids(s.prune_checkpoints()) == ["b"] and ids(s.checkpoints.read()) == ["a", "z"]
