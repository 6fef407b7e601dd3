import tempfile

from pyspark.sql import functions as F

from logsift.plans.dlt_fixture import TRACES
from logsift.streaming import pipelines as SP
from logsift.streaming.lifecycle import fold_status, sweep_stale


def _kafka_rows(spark, n=40):
    rows = []
    for i in range(n):
        hdrs = [("kafka_original-topic", b"orders"), ("kafka_original-partition", b"1"),
                ("kafka_original-offset", str(i % 30).encode()), ("retry_topic-backoff-timestamp", b"18CC252100B"),
                ("kafka_exception-stacktrace", TRACES[i % 6].replace("{n}", str(i)).encode()),
                ("kafka_exception-message", b"Listener failed"), ("__TypeId__", b"T"),
                ("kafka_original-partition", b"2")]                                  # duplicate key: last wins
        rows.append((f"refkey-{i % 7:04d}".encode(), b'{"response":{"refId":"x"}}', "dlt", 0, i,
                     None, hdrs))
    return spark.createDataFrame(rows, SP.KAFKA_SCHEMA)


def test_deadletter_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="logsift-stream-")
    src = f"{base}/src"
    _kafka_rows(spark).write.parquet(src)
    stream = SP.decode_deadletters(spark.readStream.schema(SP.KAFKA_SCHEMA).parquet(src))
    q = SP.start_deadletter_ingest(stream, f"{base}/out", f"{base}/ckpt", now_fn=lambda: "2024-01-02 00:00:00",
                                   packages=("com.example.app.",))
    q.awaitTermination(300)
    got = spark.read.parquet(f"{base}/out/evidence")
    batch = SP.evidence_batch(SP.decode_deadletters(spark.read.parquet(src)), None,
                              F.lit("2024-01-02 00:00:00"), packages=("com.example.app.",))
    cols = ["case_id", "fingerprint", "failure_class", "ref_id", "original_partition"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    assert got.count() == 30                                    # 40 deliveries of 30 distinct cases
    assert {r.original_partition for r in got.select("original_partition").collect()} == {2}
    # a second run over the same input is suppressed by the terminal table
    got.select("case_id").write.parquet(f"{base}/out/terminal")
    again = SP.evidence_batch(SP.decode_deadletters(spark.read.parquet(src)), None, F.lit("2024-01-02 00:00:00"),
                              terminal=spark.read.parquet(f"{base}/out/terminal"))
    assert again.count() == 0


def test_group_upsert_counts_distinct_cases(spark):
    base = tempfile.mkdtemp(prefix="logsift-groups-")
    schema = "case_id string, seq long, fingerprint string, signature string, failure_class string, " \
             "business_code string, verdict string, seen_at long"
    b1 = spark.createDataFrame([("c1", 1, "f", "s", "A", None, "CORROBORATED", 1),
                                ("c2", 2, "f", "s", "A", None, "PARTIAL", 2)], schema)
    b2 = spark.createDataFrame([("c2", 3, "f", "s", "A", None, "PARTIAL", 3),          # redelivery
                                ("c3", 4, "g", "t", "B", None, "UNVERIFIABLE", 4)], schema)
    SP.update_groups(spark, f"{base}/cases", f"{base}/groups", b1, 0)
    SP.update_groups(spark, f"{base}/cases", f"{base}/groups", b2, 1)
    g = {r.fingerprint: r.occurrence_count for r in SP.current_groups(spark, f"{base}/groups").collect()}
    assert g == {"f": 2, "g": 1}


def test_capture_once(spark):
    base = tempfile.mkdtemp(prefix="logsift-snap-")
    first = spark.createDataFrame([("a", "v1"), ("b", "v1")], "flow_id string, body string")
    second = spark.createDataFrame([("a", "v2"), ("c", "v2")], "flow_id string, body string")
    SP.capture_snapshots(spark, f"{base}/snap", first, 0)
    served = SP.capture_snapshots(spark, f"{base}/snap", second, 1)
    assert sorted(map(tuple, served.select("flow_id", "body").collect())) == [("a", "v1"), ("c", "v2")]


def test_status_fold_and_sweep(spark):
    ev = spark.createDataFrame([
        ("a", "2024-01-01 00:00:00", "LOGS_FETCHED"), ("a", "2024-01-01 00:01:00", "IN_PROGRESS"),
        ("a", "2024-01-01 00:02:00", "LOGS_FETCHED"),
        ("b", "2024-01-01 00:00:00", "IN_PROGRESS"), ("b", "2024-01-01 00:01:00", "FAILED_TIMEOUT"),
        ("b", "2024-01-01 00:05:00", "COMPLETED"),
        ("c", "2024-01-01 00:00:00", "IN_PROGRESS"), ("c", "2024-01-01 00:09:00", "REJECTED"),
    ], "case_id string, status_at string, status string").withColumn("status_at", F.col("status_at").cast("timestamp"))
    cur = {r.case_id: r.status for r in fold_status(ev).collect()}
    assert cur == {"a": "IN_PROGRESS", "b": "FAILED_TIMEOUT", "c": "REJECTED"}
    swept = sweep_stale(fold_status(ev), F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()
    assert [(r.case_id, r.status) for r in swept] == [("a", "FAILED_TIMEOUT")]


def test_ingest_survives_redelivery_broken_headers_and_missing_coordinates(spark):
    base = tempfile.mkdtemp(prefix="logsift-safe-")
    src = f"{base}/src"

    def record(offset, headers=(), topic="dlt", value=b"mail someone@example.org now", key=b"k-000000001"):
        return (key, value, topic, 0, offset, None, [("kafka_exception-message", b"call 9876543210 or x@example.org"), *headers])

    def run():
        stream = SP.decode_deadletters(spark.readStream.schema(SP.KAFKA_SCHEMA).parquet(src))
        SP.start_deadletter_ingest(stream, f"{base}/out", f"{base}/ckpt", now_fn=lambda: "2024-01-02 00:00:00").awaitTermination(300)

    spark.createDataFrame([record(1), record(2, [("weird", b"\xff\xfe not utf-8")]), record(3, topic=None)],
                          SP.KAFKA_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([record(2), record(4, key=b"\xff\xfe", value=b"\xff")], SP.KAFKA_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(f"{base}/out/evidence")
    assert sorted(r.case_id for r in got.collect()) == ["dlt-dlt-0-1", "dlt-dlt-0-2", "dlt-dlt-0-4"]
    assert spark.read.parquet(f"{base}/out/rejects").count() == 1
    stored = " ".join(str(r.asDict()) for t in ("evidence", "rejects") for r in spark.read.parquet(f"{base}/out/{t}").collect())
    assert "example.org" not in stored and "9876543210" not in stored


def test_a_late_ignored_event_does_not_renew_the_age(spark):
    ev = spark.createDataFrame([("a", "2024-01-01 00:01:00", "IN_PROGRESS"), ("a", "2024-01-01 01:00:00", "LOGS_FETCHED")],
                               "case_id string, status_at string, status string").withColumn("status_at", F.col("status_at").cast("timestamp"))
    assert sweep_stale(fold_status(ev), F.lit("2024-01-01 01:10:00").cast("timestamp")).count() == 1


def test_read_table_hides_only_a_missing_table(spark):
    import pytest
    from logsift.sources.sinks import read_table
    base = tempfile.mkdtemp(prefix="logsift-read-")
    assert read_table(spark, f"{base}/none") is None
    with open(f"{base}/broken.parquet", "wb") as f:
        f.write(b"not parquet")
    with pytest.raises(Exception):
        read_table(spark, f"{base}/broken.parquet").count()
