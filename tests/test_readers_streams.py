import tempfile

from pyspark.sql import functions as F

from logsift.operators import intake as I
from logsift.sources import readers as RD
from logsift.streaming import pipelines as SP


def test_export_records_and_rejects(spark):
    lines = spark.createDataFrame([
        ('"@timestamp","message"',),
        ('"Jul 31, 2026 @ 01:54:25.000","{""@timestamp"":""2026-07-31T01:54:25Z"",""level"":""ERROR"",'
         '""message"":""boom"",""application_name"":""svc""}"',),
        ('"Jul 31, 2026","{""broken"": }"',),
        ('"x","{""message"":""only message""}"',),
    ], "value string")
    rec, rej = RD.export_records(lines)
    assert sorted(map(tuple, rec.collect())) == [("2026-07-31T01:54:25Z", "ERROR", "boom", "svc"),
                                                 ("UNKNOWN_TIME", "INFO", "only message", "unknown-service")]
    assert rej.count() == 1


def test_newest_per_partition(spark):
    df = spark.createDataFrame([(p, o) for p in range(3) for o in range(10)], "partition int, offset int")
    got = RD.newest_per_partition(df, limit=5, partitions=3).collect()
    assert len(got) == 5 and all(r.offset >= 8 for r in got)          # ceil(5/3) = 2 newest per partition


def test_resident_lookup_srn_first(spark):
    keys = spark.createDataFrame([("S1", "U9"), ("S404", "U2"), (None, "U404")], "srn string, uid string")
    res = spark.createDataFrame([("S1", "U1", "a"), ("S2", "U2", "b")], "srn string, uid string, name string")
    got = {(r.srn, r.uid): (r.matched_by, r.r_name) for r in I.lookup_residents(keys, res).collect()}
    assert got == {("S1", "U9"): ("srn", "a"), ("S404", "U2"): ("uid", "b"), (None, "U404"): (None, None)}


def test_rejection_stream_splits_good_and_poison(spark):
    base = tempfile.mkdtemp(prefix="logsift-rej-")
    vals = ['{"eventId":"E1","packetExecutionSummary":{"packetStatus":"REJECTED","errorData":[]}}',
            '{"eventId":"E1","packetExecutionSummary":{"packetStatus":"REJECTED","errorData":[]}}',
            '{"eventId":"E2","packetExecutionSummary":{"packetStatus":"SUCCESS"}}',
            'not json', '{"eventId":"bad id/../"}']
    spark.createDataFrame([(v,) for v in vals], "value string").write.parquet(f"{base}/src")
    q = SP.start_rejection_ingest(spark.readStream.schema("value string").parquet(f"{base}/src"), f"{base}/out",
                                  f"{base}/ckpt")
    q.awaitTermination(300)
    assert spark.read.parquet(f"{base}/out/handoff").count() == 1
    assert spark.read.parquet(f"{base}/out/dlq").count() == 2
    assert [r.skip_reason for r in spark.read.parquet(f"{base}/out/skipped").collect()] == ["non-rejected packet"]


def test_unreadable_files_are_left_out_and_listed(spark):
    base = tempfile.mkdtemp(prefix="logsift-bad-")
    for name, text in (("good.json", '{"refid": "r1", "expected_outcome": "x"}'), ("bad.json", '{"refid": '), ("_skip.json", '{"refid": "no"}')):
        with open(f"{base}/{name}", "w") as f:
            f.write(text)
    cases = RD.read_eval_cases(spark, base)
    assert [r.refid for r in cases.collect()] == ["r1"] and cases.count() == 1
    bad = RD.unreadable(spark, base, RD.EVAL_SCHEMA).collect()
    assert len(bad) == 1 and bad[0].file.endswith("bad.json")
