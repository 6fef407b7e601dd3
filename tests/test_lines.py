from pyspark.sql import functions as F

from helpers import rows
from logsift.functions.levels import normalise_level
from logsift.operators import lines as L
from logsift.operators.records import prepare_records, redaction_totals


def test_normalise_level(spark):
    df = spark.createDataFrame([("warning",), (" Fatal ",), ("CRITICAL",), ("severe",), ("info",), ("nope",), ("",),
                                (None,)], "x string")
    got = [r[0] for r in df.select(normalise_level(F.col("x"))).collect()]
    assert got == ["WARN", "ERROR", "ERROR", "ERROR", "INFO", None, None, None]


def test_parse_json_plain_and_kubelet(spark):
    data = [
        ('2024-05-01T10:00:00.123456789Z {"severity":"warning","msg":"hello","service":"svc","ts":"x"}',),
        ('{"level":"","lvl":"error","message":"","log":"boom","app":""}',),
        ("2024-05-01T10:00:01Z ERROR something failed",),
        ("plain text without level ERRORS_TOTAL=0",),
        ("   ",),
        ('2024-05-01T10:00:02+05:30 [1,2,3]',),
        ("x" * 85 + " ERROR late",),
    ]
    df = L.parse_log_lines(spark.createDataFrame(data, "line string"), default_app="dflt")
    got = rows(df, "timestamp", "level", "message", "app_name", "level_parsed", "was_json")
    assert got[0] == ("2024-05-01T10:00:00.123456789Z", "WARN", "hello", "svc", True, True)
    assert got[1] == ("", "ERROR", "boom", "dflt", True, True)
    assert got[2] == ("2024-05-01T10:00:01Z", "ERROR", "ERROR something failed", "dflt", True, False)
    assert got[3][1:5] == ("INFO", "plain text without level ERRORS_TOTAL=0", "dflt", False)
    assert got[4] == ("2024-05-01T10:00:02+05:30", "INFO", "[1,2,3]", "dflt", False, False)
    assert got[5][1] == "INFO" and got[5][4] is False        # level word beyond the first 80 chars
    assert len(got) == 6                                       # blank line dropped


def test_parse_quality_counters(spark):
    data = [("ERROR a",), ("nothing",), ('{"level":"info","message":"m"}',)]
    q = L.parse_quality(L.parse_log_lines(spark.createDataFrame(data, "line string")))
    r = q.collect()[0]
    assert (r.total, r.level_parsed, r.json_lines) == (3, 2, 1)
    assert abs(r.level_failure_rate - 1 / 3) < 1e-12 and abs(r.json_ratio - 1 / 3) < 1e-12


def test_redaction_patterns_order_and_allowlist(spark):
    data = [("f1", "123456789012", "vid 9999888877776666 aadhaar 2345 6789 0123 ref 123456789012 mob 9876543210 "
             "mail a.b@x.io plain 234567890123")]
    df = spark.createDataFrame(data, "flow_id string, ref_id string, message string").withColumn("level_raw", F.lit("info"))
    out = prepare_records(df, allow=("ref_id",)).collect()[0]
    assert out.message == ("vid [REDACTED:VID] aadhaar [REDACTED:AADHAAR] ref 123456789012 mob [REDACTED:MOBILE] "
                           "mail [REDACTED:EMAIL] plain [REDACTED:AADHAAR]")
    assert dict(out.redactions) == {"VID": 1, "AADHAAR": 2, "MOBILE": 1, "EMAIL": 1}
    tot = {r.label: r.redacted for r in redaction_totals(prepare_records(df, allow=("ref_id",))).collect()}
    assert tot == {"VID": 1, "AADHAAR": 2, "MOBILE": 1, "EMAIL": 1}


def test_custom_patterns_invalid_ignored(spark):
    from logsift.functions.redact import parse_extra_patterns
    assert parse_extra_patterns("SECRET-\\d+|||(bad|||  ") == [("CUSTOM", "SECRET-\\d+")]
    df = spark.createDataFrame([("f", "key SECRET-42 here")], "flow_id string, message string") \
        .withColumn("level_raw", F.lit("x"))
    out = prepare_records(df, extra_patterns="SECRET-\\d+|||(bad").collect()[0]
    assert out.message == "key [REDACTED:CUSTOM] here" and out.level == "INFO"


def test_dump_normaliser_carry_and_preamble(spark):
    data = [("a.log", 0, 0, "preamble line"),
            ("a.log", 0, 1, '{"@timestamp":"2024-01-01T00:00:00Z","message":"m","app":"App_X","HOSTNAME":"Pod.One"}'),
            ("a.log", 0, 2, "  continuation"),
            ("a.log", 1, 3, "2024-01-01T00:00:05Z kubelet body"),
            ("b.log", 0, 0, "[2024-01-01T00:00:09+05:30], dated plain"),
            ("b.log", 0, 1, "undated")]
    df = spark.createDataFrame(data, "file string, chunk int, line_no int, line string")
    out = rows(L.normalise_dump(df).orderBy("file", "line_no"), "file", "format", "timestamp", "pod", "app")
    assert out == [("a.log", "json", "2024-01-01T00:00:00Z", "pod.one", "app-x"),
                   ("a.log", "plain", "2024-01-01T00:00:00Z", "pod.one", "app-x"),
                   ("a.log", "kubelet", "2024-01-01T00:00:05Z", "pod.one", "app-x"),
                   ("b.log", "plain-dated", "2024-01-01T00:00:09+05:30", "unknown-service-offline-0", "unknown-service"),
                   ("b.log", "plain", "2024-01-01T00:00:09+05:30", "unknown-service-offline-0", "unknown-service")]


def test_normalise_timestamp(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00.123456789Z",), ("2024-01-01 10:00:00",), ("garbage",), ("",)],
                               "x string")
    got = [r[0] for r in df.select(L.normalise_timestamp(F.col("x"))).collect()]
    assert got == ["2024-01-01T00:00:00.123456789Z", "2024-01-01T10:00:00+00:00", "", ""]
