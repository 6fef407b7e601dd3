import json
import os
import tempfile

from pyspark.sql import functions as F

from logsift.operators import catalogs as CA
from logsift.operators import fetch as FE
from logsift.operators import pods as PO


def _tree():
    root = tempfile.mkdtemp(prefix="logsift-pods-")
    files = {
        "ns1/app-1/current.log": ["2024-01-01T00:00:01Z line a ref-ABC123", "", "2024-01-01T00:00:02Z line b"],
        "ns1/app-1/previous.log": ["2024-01-01T00:00:00Z old line"],
        "ns1/app-2/current.log": ["2024-01-01T00:00:03Z other"],
    }
    for path, lines in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write("\n".join(lines) + "\n")
    with open(f"{root}/ns1/app-1/meta.json", "w") as f:
        json.dump({"phase": "Running", "start_time": "2024-01-01T00:00:00Z", "labels": {"app": "app"},
                   "containers": ["app", "istio-proxy"], "restart_counts": {"app": 2}}, f, indent=2)
    with open(f"{root}/ns1/app-2/meta.json", "w") as f:
        json.dump({"phase": "Pending"}, f)
    return root


def test_read_pod_logs_and_meta(spark):
    root = _tree()
    lines = PO.number_lines(PO.read_pod_logs(spark, root))
    got = sorted((r.pod, r.instance, r.line_no, r.line) for r in lines.collect())
    assert got == [("app-1", "current", 1, "2024-01-01T00:00:01Z line a ref-ABC123"),
                   ("app-1", "current", 2, "2024-01-01T00:00:02Z line b"),
                   ("app-1", "previous", 1, "2024-01-01T00:00:00Z old line"),
                   ("app-2", "current", 1, "2024-01-01T00:00:03Z other")]
    meta = PO.read_pod_meta(spark, root)
    cont = PO.eligible_containers(meta)
    assert sorted((r.pod, r.container, r.restart_count) for r in cont.collect()) == [("app-1", "app", 2)]


def test_sidecar_only_pod_keeps_all_and_caps(spark):
    pods = spark.createDataFrame([
        ("ns", "svc-a-1", "Running", "2024-01-02 00:00:00", ["istio-proxy"]),
        ("ns", "svc-a-2", "Running", "2024-01-03 00:00:00", ["app"]),
        ("ns", "svc-a-3", "Running", None, ["app"]),
        ("ns", "svc-b-1", "Running", "2024-01-01 00:00:00", ["app"]),
    ], "namespace string, pod string, phase string, start_time string, containers array<string>") \
        .withColumn("start_time", F.col("start_time").cast("timestamp")) \
        .withColumn("labels", F.create_map().cast("map<string,string>")) \
        .withColumn("restart_counts", F.create_map().cast("map<string,int>"))
    svc = spark.createDataFrame([("svc-a", 0, "ns", "name_contains", "svc-a"), ("svc-b", 1, "ns", "name_contains", "svc-")],
                                "service string, ord int, namespace string, mode string, value string") \
        .withColumn("selector", F.lit(None).cast("map<string,string>"))
    cont = PO.eligible_containers(pods)
    assert {(r.pod, r.container) for r in cont.collect()} >= {("svc-a-1", "istio-proxy")}
    kept, gaps = PO.cap_per_service(PO.match_services(svc, cont), 2)
    order = {(r.service, r.pod): r["rank"] for r in kept.collect()}
    assert order[("svc-a", "svc-a-2")] == 1 and order[("svc-a", "svc-a-1")] == 2 and ("svc-a", "svc-a-3") not in order
    assert {r.service for r in gaps.collect()} == {"svc-a", "svc-b"}
    # svc-b matches every pod ("svc-" prefix); duplicates are kept once at
    # their first round-robin position, then the total cap applies
    merged = PO.merge_round_robin(kept, total_cap=2).select("pod", "merge_pos").distinct().collect()
    assert sorted((r.merge_pos, r.pod) for r in merged) == [(1, "svc-a-2"), (2, "svc-a-1")]


def test_match_context_and_byte_cap(spark):
    lines = spark.createDataFrame([("f", 0, i, f"line {i}" + (" id-XYZ9" if i in (10, 40) else "")) for i in range(60)],
                                  "file string, chunk int, pos int, line string")
    lines = PO.number_lines(lines)
    ids = spark.createDataFrame([("flowA", "id-XYZ9"), ("flowB", "nothing-here")], "flow_id string, identifier string")
    m = PO.match_ids(lines, ids)
    ctx = PO.match_context(lines, m.join(lines.select("file", "line_no"), ["file", "line_no"]))
    got = sorted(r.line_no for r in ctx.collect())
    assert got == list(range(6, 32)) + list(range(36, 61))
    kept, gaps = PO.byte_cap(lines, cap=100)
    assert kept.agg(F.sum(F.octet_length("line") + 1)).collect()[0][0] <= 100 and gaps.count() == 1


def test_gaps_and_banner(spark):
    oldest = spark.createDataFrame([("f1", "2024-01-01T01:00:00Z", None), ("f2", "2024-01-01T00:00:30Z", None),
                                    ("f3", "2024-01-01T01:00:00Z", "2024-01-01 00:59:30")],
                                   "flow_id string, oldest_line string, earliest_start string") \
        .withColumn("earliest_start", F.col("earliest_start").cast("timestamp"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rot = {r.flow_id for r in PO.rotation_gaps(oldest, start).collect()}
    assert rot == {"f1"}
    q = spark.createDataFrame([("p", 10, 0.9), ("q", 10, 0.5), ("r", 0, 1.0)], "pod string, total long, level_failure_rate double")
    assert [r.pod for r in PO.parse_degraded_gaps(q).collect()] == ["p"]
    g = spark.createDataFrame([("x", 1, "TRUNCATED", "a"), ("x", 2, "TRUNCATED", "a"), ("x", 3, "POD_REPLACED", "b")],
                              "flow_id string, seq int, gap_type string, detail string")
    b = PO.render_banner(PO.dedupe_gaps(g)).collect()[0].banner
    assert b == PO.BANNER_HEADER + "\nTRUNCATED: a\nPOD_REPLACED: b\n" + PO.BANNER_FOOTER


def test_source_chain(spark):
    res = spark.createDataFrame([("a", "kubernetes", 1, False, 0), ("a", "elastic", 2, True, 5),
                                 ("b", "kubernetes", 1, True, 3), ("b", "elastic", 2, True, 9),
                                 ("c", "kubernetes", 1, True, 0), ("d", "kubernetes", 1, True, 0),
                                 ("d", "elastic", 2, True, 0)], "flow_id string, source string, priority int, ok boolean, records long")
    out = {r.flow_id: (r.source, r.has_records, r.fallback_gap) for r in FE.source_chain(res).collect()}
    assert out["a"] == ("elastic", True, "tried kubernetes (failed) first without success; the trace below came from elastic.")
    assert out["b"] == ("kubernetes", True, None)
    assert out["c"] == ("kubernetes", False, None)
    assert out["d"][2] == "no source returned logs; tried kubernetes (returned no records), elastic (returned no records)."


def test_catalog_aliases_and_drift(spark):
    raw = spark.createDataFrame([("C1", "first", "TECHNICAL_EXCEPTION", 1), ("C1", "second", "", 2), ("C2", "x", "", 3)],
                                "`﻿Reason_Code` string, Desc string, Category string, _row int")
    cat = {r.code: (r.description, r.category) for r in CA.normalise_catalog(raw).collect()}
    assert cat == {"C1": ("second", ""), "C2": ("x", "")}
    assert tuple(CA.schema_drift(spark, ["a", "B ", "extra"], ["a", "b", "c"]).first()) == ("DRIFT", False, ["extra"], ["c"])
    assert tuple(CA.schema_drift(spark, ["a"], ["a", "b"], "b").first()) == ("SINGLE_COLUMN", True, [], [])
    assert CA.schema_drift(spark, ["a", "b"], ["b", "a"]).first()["status"] == "OK"


def test_match_ids_odd_identifiers_exact(spark):
    lines = spark.createDataFrame([(1, "user ab c-12345 done"), (2, "xyz"), (3, "has a b inside"), (4, "glued ID-777x")],
                                  "line_no int, line string")
    ids = spark.createDataFrame([("f1", "ab c-12345"), ("f2", "a b"), ("f3", "ID-777x"), ("f4", "ID-777")],
                                "flow_id string, identifier string")
    got = sorted((r.flow_id, r.line_no) for r in PO.match_ids(lines, ids, key=("line_no",)).collect())
    assert got == [("f1", 1), ("f2", 3), ("f3", 4), ("f4", 4)]


def test_match_ids_is_plain_containment(spark):
    texts = ["ref 123456789012 ok", "(123456789012)", "failed for 123456789012.", "id:123456789012:failed", "svc-123456789012 x",
             "run91234567890127", "12345678901", "x 42", "a.b", "", None, "é123456789012é", "REF AbC-9 end"]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_no int, line string")
    idents = ["123456789012", "42", "3", ".", "9012.", "abc-9", "AbC-9", "", None, "é1", "nowhere at all"]
    ids = spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(idents)], "flow_id string, identifier string")
    for exact in (True, False):
        low = (lambda x: x) if exact else str.lower
        want = sorted((f"f{i}", n) for i, x in enumerate(idents) if x for n, t in enumerate(texts) if t and low(x) in low(t))
        got = sorted((r.flow_id, r.line_no) for r in PO.match_ids(lines, ids, key=("line_no",), case_sensitive=exact).collect())
        assert got == want


def test_configured_services_and_catalog_health(spark):
    svc = PO.configured_services(spark, "  ", " b, a ,b,, c", "x")
    assert [(r.service, r.ord) for r in svc.collect()] == [("b", 0), ("a", 1), ("c", 2)]
    assert [r.service for r in PO.configured_services(spark, None, "", default="d").collect()] == ["d"]
    from logsift.operators.templates import catalog_health
    cat = spark.createDataFrame([("t1", "boilerplate"), ("t2", "informative"), ("t3", "boilerplate")],
                                "template_id string, classification string")
    h = catalog_health(cat).collect()[0]
    assert h.boilerplate == 2 and h.warn is True


def test_codes_from_source_context_and_merge(spark):
    src = [
        '// ## Intake :: DONE',
        '// Business checks',
        '    A_CODE("A_CODE", "first", ReasonCategory.BUSINESS_EXCEPTION),',
        '//    B_CODE("B_CODE", "commented", ReasonCategory.TECHNICAL_EXCEPTION),',
        '    C_CODE("C_CODE", "tech", ErrorReasonCategory.TECHNICAL_EXCEPTION),',
        '    A_CODE("A_CODE", "second", ReasonCategory.BUSINESS_VALIDATION_ERROR),',
        '    private static Map tempMap = new HashMap<>();',
        '// Data access',
        '        tempMap.put(12001, new ReasonCode("D_CODE", "data"));',
        '        tempMap.put(17002, new ReasonCode("A_CODE", "again"));',
        '        tempMap.put(23003, new ReasonCode("E_CODE", "unknown range"));',
        '//        tempMap.put(37004, new ReasonCode("F_CODE", "commented"));',
    ]
    df = spark.createDataFrame([("S.java", i, l) for i, l in enumerate(src)], "file string, line_no int, line string")
    out = {r.code: r for r in CA.codes_from_source(df).collect()}
    assert set(out) == {"A_CODE", "C_CODE", "D_CODE", "E_CODE"}
    a = out["A_CODE"]
    assert (a.description, a.category, a.category_source, a.failure_class, a.stage, a.section, a.numeric_id) == \
        ("second", "BUSINESS_VALIDATION_ERROR", "declared", "A", "Intake", "Business checks", "17002")
    assert (out["C_CODE"].failure_class, out["C_CODE"].numeric_id) == ("C", "")
    d = out["D_CODE"]
    assert (d.category, d.category_source, d.failure_class, d.stage, d.section) == \
        ("TECHNICAL_EXCEPTION", "inferred", "C", "", "Data access")
    assert (out["E_CODE"].category, out["E_CODE"].category_source) == ("", "")


def test_match_ids_picks_rare_grams_and_shuffles_candidates_only(spark):
    """Identifiers with one prefix and one suffix, which every line holds too:
    only their middles tell them apart."""
    ids_data = [(f"f{i % 7}", f"PREFIX-0000-{i:05d}-SUFFIX-9999") for i in range(200)] + [("f1", "k9"), ("f2", None), ("f3", "")]
    text = lambda i: f"PREFIX-0000-none SUFFIX-9999 line {i} " + (f"PREFIX-0000-{i:05d}-SUFFIX-9999 end" if i % 50 == 0 else "")
    data = [(i, text(i)) for i in range(3000)] + [(3000, None), (3001, ""), (3002, "xk9y " * 20000)]
    lines = spark.createDataFrame(data, "line_no int, line string").repartition(6)
    ids = spark.createDataFrame(ids_data, "flow_id string, identifier string")
    want = sorted({(f, n) for f, i in ids_data if i for n, t in data if t and i in t})
    assert {n for _, n in want} == {0, 50, 100, 150, 3002}
    for bits in (1 << 24, 64):                     # a filter that lets everything through changes nothing
        got = sorted((r.flow_id, r.line_no) for r in PO.id_hits(lines, ids, key=("line_no",), filter_bits=bits).collect())
        assert got == want
    from logsift.operators.sift import sift
    lengths = spark.sql("SELECT array(8) AS _lengths")
    grams = spark.createDataFrame([("0-00050-",), ("0-00100-",)], "_gram string")
    made = PO._line_grams(lines, lengths, F.col("line"), "line", ["line_no"])
    assert made.count() > 90_000 and sift(made, grams, "_gram").count() <= 10


def test_match_ids_empty_sides(spark):
    lines = spark.createDataFrame([], "line_no int, line string")
    ids = spark.createDataFrame([], "flow_id string, identifier string")
    one_id = spark.createDataFrame([("f", "abc")], "flow_id string, identifier string")
    one_line = spark.createDataFrame([(1, "xabcx")], "line_no int, line string")
    for left, right, n in ((lines, ids, 0), (lines, one_id, 0), (one_line, ids, 0), (one_line, one_id, 1)):
        assert PO.match_ids(left, right, key=("line_no",)).count() == n


def test_trace_order_spreads_a_hot_flow(spark):
    data = [("hot" if i % 10 else f"f{i}", f"2024-01-01T00:{i % 60:02d}:00Z", "previous" if i % 3 else "current", "a.log", i)
            for i in range(4000)]
    rec = spark.createDataFrame(data, "flow_id string, timestamp string, instance string, file string, line_no int")
    joining = "spark.sql.adaptive.coalescePartitions.enabled"      # small partitions would be joined again
    before = spark.conf.get(joining)
    spark.conf.set(joining, "false")
    try:
        out = PO.trace_order(rec).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(joining, before)
    want = sorted(data, key=lambda r: (r[0], r[1], r[2] == "current", r[3], r[4]))
    assert [tuple(r)[:5] for r in out] == want
    hot = [r.part for r in out if r.flow_id == "hot"]
    assert max(hot.count(p) for p in set(hot)) < 0.6 * len(hot)
