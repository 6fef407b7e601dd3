import random

from pyspark.sql import functions as F

from logsift.operators import evidence as E


def _brute(lines, before, after):
    out = set()
    by = {}
    for f, ts, lid, lvl in lines:
        by.setdefault(f, []).append((ts, lid, lvl))
    for f, ls in by.items():
        ls.sort()
        err = [i for i, x in enumerate(ls) if x[2].upper() == "ERROR"]
        if not err:
            continue
        lo, hi = max(0, err[0] - before), min(len(ls), err[-1] + 1 + after)
        out |= {(f, x[1]) for x in ls[lo:hi]}
    return out


def test_error_context_matches_sequential(spark):
    rnd = random.Random(7)
    lines = []
    for f in range(12):
        n = rnd.randint(0, 40)
        for i in range(n):
            lvl = rnd.choice(["INFO"] * 8 + ["ERROR", "warn"])
            lines.append((f"f{f}", rnd.randint(0, 5), f * 1000 + i, lvl))
    df = spark.createDataFrame(lines, "flow_id string, ts int, line_id int, level string")
    for before, after in [(0, 0), (2, 3), (200, 200)]:
        got = {(r.flow_id, r.line_id) for r in E.error_context(df, before, after).collect()}
        assert got == _brute(lines, before, after)


def test_boundaries_and_routes(spark):
    data = [("a", 1, 1, "INFO", "first"), ("a", 2, 2, "INFO", "last"), ("b", 1, 3, "INFO", "only")]
    df = spark.createDataFrame(data, "flow_id string, ts int, line_id int, level string, message string")
    b = sorted((r.flow_id, r.boundary, r.message) for r in E.flow_boundaries(df).collect())
    assert b == [("a", "flow_boundary_first", "first"), ("a", "flow_boundary_last", "last"),
                 ("b", "flow_boundary_first", "only")]
    prof = E.route_flows(E.flow_profile(df), full_below=2)
    assert {r.flow_id: r.route for r in prof.collect()} == {"a": "reduced", "b": "full"}


def test_decision_vocabulary(spark):
    df = spark.createDataFrame([("Packet status changed",), ("nothing",), ("MAN_DEDUP hit",), ("Quality check FAILED",)],
                               "message string")
    assert [r.message for r in E.decision_lines(df).collect()] == ["Packet status changed", "MAN_DEDUP hit",
                                                                   "Quality check FAILED"]
