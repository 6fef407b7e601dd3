import random

from pyspark.sql import functions as F

from helpers import rows
from logsift.operators import corroborate as C
from logsift.operators import groups as G
from logsift.operators import outcomes as O
from logsift.operators import policy as P
from logsift.operators import templates as TM


def test_corroboration_verdicts(spark):
    cases = spark.createDataFrame([
        (1, "com.x.FooException", "CODE_A", ["com.x.Svc.run"], False),
        (2, "com.x.FooException", None, [], False),
        (3, "com.x.FooException", None, [], False),
        (4, "com.x.FooException", None, [], False),
        (5, "com.x.FooException", None, [], True),
        (6, "com.x.FooException", None, [], False),
        (7, "com.x.FooException", None, [], False),
    ], "case_id int, root_fqcn string, business_code string, frames array<string>, fetch_skipped boolean")
    lines = spark.createDataFrame([
        (1, 1, 1, "ERROR failed FooException in run"),
        (2, 1, 1, "ERROR com.x.FooException then org.y.BarException: boom"),
        (3, 1, 1, "FATAL org.y.BarException: boom"),
        (4, 1, 1, "INFO all fine"),
        (6, 1, 1, "ERROR something without a name"),
    ], "case_id int, ts int, line_id int, line string")
    out = {r.case_id: (r.verdict, r.matched_on, list(r.unexplained), r.could_not_look, r.error_lines_seen)
           for r in C.corroborate(cases, lines).collect()}
    assert out[1] == ("CORROBORATED", "simple name", [], False, 1)
    assert out[2] == ("PARTIAL", "fqcn", ["org.y.BarException"], False, 1)
    assert out[3] == ("CONTRADICTED", None, ["org.y.BarException"], False, 1)
    assert out[4][0] == "UNVERIFIABLE" and out[4][4] == 0
    assert out[5][0] == "UNVERIFIABLE" and out[5][3] is True
    assert out[6][0] == "UNVERIFIABLE" and out[6][4] == 1
    assert out[7][0] == "UNVERIFIABLE" and out[7][3] is False


def _sequential(cases):
    """Reference-style sequential replay of the reuse policy."""
    has_rec, out = {}, {}
    for c in sorted(cases, key=lambda x: (x[1], x[0])):
        cid, seq, fp, cls, verdict, ok = c
        if cls != "A":
            d = "CANNED"
        elif verdict in ("CONTRADICTED", "PARTIAL") or not has_rec.get(fp):
            d = "LLM_REQUIRED"
        else:
            d = "REUSE_GROUP"
        if d == "LLM_REQUIRED" and ok:
            has_rec[fp] = True
        out[cid] = d
    return out


def test_reuse_decisions_match_sequential_replay(spark):
    rnd = random.Random(11)
    for _ in range(3):
        cases = [(i, rnd.randint(0, 10 ** 6), f"fp{rnd.randint(0, 3)}", rnd.choice("AAAB"),
                  rnd.choice(["CORROBORATED", "PARTIAL", "UNVERIFIABLE", "CONTRADICTED"]), rnd.random() < 0.5)
                 for i in range(80)]
        df = spark.createDataFrame(cases, "case_id int, seq long, fingerprint string, failure_class string, "
                                          "verdict string, agent_ok boolean").withColumn("bucket", (F.col("seq") / 100000).cast("long"))
        got = {r.case_id: r.decision for r in G.reuse_decisions(df, "seq").collect()}
        assert got == _sequential(cases)
        occ = {r.case_id: r.occurrence for r in G.occurrence_numbers(df, "seq").collect()}
        for cid, seq, fp, *_ in cases:
            assert occ[cid] == sum(1 for c in cases if c[2] == fp and (c[1], c[0]) <= (seq, cid))


def test_group_rollup_members_capped_newest(spark):
    data = [(f"c{i:03d}", i, "fp", "sig", "A", None, "CORROBORATED" if i % 2 else "PARTIAL") for i in range(250)]
    df = spark.createDataFrame(data, "case_id string, seq long, fingerprint string, signature string, "
                                     "failure_class string, business_code string, verdict string") \
        .withColumn("seen_at", F.col("seq"))
    g = G.group_rollup(df, seq="seq").collect()[0]
    assert g.occurrence_count == 250 and len(g.members) == 200
    assert g.members[0] == "c050" and g.members[-1] == "c249"
    assert dict(g.corroboration_history) == {"CORROBORATED": 125, "PARTIAL": 125}


def test_confidence_ceilings_and_replay_gate(spark):
    df = spark.createDataFrame([
        ("A", "CORROBORATED", "desc", 0.9, "REDRIVE_AFTER_RECOVERY", True, "r1"),
        ("A", "UNVERIFIABLE", None, 0.9, "REDRIVE_AFTER_RECOVERY", False, "r1"),
        ("B", "CONTRADICTED", None, None, "NO_ACTION", False, "r1"),
        ("A", "CORROBORATED", "d", 0.56, "REDRIVE_AFTER_RECOVERY", False, None),
    ], "failure_class string, verdict string, registry_description string, confidence double, action string, "
       "reused boolean, ref_id string").withColumn("has_gap", F.lit(False))
    out = P.replay_gate(P.dlt_confidence(df)).collect()
    assert abs(out[0].final_confidence - 0.855) < 1e-12 and list(out[0].ceilings_applied) == ["reuse_decay"]
    assert out[0].should_replay and out[0].replay_reason.endswith("at confidence 0.85 clears the 0.55 threshold")
    assert out[1].final_confidence == 0.5 and list(out[1].ceilings_applied) == ["unverifiable", "registry_miss"]
    assert out[2].final_confidence is None and out[2].final_action == "NEEDS_MANUAL_REVIEW"
    assert list(out[2].ceilings_applied) == ["class_b", "contradicted"]
    assert not out[3].should_replay and out[3].replay_reason.startswith("no refId")


def test_templates_every_message_once_and_matching(spark):
    msgs = ["user 12 logged in from 10.0.0.1", "user 99 logged in from 10.0.0.7", "payment 5 failed: timeout",
            "payment 8 failed: declined", "completely different line here", "user 12 logged in from 10.0.0.1"]
    lines = spark.createDataFrame([(f"f{i % 2}", i, str(i), m) for i, m in enumerate(msgs)],
                                  "flow_id string, seq long, timestamp string, message string")
    mined = TM.mine_templates(lines)
    assigned = TM.assign_templates(lines, mined).collect()
    assert len(assigned) == len(msgs) and all(r.template_id for r in assigned)
    import re
    for r in assigned:
        masked = r.message
        toks, tpl = re.sub(r"\d+(?:[.,:]\d+)*", "<NUM>", masked).split(" "), r.template.split(" ")
        assert len(toks) == len(tpl) and all(t == "<*>" or t == s for t, s in zip(tpl, toks))
    cl = TM.flow_clusters(TM.assign_templates(lines, mined))
    per_flow = {(r.flow_id, r.template_id): r["count"] for r in cl.collect()}
    assert sum(per_flow.values()) == len(msgs)           # no flow sees another flow's counts


def test_accuracy_half_even_and_partial(spark):
    data = [("e%d" % i, "RC", "NEW", "agent", v) for i, v in
            enumerate(["CORRECT"] * 1 + ["INCORRECT"] * 15 + ["PARTIAL"] * 16)]
    df = spark.createDataFrame(data, "event_id string, reason_code string, enrolment_type string, "
                                     "resolution_source string, verdict string")
    r = O.accuracy(df).collect()[0]
    assert r.total == 32 and r.accuracy == 0.0312                # 1/32 = 0.03125 -> half-even


def test_py_fixed_matches_python(spark):
    from logsift.functions.text import py_fixed
    vals = [0.855, 0.125, 0.135, 0.285, 0.295, 0.5, 0.0, 1.0] + [random.Random(2).random() for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r[0] for r in df.select(py_fixed(F.col("x"), 2)).collect()] == [f"{v:.2f}" for v in vals]
