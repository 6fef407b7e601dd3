"""Runbooks are reduced to one a (code, type) before cases meet them."""

from logsift.operators.rules import match_runbooks, runbook_type  # noqa: F401

RES = "named_struct('rejection_description', 'd', 'synthesis', 's', 'action', act, 'resident_action', 'r') AS resolution"


def test_match_runbooks_many_runbooks_a_code(spark):
    books = [(f"RB{i:03d}", "C1", ["NEW", "ANY", " update ", None][i % 4], i % 3) for i in range(60)]
    rb = spark.createDataFrame(books, "runbook_id string, reason_code string, enrolment_type string, version int").selectExpr(
        "*", "runbook_id AS act", "'final' AS status", "'1.1' AS schema_version", "'f' AS rule_fingerprint") \
        .selectExpr("* except(act)", RES)
    cases = spark.createDataFrame(
        [("1", "C1", "new"), ("2", "C1", "OTHER"), ("3", "C1", None), ("4", "C2", "NEW"), ("5", None, "NEW"),
         (None, "C1", "NEW"), ("6", "C1", "OTHER"), ("6", "C1", "UPDATE"), ("7", "C1", "NEW"), ("7", "C1", "NEW")],
        "event_id string, reason_code string, enrolment_type string")
    out = match_runbooks(cases, rb)

    def best(kind):
        kinds = [b for b in books if (b[2] or "ANY").strip().upper() == kind]
        return min(kinds, key=lambda b: (-b[3], b[0]))[0]
    got = sorted((r.event_id or "", r.enrolment_type or "", r.runbook_id, r.runbook_action) for r in out.collect())
    new, any_, upd = best("NEW"), best("ANY"), best("UPDATE")
    assert got == sorted([("1", "new", new, new), ("2", "OTHER", any_, any_), ("3", "", any_, any_), ("4", "NEW", None, None),
                          ("5", "NEW", None, None), ("", "NEW", None, None), ("6", "OTHER", upd, upd), ("6", "UPDATE", upd, upd),
                          ("7", "NEW", new, new), ("7", "NEW", new, new)])
    # one row a (code, type): the runbooks are aggregated below the join
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_rb_code" in plan
