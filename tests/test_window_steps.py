"""Case windows meet log lines within steps of time."""

from logsift.operators.corroborate import window_lines

CASES = [("a", "k", 0, 10), ("b", "k", 95, 320), ("c", "k", 100, 100), ("d", "other", 0, 900), ("e", None, 0, 900),
         ("f", "k", None, 900), ("g", "k", 50, 40), ("h", "k", 0, 900)]
LINES = [("k", t, n) for n, t in enumerate([0, 10, 11, 99, 100, 100, 101, 299, 300, 320, 321, None])]


def test_window_lines_by_step(spark):
    cases = spark.createDataFrame(CASES, "case_id string, ref_id string, s int, e int").selectExpr(
        "case_id", "ref_id", "timestamp_seconds(s) AS window_start", "timestamp_seconds(e) AS window_end")
    lines = spark.createDataFrame(LINES, "ref_id string, t int, line_id int").selectExpr(
        "ref_id", "timestamp_seconds(t) AS ts", "line_id")
    wanted = sorted((c, n) for c, k, s, e in CASES for r, t, n in LINES
                    if k == r and None not in (s, e, t) and s <= t <= e)
    for step in (7, 100, 3600):
        met = window_lines(cases, lines, step_seconds=step)
        assert sorted((r.case_id, r.line_id) for r in met.collect()) == wanted
        assert set(met.columns) == {"case_id", "ref_id", "ts", "line_id"}
