"""What the template steps move between tasks (F8, F9, F13, F16)."""

import pytest

from logsift.operators import templates as TM

LINES = [("a", 0, "0", "job 1 done"), ("a", 1, "1", "job 2 done"), ("a", 2, "2", "alone here in its leaf"),
         ("b", 0, "0", "job 7 done"), ("b", 1, "1", "x  y\tz"), ("b", 2, "2", None), ("c", 0, "0", "packet 5 Status OK"),
         ("c", 1, "1", "run ab cd ef"), ("c", 2, "2", "run ab cd gh"), ("c", 3, "3", "run ab cd ij")]


@pytest.fixture(scope="module")
def assigned(spark):
    lines = spark.createDataFrame(LINES, "flow_id string, seq long, timestamp string, message string")
    return TM.assign_templates(lines, TM.mine_templates(lines))


@pytest.fixture(scope="module")
def clusters(spark, assigned):
    full = TM.flow_clusters(assigned)
    return spark.createDataFrame(full.collect(), full.schema)


def flows(spark):
    return spark.createDataFrame([("a",), ("b",), ("c",)], "flow_id string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_without_a_mined_template_are_not_joined(assigned):
    assert "Union" in plan(assigned)
    assert {(r.flow_id, r.seq): r.template for r in assigned.collect()} == {
        ("a", 0): "job <NUM> done", ("a", 1): "job <NUM> done", ("a", 2): "alone here in its leaf", ("b", 0): "job <NUM> done",
        ("b", 1): "x y z", ("b", 2): "", ("c", 0): "packet <NUM> Status OK", ("c", 1): "run ab cd <*>",
        ("c", 2): "run ab cd <*>", ("c", 3): "run ab cd <*>"}


def test_small_leaves_have_one_part(spark):
    sizes = spark.createDataFrame([(2,), (999,), (1000,), (10 ** 9,)], "_n long")
    assert [r[0] for r in sizes.select(TM._parts(16)).collect()] == [1, 1, 2, 16]


def test_classes_alone_need_no_template_text(spark, clusters):
    cat = TM.template_catalog(clusters, flows(spark))
    assert "first(template" not in plan(cat.select("template_id", "classification"))
    assert {r.template: r.classification for r in cat.collect()}["packet <NUM> Status OK"] == "decision-marker"


def test_clusters_are_restored_from_their_brief_form(clusters):
    brief = TM.brief(clusters)
    assert {r.template for r in brief.collect()} == {None, "run ab cd <*>"}
    assert sorted(map(str, TM.in_full(brief).select(*clusters.columns).collect())) == sorted(map(str, clusters.collect()))


def test_classes_of_null_repeated_and_missing_templates(spark):
    rows = spark.createDataFrame([("u", 1), ("d", 2), ("x", 3), (None, 4), ("two", 5)], "template_id string, k int")
    cat = spark.createDataFrame([("u", "informative"), ("d", "decision-marker"), (None, "boilerplate"), ("two", "informative"),
                                 ("two", "boilerplate")], "template_id string, classification string")
    got = sorted((r.k, r.classification) for r in TM.classify_clusters(rows, cat).collect())
    assert got == [(1, "informative"), (2, "decision-marker"), (3, "unknown"), (4, "unknown"), (5, "boilerplate"), (5, "informative")]


def test_report_reads_its_clusters_once(spark):
    one = spark.createDataFrame([("f", "t_1", "x <*>", 2, "a", None, 3, "rare", ["m", None]), ("g", "t_2", "y", 1, "a", "b", 0, "rare", None)],
                                "flow_id string, template_id string, template string, count long, first_seen string, "
                                "last_seen string, first_seq long, classification string, examples array<string>")
    got = TM.render_report(one)
    assert plan(got).count("Generate") <= 1 and "Union" not in plan(got)
    assert {tuple(r) for r in got.collect()} == {
        ("f", 3, 0, "  [t_1] [Count:   2] [rare] x <*>"), ("f", 3, 1, "         first_seen=a  last_seen="),
        ("f", 3, 2, "         example: m"), ("f", 3, 3, None), ("g", 0, 0, "  [t_2] [Count:   1] [rare] y"),
        ("g", 0, 1, "         first_seen=a  last_seen=b")}
