"""Template mining against a plain recount, and its edge cases."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logsift.operators import templates as TM

SCHEMA = "message string"


def plain_mining(masked):
    """The stated rounds over a set of masked messages, with dictionaries."""
    def leaf(m):
        toks = m.split(" ")
        lead = [*toks[:2], ""][:2]
        return len(toks), *("<*>" if re.search(r"[0-9]", t) or "<" in t else t for t in lead)
    rest, out = set(masked), {}
    for _ in range(TM.ROUNDS):
        leaves = defaultdict(list)
        for m in rest:
            leaves[leaf(m)].append(m.split(" "))
        for msgs in leaves.values():
            if len(msgs) == 1:
                continue
            counts = [Counter(col) for col in zip(*msgs)]
            for toks in msgs:
                kept = [t if c[t] >= 2 and 5 * c[t] >= len(msgs) else "<*>" for t, c in zip(toks, counts)]
                if 5 * sum(t != "<*>" for t in kept) >= 2 * len(toks):
                    out[" ".join(toks)] = " ".join(kept)
        rest -= out.keys()
    return out | {m: m for m in rest}


def mined(spark, messages, **kw):
    lines = spark.createDataFrame([(m,) for m in messages], SCHEMA)
    masked = {r[0] for r in lines.select(TM.mask_message(F.col("message"))).collect()}
    rows = TM.mine_templates(lines, **kw).collect()
    assert len(rows) == len({r.masked for r in rows}) and all(r.masked in masked and r.masked != r.template for r in rows)
    return masked, {m: m for m in masked} | {r.masked: r.template for r in rows}


def hot_leaf_messages():
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    many = [f"request from {words[i % 7]} host{'abcdefghij'[i % 10]}{chr(97 + i % 26)} took x{i}y ms state "
            f"{'ok' if i % 3 else 'late'}" for i in range(1800)]
    rarer = [f"request from q{i}r s{i}t u{i}v w{i}x retry {words[i % 2]}" for i in range(60)]
    single = [f"{w} starts here" for w in words]
    return many + rarer + single + ["cache warm", "cache cold", "cache warm"]


def test_mining_equals_plain_recount_under_a_hot_leaf(spark):
    messages = hot_leaf_messages()
    masked, got = mined(spark, messages)
    assert got == plain_mining(masked)
    assert len({t for m, t in got.items() if m.startswith("request from")}) < 20


def test_mining_ignores_order_partitions_and_salts(spark):
    messages = hot_leaf_messages()
    _, want = mined(spark, messages)
    assert mined(spark, messages[::-1], salts=3)[1] == want


def test_later_rounds_place_what_a_large_group_outnumbers(spark):
    large = [f"job run a b c d e f g{i}h i" for i in range(40)]
    small = [f"job run {'pqrstuv'[i]} m n o p{i}q r s t" for i in range(3)]
    masked, got = mined(spark, large + small)
    assert got == plain_mining(masked)
    assert {got[m] for m in small} == {"job run <*> m n o <*> r s t"}
    assert mined(spark, large + small, rounds=1)[1][small[0]] == small[0]


def test_no_leaf_is_collected_and_no_python_runs(spark):
    lines = spark.createDataFrame([(m,) for m in hot_leaf_messages()], SCHEMA)
    rest = lines.select(TM.mask_message(F.col("message")).alias("masked")).distinct() \
        .withColumn("leaf", TM.leaf_key(F.col("masked")))
    placed = TM._place(rest, TM.SIMILARITY, TM.COMMON_SHARE, 8)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Window" not in plan
    sizes = rest.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    live = rest.join(sizes, "leaf")
    widest = TM._common_tokens(live, TM.COMMON_SHARE).select(F.max(F.array_max(F.transform("_common", F.size)))).first()[0]
    assert widest <= 5                       # at most 1 / share tokens a position, however large the leaf


@pytest.mark.parametrize("messages, want", [
    ([], {}),
    ([None, "", "   "], {"": ""}),
    (["one", "one", "one"], {"one": "one"}),
    (["id 7 a", "id 8 a", "id\t9   a"], {"id <NUM> a": "id <NUM> a"}),
    (["v2beta x1", "at -5 or +6,000.5:1"], {"v2beta x1": "v2beta x1", "at <NUM> or <NUM>": "at <NUM> or <NUM>"}),
])
def test_mining_edges(spark, messages, want):
    assert mined(spark, messages)[1] == want


def test_very_long_message_and_extra_columns(spark):
    long = " ".join(f"w{'abc'[i % 3]}" for i in range(60_000))
    lines = spark.createDataFrame([(long + " x", "l", 1), (long + " y", "m", 2)], "message string, leaf string, _n int")
    got = TM.assign_templates(lines, TM.mine_templates(lines)).collect()
    assert {r.template for r in got} == {long + " <*>"} and {r.leaf for r in got} == {"l", "m"}
