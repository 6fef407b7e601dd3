"""Failure groups, occurrence order, reuse decisions and fixed treatments.

Everything is keyed by fingerprint.  One fingerprint can own a large share of
all cases, so order-dependent columns (occurrence number, "a recommendation
already exists") use chunked running windows (bounded per time bucket, with a
per-bucket carry), and the member list keeps only the newest N per group via
``row_number() <= N`` (trimmed map-side before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.operators.windows import chunked_running_sum

# --- fixed values (must equal the behaviour being matched) -----------------
MEMBER_CAP = 200
MAX_BROADCAST_IDS = 100_000   # more redelivered case ids than this are shuffled to meet their cases
STATE_NONE, STATE_DRAFT, STATE_FINAL = "none", "draft", "final"
D_CANNED, D_LLM, D_REUSE = "CANNED", "LLM_REQUIRED", "REUSE_GROUP"
R_CANNED = "class {cls} has a fixed treatment; no model involved"
R_DISCREPANCY = "corroboration came back {verdict}; the discrepancy leads the finding"
R_REUSE_OFF = "reuse is disabled by DLT_REUSE_ENABLED"
R_NOVEL = "novel fingerprint; no recommendation on file for this group"
R_REUSE_OK = "known fingerprint, logs corroborate the trace; serving the group's recommendation"
R_REUSE_CAPPED = ("known fingerprint but corroboration was unverifiable; serving the group's recommendation "
                  "at a capped confidence")
SEEN_FIRST = "This is the first recorded occurrence of this failure signature."
# ---------------------------------------------------------------------------


def dedupe_cases(cases: DataFrame, seq: str = "seq", in_place: bool = False) -> DataFrame:
    """Redelivered cases count once: keep the earliest delivery per case id
    (a min-by aggregate, skew-safe).  A case without any ``seq`` is a row of
    its id alone.

    ``in_place`` is for a written table of wide rows: the ids are counted
    first, so that only cases of several deliveries go through the aggregate
    and the others are not shuffled.
    """
    cols = [c for c in cases.columns if c != "case_id"]
    if in_place:
        from logsift.session import materialize, shuffled_beyond
        again = materialize(cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
                            .select(F.col("case_id").alias("_again")))
        again = shuffled_beyond(again, MAX_BROADCAST_IDS)
        among = F.col("case_id").eqNullSafe(F.col("_again"))
        once = cases.join(again, among, "left_anti").select(
            "case_id", *[F.when(F.col(seq).isNotNull(), F.col(c)).alias(c) for c in cols])
        return once.unionByName(dedupe_cases(cases.join(again, among, "left_semi"), seq))
    packed = F.struct(*[F.col(c) for c in cols])
    return cases.groupBy("case_id").agg(F.min_by(packed, F.col(seq)).alias("_p")).select(
        "case_id", *[f"_p.{c}" for c in cols])


def occurrence_numbers(cases: DataFrame, seq: str = "seq", bucket: str = "bucket") -> DataFrame:
    """``occurrence``: number of cases of the fingerprint up to and including
    this one, in ``seq`` order (chunked by ``bucket``)."""
    return chunked_running_sum(cases.withColumn("_one", F.lit(1)), "_one", "fingerprint", bucket, [seq, "case_id"],
                               out="occurrence").drop("_one")


def reuse_decisions(cases: DataFrame, seq: str = "seq", bucket: str = "bucket", reuse_enabled: bool = True,
                    agent_ok: str = "agent_ok") -> DataFrame:
    """CANNED / LLM_REQUIRED / REUSE_GROUP per case, with reason.

    A group's recommendation exists from the first class-A case whose agent
    run satisfied the contract, so "has recommendation" is a running count of
    earlier such cases (exclusive), exact without sequential replay.
    """
    flag = F.when((F.col("failure_class") == "A") & F.coalesce(F.col(agent_ok), F.lit(False)), 1).otherwise(0)
    df = chunked_running_sum(cases.withColumn("_ok", flag), "_ok", "fingerprint", bucket, [seq, "case_id"],
                             out="_prior_ok", inclusive=False).drop("_ok")
    has_rec = F.col("_prior_ok") > 0
    v = F.col("verdict")
    decision = (F.when(F.col("failure_class") != "A", F.lit(D_CANNED))
                .when(v.isin("CONTRADICTED", "PARTIAL"), F.lit(D_LLM))
                .when(F.lit(not reuse_enabled), F.lit(D_LLM))
                .when(~has_rec, F.lit(D_LLM))
                .otherwise(F.lit(D_REUSE)))
    reason = (F.when(F.col("failure_class") != "A",
                     F.format_string(R_CANNED.replace("{cls}", "%s"), F.col("failure_class")))
              .when(v.isin("CONTRADICTED", "PARTIAL"), F.format_string(R_DISCREPANCY.replace("{verdict}", "%s"), v))
              .when(F.lit(not reuse_enabled), F.lit(R_REUSE_OFF))
              .when(~has_rec, F.lit(R_NOVEL))
              .when(v == "CORROBORATED", F.lit(R_REUSE_OK))
              .otherwise(F.lit(R_REUSE_CAPPED)))
    return df.withColumns({"has_recommendation": has_rec, "decision": decision, "decision_reason": reason}) \
        .drop("_prior_ok")


def group_rollup(cases: DataFrame, seq: str = "seq", seen: str = "seen_at", member_cap: int = MEMBER_CAP) -> DataFrame:
    """One row per fingerprint: occurrence count (distinct cases), first/last
    seen, latest non-empty signature / class / code, verdict histogram and the
    newest ``member_cap`` case ids (oldest first)."""
    latest = F.struct(F.col(seq), F.col("case_id"))
    base = cases.groupBy("fingerprint").agg(
        F.count_distinct("case_id").alias("occurrence_count"),
        F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"),
        F.max_by("signature", F.when(F.coalesce(F.col("signature"), F.lit("")) != "", latest)).alias("signature"),
        F.max_by("failure_class", F.when(F.col("failure_class").isNotNull(), latest)).alias("failure_class"),
        F.max_by("business_code", F.when(F.col("business_code").isNotNull(), latest)).alias("business_code"))
    hist = (cases.where(F.col("verdict").isNotNull()).groupBy("fingerprint", "verdict").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("fingerprint").agg(F.map_from_entries(F.collect_list(F.struct("verdict", "n")))
                                        .alias("corroboration_history")))
    ranked = cases.select("fingerprint", "case_id", seq).withColumn(
        "_rk", F.row_number().over(Window.partitionBy("fingerprint").orderBy(F.col(seq).desc(), F.col("case_id").desc())))
    members = (ranked.where(F.col("_rk") <= member_cap).groupBy("fingerprint")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("case_id").alias("c")))),
                                lambda x: x["c"]).alias("members")))
    return (base.join(hist, "fingerprint", "left").join(members, "fingerprint", "left")
            .withColumn("corroboration_history", F.coalesce(F.col("corroboration_history"),
                                                            F.create_map().cast("map<string,bigint>"))))


def attach_recommendations(groups: DataFrame, findings: DataFrame, seq: str = "seq") -> DataFrame:
    """Latest agent recommendation per group (state draft); none -> 'none'."""
    rec = (findings.where(F.col("provenance") == "agent").groupBy("fingerprint")
           .agg(F.max_by(F.col("action"), F.struct(seq, "action", "confidence")).alias("recommendation_action"),
                F.max_by(F.col("confidence"), F.struct(seq, "action", "confidence")).alias("recommendation_confidence")))
    return (groups.join(rec, "fingerprint", "left")
            .withColumn("recommendation_state", F.when(F.col("recommendation_action").isNotNull(), F.lit(STATE_DRAFT))
                        .otherwise(F.lit(STATE_NONE))))


def seen_summary(occurrence: Column, first_seen: Column) -> Column:
    """``N occurrence(s) of this signature recorded first seen <UTC>.``"""
    when = F.when(first_seen.isNotNull(), F.concat(F.lit(" first seen "),
                                                   F.date_format(first_seen, "yyyy-MM-dd HH:mm 'UTC'"))).otherwise(F.lit(""))
    plural = F.when(occurrence == 1, F.lit("occurrence")).otherwise(F.lit("occurrences"))
    return F.when(F.coalesce(occurrence, F.lit(0)) == 0, F.lit(SEEN_FIRST)).otherwise(
        F.concat(occurrence.cast("string"), F.lit(" "), plural, F.lit(" of this signature recorded"), when, F.lit(".")))


def llm_calls_avoided(messages: Column, groups: Column) -> Column:
    return F.when(messages <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - groups / messages))


def group_detail(groups: DataFrame, prefix_len: int = 8, last_members: int = 10) -> DataFrame:
    """Per group: its short prefix and whether that prefix is ambiguous
    (shared with another group), the verdict history most frequent first,
    a flag when some occurrences contradicted the trace, and the newest
    ``last_members`` member ids.  Groups are one row per fingerprint, so the
    ambiguity count is a small aggregate joined back."""
    pre = F.substring("fingerprint", 1, prefix_len)
    g = groups.withColumn("prefix", pre)
    amb = g.groupBy("prefix").agg(F.count(F.lit(1)).alias("_n"))
    hist = F.array_sort(F.transform(F.map_entries("corroboration_history"),
                                    lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    return g.join(amb, "prefix").select(
        "fingerprint", "prefix", (F.col("_n") > 1).alias("ambiguous_prefix"),
        F.array_join(F.transform(hist, lambda x: F.concat(x["k"], F.lit("="), (-x["n"]).cast("string"))), ",")
        .alias("history_by_count"),
        F.coalesce(F.try_element_at(F.col("corroboration_history"), F.lit("CONTRADICTED")) > 0, F.lit(False))
        .alias("some_contradicted"),
        F.slice("members", -last_members, last_members).alias("last_members"))


def resolve_prefix(groups: DataFrame, prefix: str) -> DataFrame:
    """Groups whose fingerprint starts with ``prefix`` (callers treat zero or
    several rows as 'not found' / 'use a longer prefix')."""
    return groups.where(F.col("fingerprint").startswith(prefix))
