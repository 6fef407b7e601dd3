"""Operator verdicts, accuracy, shadow scoring and promotion readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import py_fixed

# --- fixed values (must equal the behaviour being matched) -----------------
OUTCOME_VERDICTS = ["CORRECT", "INCORRECT", "PARTIAL"]
TERMINAL_STATUSES = ["COMPLETED", "REJECTED", "NEEDS_MANUAL_REVIEW", "FAILED_PERMANENT", "DLQ", "FAILED_TIMEOUT",
                     "FAILED_SYNTHESIS_PARSE", "FAILED_SHUTDOWN"]
PROTECTED_TERMINAL_STATUSES = ["FAILED_TIMEOUT", "DLQ"]
LOGS_FETCHED_STATUS = "LOGS_FETCHED"
MIN_VERDICTS = 20
# ---------------------------------------------------------------------------

OUTCOME_FIELDS = ["reason_code", "enrolment_type", "resolution_source", "agent_action", "confidence", "abstained",
                  "shadow_action", "shadow_runbook_id", "shadow_agreed", "prompt_fingerprint"]


def record_outcomes(verdicts: DataFrame, casebooks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validate verdicts, denormalise the casebook fields, keep the latest
    verdict per event.  Returns (outcomes, rejects).

    ``verdicts``: event_id, verdict, verified_by, verified_at, notes,
    corrected_action.  ``casebooks``: event_id + OUTCOME_FIELDS.
    """
    v = verdicts.withColumn("_v", F.upper(F.trim(F.coalesce(F.col("verdict"), F.lit("")))))
    known = v.join(casebooks.select("event_id").withColumn("_has_case", F.lit(True)), "event_id", "left")
    rejects = known.where(~F.col("_v").isin(*OUTCOME_VERDICTS) | F.col("_has_case").isNull()).select(
        *verdicts.columns,
        F.when(~F.col("_v").isin(*OUTCOME_VERDICTS),
               F.concat(F.lit("verdict must be one of ('CORRECT', 'INCORRECT', 'PARTIAL'), got '"), F.col("_v"),
                        F.lit("'")))
        .otherwise(F.concat(F.lit("No casebook found for event "), F.col("event_id"))).alias("reject_reason"))
    valid = v.where(F.col("_v").isin(*OUTCOME_VERDICTS)).withColumn("verdict", F.col("_v")).drop("_v")
    payload = F.struct("verdict", "verified_by", "verified_at", "notes", "corrected_action")
    latest = (valid.groupBy("event_id").agg(F.max_by(payload, F.struct(F.col("verified_at"), payload)).alias("_o"))
              .select("event_id", "_o.*"))
    outcomes = latest.join(casebooks.select("event_id", *OUTCOME_FIELDS), "event_id", "inner")
    return outcomes, rejects


def source_kind(source: Column) -> Column:
    s = F.coalesce(source, F.lit("unknown"))
    return F.when(s.startswith("runbook:"), F.lit("runbook")).otherwise(s)


def accuracy(outcomes: DataFrame) -> DataFrame:
    """Verdict counts and accuracy (CORRECT / total, 4 dp half-even) per
    (reason code, enrolment type, source kind); PARTIAL is not correct."""
    keyed = outcomes.select(
        F.coalesce(F.col("reason_code"), F.lit("unknown")).alias("reason_code"),
        F.coalesce(F.col("enrolment_type"), F.lit("unknown")).alias("enrolment_type"),
        source_kind(F.col("resolution_source")).alias("resolution_source"), "verdict")
    agg = keyed.groupBy("reason_code", "enrolment_type", "resolution_source").agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in OUTCOME_VERDICTS])
    total = sum((F.col(v) for v in OUTCOME_VERDICTS), F.lit(0))
    return agg.withColumn("total", total).withColumn(
        "accuracy", F.when(F.col("total") > 0, F.bround(F.col("CORRECT") / F.col("total"), 4)).otherwise(F.lit(0.0)))


def shadow_scores(outcomes: DataFrame) -> DataFrame:
    """Shadowed runbooks scored against operator verdicts."""
    s = outcomes.where(F.coalesce(F.col("shadow_runbook_id"), F.lit("")) != "")
    agreed = F.coalesce(F.col("shadow_agreed"), F.lit(False))
    verified = F.col("verdict").isin(*OUTCOME_VERDICTS)
    correct = F.col("verdict") == "CORRECT"
    agg = s.groupBy(F.coalesce(F.col("reason_code"), F.lit("unknown")).alias("reason_code"),
                    F.coalesce(F.col("enrolment_type"), F.lit("unknown")).alias("enrolment_type"),
                    F.col("shadow_runbook_id").alias("runbook_id")).agg(
        F.count(F.lit(1)).alias("shadowed"), F.count_if(agreed).alias("agreed"), F.count_if(~agreed).alias("disagreed"),
        F.count_if(verified & correct & agreed).alias("would_be_correct"),
        F.count_if(verified & correct).alias("agent_correct"), F.count_if(verified).alias("verdicts"))

    def rate(n, d):
        return F.when(F.col(d) > 0, F.bround(F.col(n) / F.col(d), 4)).otherwise(F.lit(0.0))
    return agg.withColumns({"agreement_rate": rate("agreed", "shadowed"),
                            "would_be_accuracy": rate("would_be_correct", "verdicts"),
                            "agent_accuracy": rate("agent_correct", "verdicts")})


def pct1(x: Column) -> Column:
    """Python ``{:.1%}``."""
    return F.concat(py_fixed(x * F.lit(100.0), 1), F.lit("%"))


def promotion_readiness(scores: DataFrame, min_samples: int = 1, min_verdicts: int = MIN_VERDICTS) -> DataFrame:
    """DO NOT PROMOTE / NOT READY / READY per shadowed runbook."""
    s = scores.where(F.col("shadowed") >= min_samples)
    thin = F.col("verdicts") < min_verdicts
    regressed = (F.col("verdicts") > 0) & (F.col("would_be_accuracy") < F.col("agent_accuracy"))
    dnp = F.concat(F.lit("DO NOT PROMOTE: would be "), pct1(F.col("would_be_accuracy")), F.lit(" against the agents' "),
                   pct1(F.col("agent_accuracy")),
                   F.when(thin, F.concat(F.lit(" (on only "), F.col("verdicts").cast("string"),
                                         F.lit(" verified outcome(s))"))).otherwise(F.lit("")))
    verdict = (F.when(regressed, dnp)
               .when(thin, F.concat(F.lit("NOT READY: only "), F.col("verdicts").cast("string"),
                                    F.lit(f" verified outcome(s), need {min_verdicts}")))
               .otherwise(F.concat(F.lit("READY: add "), F.col("reason_code"), F.lit(" to RUNBOOK_SERVE_ALLOWLIST"))))
    status = F.when(regressed, F.lit("DO NOT PROMOTE")).when(thin, F.lit("NOT READY")).otherwise(F.lit("READY"))
    return s.withColumns({"readiness": status, "readiness_text": verdict})


def agent_vs_runbook(acc: DataFrame, min_samples: int = 1) -> DataFrame:
    """Agent and runbook accuracy on the same (code, type); keys having both."""
    a = acc.where(F.col("total") >= min_samples)
    agent = a.where(F.col("resolution_source") == "agent").select(
        "reason_code", "enrolment_type", F.col("accuracy").alias("agent_accuracy"), F.col("total").alias("agent_n"))
    rb = a.where(F.col("resolution_source") == "runbook").select(
        "reason_code", "enrolment_type", F.col("accuracy").alias("runbook_accuracy"), F.col("total").alias("runbook_n"))
    j = agent.join(rb, ["reason_code", "enrolment_type"])
    delta = F.col("runbook_accuracy") - F.col("agent_accuracy")
    return j.withColumns({"delta": F.round(delta, 4),
                          "comparison": F.when(delta >= 0, F.lit("runbook OK")).otherwise(F.lit("runbook WORSE"))})


def pending_verdicts(casebooks: DataFrame, outcomes: DataFrame, status: str = "status") -> DataFrame:
    """Terminal casebooks without a recorded outcome (the verdict queue)."""
    term = casebooks.where(F.col(status).isin(*TERMINAL_STATUSES))
    return term.join(outcomes.select("event_id"), "event_id", "left_anti")


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*TERMINAL_STATUSES), F.lit(False))
