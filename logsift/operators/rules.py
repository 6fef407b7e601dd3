"""Rules, runbooks and their joins to rejection cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values (must equal the behaviour being matched) -----------------
ENROLMENT_TYPE_ALIASES = {"U": "UPDATE", "UPDATE": "UPDATE", "E": "ENROLMENT", "ENROLMENT": "ENROLMENT",
                          "ENROLLMENT": "ENROLMENT"}
RULE_CODE_COLUMNS = ["reasoncode", "reason_code", "errorcode", "error_code", "rejectioncode", "rejection_code", "code",
                     "rejectreasoncode", "reject_reason_code"]
RULE_TYPE_PATH = "$.statement.Condition.StringEquals.enrolmentType"
RUNBOOK_SCHEMA_VERSIONS = ["1.0", "1.1"]
RUNBOOK_RESOLUTION_KEYS = ["rejection_description", "synthesis", "action", "resident_action"]
REASON_CODE_PATTERN = r"^[A-Za-z0-9_.:-]{1,128}$"
UNKNOWN_ERROR = "Unknown error code."
# ---------------------------------------------------------------------------


def normalize_rule_type(value: Column) -> Column:
    """U/E aliases -> UPDATE/ENROLMENT; anything else (or empty) -> NULL."""
    up = F.upper(F.trim(value))
    expr = None
    for k, v in ENROLMENT_TYPE_ALIASES.items():
        expr = F.when(up == k, F.lit(v)) if expr is None else expr.when(up == k, F.lit(v))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(None).cast("string")).otherwise(expr)


def runbook_type(value: Column) -> Column:
    """Runbook key type: upper-cased and trimmed, ANY when missing."""
    t = F.upper(F.trim(value))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("ANY")).otherwise(t)


def detect_code_column(columns: Sequence[str]) -> str | None:
    """First column whose normalised name is a known reason-code column."""
    for c in columns:
        if c.lower().replace(" ", "").replace("_", "") in [x.replace("_", "") for x in RULE_CODE_COLUMNS]:
            return c
    return None


def rules_for_cases(cases: DataFrame, rules: DataFrame, code: str = "reason_code",
                    etype: str = "enrolment_type", order: str = "rule_pos") -> DataFrame:
    """Rule rows per case: rows for the case's reason code, then only rows
    for its (normalised) enrolment type or untyped ones; when that leaves
    nothing, all rows for the code.  Unparseable rule data is kept.

    The rules table is reference-sized and joined by key; the per-case
    fallback is one aggregate per case (rules per code are few).
    """
    rcol = detect_code_column(rules.columns)
    if rcol is None:
        raise ValueError(f"no reason-code column among {rules.columns}")
    r = rules.withColumn("_rule_code", F.col(rcol).cast("string"))
    c = cases.select("event_id", F.col(code).alias("_rule_code"), normalize_rule_type(F.col(etype)).alias("_target"))
    j = c.join(r, "_rule_code")
    parsed = F.json_object_keys(F.col("rule_data")).isNotNull()
    rtype = F.get_json_object(F.col("rule_data"), RULE_TYPE_PATH)
    keep = (F.col("_target").isNull() | ~parsed | F.coalesce(rtype, F.lit("")).__eq__("")
            | (rtype == F.col("_target")))
    j = j.withColumn("_keep", F.coalesce(keep, F.lit(True)))
    # rows per case = rules for one code (a handful), so this window is bounded
    any_keep = F.max(F.col("_keep").cast("int")).over(Window.partitionBy("event_id")) == 1
    return (j.withColumn("_any_keep", any_keep).where(F.col("_keep") | ~F.col("_any_keep"))
            .drop("_keep", "_any_keep", "_target").withColumnRenamed("_rule_code", "matched_code"))


def rule_fingerprint(rule_rows: DataFrame, key: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """``sha256:`` + sha256 of the rows' canonical JSON (keys sorted, compact,
    nulls kept), rows in ``order``; independent of column order."""
    cols = sorted(columns)
    st = F.struct(*[F.col(c) for c in cols])
    agg = rule_rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), st.alias("_r"))))
                                      .alias("_rows"))
    canon = F.to_json(F.transform(F.col("_rows"), lambda x: x["_r"]), {"ignoreNullFields": "false"})
    return agg.select(*key, F.concat(F.lit("sha256:"), F.sha2(canon, 256)).alias("rule_fingerprint"))


def valid_runbooks(runbooks: DataFrame) -> DataFrame:
    """Final runbooks with a supported schema and all resolution keys."""
    ok = (F.col("status") == "final") & F.col("schema_version").isin(*RUNBOOK_SCHEMA_VERSIONS) \
        & F.col("reason_code").rlike(REASON_CODE_PATTERN)
    for k in RUNBOOK_RESOLUTION_KEYS:
        ok = ok & F.col(f"resolution.{k}").isNotNull()
    return runbooks.where(ok)


def match_runbooks(cases: DataFrame, runbooks: DataFrame, code: str = "reason_code",
                   etype: str = "enrolment_type") -> DataFrame:
    """Per case the runbook for (code, type), else (code, ANY).

    The best runbook of each (code, type) is found first, then that of each
    distinct (code, type) of the cases, so that a case meets one row however
    many runbooks share its code.
    """
    rb = valid_runbooks(runbooks).select(F.col("reason_code").alias("_rb_code"),
                                         runbook_type(F.col("enrolment_type")).alias("_rb_type"),
                                         F.col("runbook_id"), F.col("version").alias("runbook_version"),
                                         F.col("rule_fingerprint").alias("runbook_rule_fingerprint"),
                                         F.col("resolution.action").alias("runbook_action"))
    c = cases.withColumn("_case_type", runbook_type(F.col(etype)))
    payload = F.struct("runbook_id", "runbook_version", "runbook_rule_fingerprint", "runbook_action",
                       F.col("_rb_type").alias("runbook_type"))
    order = F.struct((-F.col("runbook_version")).alias("_v"), F.col("runbook_id").alias("_id"))
    ranked = rb.groupBy("_rb_code", "_rb_type").agg(F.min(F.struct(order.alias("_o"), payload.alias("_p"))).alias("_b"))
    kinds = c.select(F.col(code).alias("_code"), F.col("_case_type").alias("_type")).where(F.col("_code").isNotNull()).distinct()
    met = kinds.join(ranked, (F.col("_code") == F.col("_rb_code"))
                     & ((F.col("_rb_type") == F.col("_type")) | (F.col("_rb_type") == "ANY")))
    rank = F.when(F.col("_rb_type") == F.col("_type"), 0).otherwise(1)
    found = met.groupBy("_code", "_type").agg(F.min(F.struct(rank.alias("_r"), "_b")).alias("_m"))
    j = c.join(found, (F.col(code) == F.col("_code")) & (F.col("_case_type") == F.col("_type")), "left")
    cols = [x for x in c.columns if x != "_case_type"]
    # deliveries of one event share the best match of them all
    best = F.min("_m").over(Window.partitionBy("event_id"))
    j = j.withColumn("_rb", F.when(F.col("event_id").isNotNull(), best)["_b"]["_p"])
    return j.select(*cols, "_rb.*")


def runbook_staleness(runbooks: DataFrame, current: DataFrame) -> DataFrame:
    """Final runbooks whose stored rule fingerprint differs from the current
    rules' (STALE), or whose rules are gone (MISSING_RULE)."""
    rb = valid_runbooks(runbooks)
    j = rb.join(current.withColumnRenamed("rule_fingerprint", "current_fingerprint"),
                (rb["reason_code"] == current["reason_code"]) & (runbook_type(rb["enrolment_type"]) == current["rule_type"]),
                "left")
    state = (F.when(F.col("current_fingerprint").isNull(), F.lit("MISSING_RULE"))
             .when(F.col("current_fingerprint") != F.col("rule_fingerprint"), F.lit("STALE"))
             .otherwise(F.lit("CURRENT")))
    return j.select(rb["runbook_id"], rb["reason_code"], rb["enrolment_type"], rb["rule_fingerprint"],
                    "current_fingerprint", state.alias("staleness"))


def shadow_comparison(cases: DataFrame, agent_action: str = "agent_action", runbook_action: str = "runbook_action"
                      ) -> DataFrame:
    """Runbook action vs agent action per case; NULL when no runbook."""
    return cases.withColumn("shadow_agreed", F.when(F.col("runbook_id").isNotNull(),
                                                    F.col(agent_action).eqNullSafe(F.col(runbook_action))))


def promote_drafts(drafts: DataFrame, approved: DataFrame, finals: DataFrame, approver: Column,
                   approved_at: Column) -> DataFrame:
    """Approved drafts become final with version = existing final + 1 (1 when
    new), approver and time stamped."""
    cur = finals.groupBy(F.col("reason_code").alias("_k_code"), runbook_type(F.col("enrolment_type")).alias("_k_type")) \
        .agg(F.max("version").alias("_existing"))
    d = drafts.join(approved.select("runbook_id"), "runbook_id", "left_semi")
    d = d.join(cur, (d["reason_code"] == cur["_k_code"]) & (runbook_type(d["enrolment_type"]) == cur["_k_type"]), "left") \
        .drop("_k_code", "_k_type")
    return d.withColumns({"status": F.lit("final"), "approved_by": approver, "approved_at": approved_at,
                          "version": (F.coalesce(F.col("_existing"), F.lit(0)) + 1).cast("int")}).drop("_existing")


def group_casebooks(casebooks: DataFrame, min_samples: int = 3, any_type: bool = False,
                    type_col: str = "enrolment_type", id_col: str = "event_id", examples: int = 5) -> DataFrame:
    """Clean terminal casebooks grouped by (code, type) with at least
    ``min_samples`` members: count, source ids (bounded) and examples."""
    clean = casebooks.where(F.col("status").isin("COMPLETED", "REJECTED")
                            & ~F.coalesce(F.col("synthesis"), F.lit("")).contains("ESCALATED TO HUMAN REVIEW")
                            & F.col("reason_code").isNotNull() & F.col(type_col).isNotNull())
    t = F.lit("ANY") if any_type else F.upper(F.trim(F.col(type_col)))
    g = clean.withColumn("_type", t)
    w = Window.partitionBy("reason_code", "_type").orderBy(F.col(id_col))
    ranked = g.withColumn("_rk", F.row_number().over(w))
    counts = g.groupBy("reason_code", "_type").agg(F.count(F.lit(1)).alias("samples"))
    ex = (ranked.where(F.col("_rk") <= examples).groupBy("reason_code", "_type")
          .agg(F.array_sort(F.collect_list(F.col(id_col))).alias("example_ids")))
    return (counts.where(F.col("samples") >= min_samples).join(ex, ["reason_code", "_type"])
            .withColumnRenamed("_type", "enrolment_type"))


def describe_codes(codes: DataFrame, catalog: DataFrame, code: str = "code") -> DataFrame:
    """Code -> description from a reference table, default text on a miss."""
    cat = F.broadcast(catalog.select(F.col("code").alias("_c"), F.col("description").alias("_d")))
    j = codes.join(cat, codes[code] == F.col("_c"), "left")
    return j.withColumn("description", F.coalesce(F.col("_d"), F.lit(UNKNOWN_ERROR))).drop("_c", "_d")


def serve_allowed(code: Column, allowlist: Sequence[str] | None) -> Column:
    """Runbook serving allow-list: unset means every code may be served."""
    return F.lit(True) if allowlist is None else F.coalesce(code.isin(*allowlist), F.lit(False))
