"""Trace-vs-log corroboration for every case at once.

cases ⋈ log lines on the correlation id and the hour within each case's
window, then one partial aggregation per case.  A hot correlation id (one id
owning a large share of lines) is cut into its hours, so that only lines near
a case are compared with its window; the only per-case ranked set is the first 20 cited lines, trimmed per map
partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values (must equal the behaviour being matched) -----------------
ERROR_LINE_RE = r"\b(ERROR|FATAL|SEVERE)\b"
FQCN_IN_TEXT_RE = r"\b((?:[a-z][\w$]*\.){2,}[A-Z][\w$]*(?:Exception|Error|Throwable))\b"
MAX_CITATIONS = 20
WINDOW_STEP = 3600        # seconds; cases and lines meet within steps of this length
V_CORROBORATED, V_PARTIAL, V_CONTRADICTED, V_UNVERIFIABLE = "CORROBORATED", "PARTIAL", "CONTRADICTED", "UNVERIFIABLE"
R_NO_LOGS = "no logs were fetched"
R_SKIPPED = "the log fetch was skipped or failed"
R_EMPTY = "the log source returned no lines for this identifier"
R_NO_ERRORS = "logs were fetched but contain no error-level lines"
R_MATCH = "the declared root appears in the logs (matched on its {matched_on})"
R_PARTIAL = "the declared root appears, but the window also holds errors it does not explain"
R_CONTRA = "the declared root ({simple}) does not appear in the logs, but {others} did"
R_UNNAMED = "error lines were found but none names an exception type"
# ---------------------------------------------------------------------------


def simple_name(fqcn: Column) -> Column:
    return F.when(F.coalesce(fqcn, F.lit("")) == F.lit(""), F.lit("")).otherwise(F.substring_index(fqcn, ".", -1))


def window_lines(cases: DataFrame, lines: DataFrame, key: str = "ref_id", ts: str = "ts",
                 start: str = "window_start", end: str = "window_end", both_bounds: bool = True,
               step_seconds: int = WINDOW_STEP) -> DataFrame:
    """Case ⋈ log lines on the correlation id, inside [start, end].

    With both bounds a case meets the lines of the ``step_seconds`` steps that
    its window touches, a line being in one step alone.
    ``both_bounds=False`` applies the look-back only (the lower bound).
    """
    c = cases.select("case_id", F.col(key).alias("_key"), F.col(start).alias("_ws"), F.col(end).alias("_we"))
    if not both_bounds:
        cond = (c["_key"] == lines[key]) & (lines[ts] >= c["_ws"])
        return c.join(lines, cond).drop("_key", "_ws", "_we")

    def step(t: Column) -> Column:
        return F.floor(F.unix_seconds(t.cast("timestamp")) / step_seconds)
    c = c.where(F.col("_ws") <= F.col("_we")).withColumn("_step", F.explode(F.sequence(step(F.col("_ws")), step(F.col("_we")))))
    stepped = lines.withColumn("_line_step", step(F.col(ts)))
    cond = ((c["_key"] == stepped[key]) & (c["_step"] == stepped["_line_step"])
            & (stepped[ts] >= c["_ws"]) & (stepped[ts] <= c["_we"]))
    return c.join(stepped, cond).drop("_key", "_ws", "_we", "_step", "_line_step")


def corroborate(cases: DataFrame, case_lines: DataFrame, line: str = "line", order=("ts", "line_id"),
                skipped: str = "fetch_skipped", max_citations: int = MAX_CITATIONS) -> DataFrame:
    """Verdict per case: CORROBORATED / PARTIAL / CONTRADICTED / UNVERIFIABLE.

    ``cases``: case_id, root_fqcn, business_code, frames, ``skipped`` (the
    fetch was skipped or failed: could not look).  ``case_lines``: case_id,
    ordering columns and the rendered line text.
    Adds verdict, corroboration_reason, citations, unexplained,
    matched_declared, error_lines_seen, could_not_look, matched_on, frame_hits.
    """
    errs = case_lines.where(F.col(line).rlike(ERROR_LINE_RE)).withColumn("_l", F.trim(F.col(line)))
    info = cases.select("case_id", "root_fqcn", "business_code", "frames")
    e = errs.join(info, "case_id")
    simple = simple_name(F.col("root_fqcn"))

    def hit(needle: Column) -> Column:
        return F.coalesce((needle != F.lit("")) & F.col("_l").contains(needle), F.lit(False))
    per_line = e.select(
        "case_id", *order, "_l",
        hit(F.coalesce(F.col("root_fqcn"), F.lit(""))).alias("_h_fq"),
        hit(simple).alias("_h_simple"),
        hit(F.coalesce(F.col("business_code"), F.lit(""))).alias("_h_code"),
        F.filter(F.coalesce(F.col("frames"), F.array().cast("array<string>")),
                 lambda f: (F.substring_index(f, ".", -1) != F.lit("")) &
                 F.col("_l").contains(F.substring_index(f, ".", -1))).alias("_fh"),
        F.regexp_extract_all(F.col("_l"), F.lit(FQCN_IN_TEXT_RE), 1).alias("_seen"))
    agg = per_line.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("error_lines_seen"),
        F.bool_or("_h_fq").alias("_m_fq"), F.bool_or("_h_simple").alias("_m_simple"),
        F.bool_or("_h_code").alias("_m_code"),
        F.array_distinct(F.flatten(F.collect_set("_fh"))).alias("_fh_set"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_seen")))).alias("exceptions_in_logs"))
    ranked = per_line.withColumn("_rk", F.row_number().over(
        Window.partitionBy("case_id").orderBy(*[F.col(c) for c in order])))
    cites = (ranked.where(F.col("_rk") <= max_citations).groupBy("case_id")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rk", "_l"))), lambda s: s["_l"]).alias("citations")))
    any_lines = case_lines.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n_lines"))
    out = (cases.join(any_lines, "case_id", "left").join(agg, "case_id", "left").join(cites, "case_id", "left"))
    simple = simple_name(F.col("root_fqcn"))
    matched_on = (F.when(F.col("_m_fq"), F.lit("fqcn")).when(F.col("_m_simple"), F.lit("simple name"))
                  .when(F.col("_m_code"), F.lit("business code")))
    out = out.withColumns({
        "matched_on": matched_on,
        "frame_hits": F.filter(F.coalesce(F.col("frames"), F.array().cast("array<string>")),
                               lambda f: F.array_contains(F.coalesce(F.col("_fh_set"), F.array().cast("array<string>")), f)),
        "unexplained": F.filter(F.coalesce(F.col("exceptions_in_logs"), F.array().cast("array<string>")),
                                lambda x: (x != F.coalesce(F.col("root_fqcn"), F.lit(""))) &
                                (F.substring_index(x, ".", -1) != simple)),
        "error_lines_seen": F.coalesce(F.col("error_lines_seen"), F.lit(0)),
    })
    matched = F.col("matched_on").isNotNull()
    unexpl = F.size("unexplained") > 0
    sk = F.coalesce(F.col(skipped), F.lit(False))
    no_lines = F.coalesce(F.col("_n_lines"), F.lit(0)) == 0
    no_err = F.col("error_lines_seen") == 0
    others = F.array_join(F.transform(F.slice(F.col("unexplained"), 1, 3), lambda x: F.substring_index(x, ".", -1)), ", ")
    simple_or = F.when(simple == F.lit(""), F.lit("unknown")).otherwise(simple)
    verdict = (F.when(sk, F.lit(V_UNVERIFIABLE)).when(no_lines, F.lit(V_UNVERIFIABLE))
               .when(no_err, F.lit(V_UNVERIFIABLE))
               .when(matched & ~unexpl, F.lit(V_CORROBORATED)).when(matched, F.lit(V_PARTIAL))
               .when(unexpl, F.lit(V_CONTRADICTED)).otherwise(F.lit(V_UNVERIFIABLE)))
    reason = (F.when(sk, F.lit(R_SKIPPED)).when(no_lines, F.lit(R_EMPTY)).when(no_err, F.lit(R_NO_ERRORS))
              .when(matched & ~unexpl, F.concat(F.lit("the declared root appears in the logs (matched on its "),
                                                F.col("matched_on"), F.lit(")")))
              .when(matched, F.lit(R_PARTIAL))
              .when(unexpl, F.concat(F.lit("the declared root ("), simple_or, F.lit(") does not appear in the logs, but "),
                                     others, F.lit(" did")))
              .otherwise(F.lit(R_UNNAMED)))
    tail = ~sk & ~no_lines & ~no_err
    return (out.withColumns({
        "verdict": verdict, "corroboration_reason": reason,
        "matched_declared": F.coalesce(tail & matched, F.lit(False)),
        "could_not_look": sk,
        "error_lines_seen": F.when(~sk & ~no_lines, F.col("error_lines_seen")).otherwise(F.lit(0)),
        "citations": F.when(tail, F.coalesce(F.col("citations"), F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>")),
        "unexplained": F.when(tail & unexpl, F.col("unexplained")).otherwise(F.array().cast("array<string>")),
    }).drop("_n_lines", "_m_fq", "_m_simple", "_m_code", "_fh_set"))
