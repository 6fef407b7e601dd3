"""The dead-letter analysis pass over all cases: corroborate, order, decide,
treat, cap, gate.  Batch definition; the streaming form runs it per
micro-batch (see ``logsift.streaming``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators import corroborate as C
from logsift.operators import groups as G
from logsift.operators import policy as P
from logsift.operators.windows import chunked_ffill

SKIP_GAPS = ["NO_CORRELATION_ID", "NO_TIMESTAMP", "LOGS_TOO_OLD", "LOG_FETCH_FAILED"]
FAILED_NARRATIVE = ("The analysis produced output that does not satisfy the finding contract, even after a repair "
                    "attempt. The verbatim stack trace and logs are attached.")


def time_bucket(ts: Column, seconds: int = 3600) -> Column:
    """Chunk key for the order-dependent windows: cases of one fingerprint in
    one hour (bounded by the arrival rate); the carry step then sees one row
    per (fingerprint, hour)."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds).cast("bigint")


def case_evidence(cases: DataFrame, lines: DataFrame, both_bounds: bool = True, seq: str = "dlt_timestamp",
                  materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cases, case lines): one row per case with ``fetch_skipped``, and the
    log lines inside the windows of the cases that could be looked up."""
    from logsift.session import materialize as _mat
    c = G.dedupe_cases(cases, seq, in_place=materialize)
    c = c.withColumn("fetch_skipped", F.exists(F.col("gaps_list"), lambda g: g.isin(*SKIP_GAPS)))
    if materialize:
        c = _mat(c)
    looked = c.where(~F.col("fetch_skipped") & F.col("ref_id").isNotNull())
    cl = C.window_lines(looked, lines, both_bounds=both_bounds).drop("ref_id")
    # read by three branches of the corroboration and by the casebooks
    return c, _mat(cl) if materialize else cl


def analyse_cases(cases: DataFrame, lines: DataFrame, agent: DataFrame | None = None,
                  reuse_enabled: bool = True, replay_enabled: bool = True, both_bounds: bool = True,
                  seq: str = "dlt_timestamp", materialize: bool = True) -> DataFrame:
    """``cases``: failures + ids + window + gaps columns (one row per case);
    a boolean ``trace_gap`` column marks cases whose fetched trace has evidence
    gaps (their confidence is capped);
    ``lines``: (ref_id, ts, line_id, line); ``agent``: (case_id, agent_ok,
    agent_action, agent_confidence) recorded model results, or None.
    Returns one row per case with verdict, occurrence, decision, provenance,
    final action/confidence, ceilings and the replay decision."""
    c, cl = case_evidence(cases, lines, both_bounds, seq, materialize)
    return decide_cases(c, cl, agent, reuse_enabled, replay_enabled, seq, materialize)


def decide_cases(c: DataFrame, cl: DataFrame, agent: DataFrame | None = None, reuse_enabled: bool = True,
                 replay_enabled: bool = True, seq: str = "dlt_timestamp", materialize: bool = True,
                 whole: bool = True) -> DataFrame:
    """The analysis of :func:`case_evidence`'s tables, see :func:`analyse_cases`.
    ``whole=False`` writes the narrow steps alone and leaves the last join, with
    the wide columns of the cases, to a reader that needs few of them."""
    from logsift.session import materialize as _mat
    # Corroboration and order-dependent columns are found on narrow tables, as
    # each join and each chunked window shuffles its input; the other columns
    # of the cases meet them at the end.
    gap = ["trace_gap"] if "trace_gap" in c.columns else []
    ordered = ["fingerprint", seq, "failure_class", "registry_description", *gap]
    told = ["root_fqcn", "business_code", "frames", "fetch_skipped"]
    k = C.corroborate(c.select(*dict.fromkeys(["case_id", *told, *ordered])), cl).drop(*told)
    if materialize:
        k = _mat(k)
    verdicts = k.drop(*ordered)
    o = k.select(*dict.fromkeys(["case_id", "verdict", *ordered]))
    first = o.groupBy("fingerprint").agg(F.min(F.col(seq)).alias("group_first_seen"))
    o = G.occurrence_numbers(o.withColumn("bucket", time_bucket(F.col(seq))), seq)
    if agent is not None:
        o = o.join(agent, "case_id", "left")
        given = [x for x in agent.columns if x != "case_id"]
    else:
        given = ["agent_ok", "agent_action", "agent_confidence"]
        o = o.withColumns(dict(zip(given, [F.lit(None).cast(t) for t in ("boolean", "string", "double")])))
    if materialize:
        o = _mat(o)
    o = G.reuse_decisions(o, seq, reuse_enabled=reuse_enabled)
    d = F.col("decision")
    ok = F.coalesce(F.col("agent_ok"), F.lit(False))
    o = o.withColumns({
        "provenance": (F.when(d == G.D_CANNED, F.lit("canned")).when(d == G.D_REUSE, F.lit("group_reuse"))
                       .when(ok, F.lit("agent")).otherwise(F.lit("failed_synthesis"))),
        "has_gap": F.coalesce(F.col("trace_gap"), F.lit(False)) if gap else F.lit(False),
    })
    prov = F.col("provenance")
    # Group recommendation in force at each case: the latest earlier agent finding.
    o = P.dlt_confidence(o.withColumn("reused", F.lit(False)), confidence="agent_confidence", action="agent_action")
    o = o.withColumn("_rec", F.when(prov == "agent", F.struct(F.col("final_action").alias("a"),
                                                              F.col("final_confidence").alias("c"))))
    columns = ["bucket", "occurrence", *given, "has_recommendation", "decision", "decision_reason", "provenance",
               "has_gap"]
    o = o.select(*dict.fromkeys(["case_id", *columns, "fingerprint", seq, "_rec"]))
    if materialize:
        o = _mat(o)
    o = chunked_ffill(o, ["_rec"], "fingerprint", "bucket", [seq, "case_id"], suffix="_f")
    o = o.join(first, "fingerprint", "left").select("case_id", *columns, "_rec_f", "group_first_seen")
    if materialize and not whole:
        o = _mat(o)
    for part in (verdicts, o):
        part = part.withColumnRenamed("case_id", "_case")
        c = c.drop(*part.columns).join(part, F.col("case_id").eqNullSafe(F.col("_case"))).drop("_case")
    c = P.canned_findings(c)
    reuse = prov == "group_reuse"
    c = c.withColumns({
        "action": (F.when(prov == "canned", F.col("canned_action")).when(prov == "agent", F.col("agent_action"))
                   .when(prov == "failed_synthesis", F.lit("NEEDS_MANUAL_REVIEW")).otherwise(F.col("_rec_f.a"))),
        "confidence": (F.when(prov == "agent", F.col("agent_confidence"))
                       .when(prov == "failed_synthesis", F.lit(0.0)).when(reuse, F.col("_rec_f.c"))),
        "reused": reuse,
    })
    c = P.dlt_confidence(c.drop("_rec_f"))
    c = P.replay_gate(c, enabled=replay_enabled)
    c = c.withColumn("terminal_status", P.terminal_status(F.col("final_action")))
    # Roll-ups and reports all branch from this table.
    return _mat(c) if materialize and whole else c
