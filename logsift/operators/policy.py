"""Findings and policy: fixed treatments for classes B/C/U, confidence
ceilings, the replay gate, model-output contract checks and text validators.
All column expressions over case tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.operators.groups import seen_summary

# --- fixed values (must equal the behaviour being matched) -----------------
DLT_ACTIONS = ["NEEDS_MANUAL_REVIEW", "ROUTE_TO_DEV", "REDRIVE_AFTER_RECOVERY", "DATA_FIX_REQUIRED", "NO_ACTION"]
ACTIONS = ["REPLAY", "WHITELISTING", "QC_REPLAY", "RO_APPROVAL", "RESIDENT_PACKET_RESUBMIT", "MANUAL_REVIEW"]
RESIDENT_ACTIONS = ["NEW_PACKET", "NEW_PACKET_WITH_DIFFERENT_ARTIFACTS", "RO_APPLICATION", "PENDING"]
CLASS_B_CEILING = 0.3
UNVERIFIED_CEILING = 0.5
CONTRADICTED_CEILING = 0.6
REGISTRY_MISS_CEILING = 0.5
GAP_CEILING = 0.6
REUSE_DECAY = 0.95
REPLAY_ACTIONS = ["REDRIVE_AFTER_RECOVERY"]
REPLAY_THRESHOLD = 0.55
FENCED_JSON_RE = r"(?s)```(?:json)?\s*([\{\[].*?[\}\]])\s*```"
BRACED_JSON_RE = r"(?s)(\{.*\})"
UUID_RE = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
ISO_TS_RE = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
DATE_RE = r"\b\d{4}-\d{2}-\d{2}\b"
LONG_DIGITS_RE = r"\d{10,}"
MAX_RULE_LENGTH = 500
INJECTION_MARKERS = ["ignore previous", "ignore all previous", "disregard previous", "disregard all",
                     "ignore the above", "system:", "assistant:", "</system", "<|im_start|", "<|im_end|",
                     "new instructions", "override the", "you are now", "forget everything"]
# Fixed treatment texts for classes C, B and U.
C_NARRATIVE = ("Technical fault: {signature}. The root exception is a transient or infrastructure-level failure, "
               "not an application defect. Spring exhausted its retries before the dependency recovered. {seen}"
               "{catalog_note}")
C_RECOMMENDATION = ("Confirm the dependency named in the trace is healthy, then redrive this record from the "
                    "dead-letter topic. No code or data change is expected.")
B_NARRATIVE = ("Application defect: {signature}. The root exception indicates a bug in service code rather than a "
               "business rule or a transient fault. {seen}\n\nNo diagnosis is offered: this system has no access to "
               "the source of the failing service, so any explanation of *why* the code failed would be speculation. "
               "The stack trace, the normalised frames and the affected records are attached for the development "
               "team.")
B_RECOMMENDATION = ("Route to the team owning the service in the trace. The frames below name the failure site; the "
                    "occurrence count indicates how widely it is firing.")
U_NARRATIVE = ("Unclassified failure: {signature}. {class_reason} {seen}\n\nThe root exception is not in the known "
               "classification map, so no treatment can be assigned automatically. The verbatim stack trace is "
               "attached.")
U_RECOMMENDATION = ("A human should read the attached trace and, once its treatment is known, add the root exception "
                    "to DLT_CLASS_MAP so future occurrences classify automatically.")
CATALOG_NOTE = ("\n\nThis was raised as a business exception, but the reason code {code}{detail} is a technical "
                "fault: {provenance}. It is treated as Class C for that reason, which is why no per-packet "
                "investigation was run.")
PROVENANCE_DECLARED = "declared as such in the BusinessReasonCode source"
PROVENANCE_INFERRED = ("inferred from its numeric id range -- weaker evidence than a declared category, so treat "
                       "this classification as provisional")
PROVENANCE_OTHER = "categorised by the reason-code catalog"
DISCREPANCY = "The logs do not support the declared exception: {reason}. Treat the declared root cause with suspicion."
# ---------------------------------------------------------------------------


def template(text: str, **cols: Column) -> Column:
    """Fill ``{name}`` placeholders of a fixed text with columns."""
    import re
    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", text):
        parts.append(F.lit(text[pos:m.start()]))
        parts.append(F.coalesce(cols[m.group(1)], F.lit("")))
        pos = m.end()
    parts.append(F.lit(text[pos:]))
    return F.concat(*parts)


def catalog_note(code: Column, category: Column, source: Column, description: Column) -> Column:
    prov = (F.when(source == "declared", F.lit(PROVENANCE_DECLARED))
            .when(source == "inferred", F.lit(PROVENANCE_INFERRED)).otherwise(F.lit(PROVENANCE_OTHER)))
    detail = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(' ("'), description, F.lit('")'))) \
        .otherwise(F.lit(""))
    note = template(CATALOG_NOTE, code=code, detail=detail, provenance=prov)
    return F.when((F.coalesce(code, F.lit("")) != "") & (category == "TECHNICAL_EXCEPTION"), note).otherwise(F.lit(""))


def canned_findings(cases: DataFrame, occurrence: str = "occurrence", first_seen: str = "group_first_seen") -> DataFrame:
    """Fixed narrative / recommendation / action for classes B, C and U
    (NULL for class A).  Confidence stays NULL: no model produced it."""
    sig = F.coalesce(F.nullif(F.col("signature"), F.lit("")), F.nullif(F.col("root_fqcn"), F.lit("")),
                     F.lit("unknown failure"))
    seen = seen_summary(F.col(occurrence), F.col(first_seen))
    note = catalog_note(F.col("business_code"), F.col("registry_category"), F.col("registry_category_source"),
                        F.col("registry_description"))
    cls = F.col("failure_class")
    narrative = (F.when(cls == "C", template(C_NARRATIVE, signature=sig, seen=seen, catalog_note=note))
                 .when(cls == "B", template(B_NARRATIVE, signature=sig, seen=seen))
                 .when(cls == "U", template(U_NARRATIVE, signature=sig, seen=seen,
                                            class_reason=F.col("class_reason"))))
    rec = (F.when(cls == "C", F.lit(C_RECOMMENDATION)).when(cls == "B", F.lit(B_RECOMMENDATION))
           .when(cls == "U", F.lit(U_RECOMMENDATION)))
    action = (F.when(cls == "C", F.lit("REDRIVE_AFTER_RECOVERY")).when(cls == "B", F.lit("ROUTE_TO_DEV"))
              .when(cls == "U", F.lit("NEEDS_MANUAL_REVIEW")))
    disc = F.when(F.col("verdict").isin("CONTRADICTED", "PARTIAL") & (cls != "A"),
                  template(DISCREPANCY, reason=F.col("corroboration_reason")))
    return cases.withColumns({"canned_narrative": narrative, "canned_recommendation": rec,
                              "canned_action": action, "canned_discrepancy": disc})


def dlt_confidence(cases: DataFrame, confidence: str = "confidence", action: str = "action",
                   reused: str = "reused", has_gap: str = "has_gap") -> DataFrame:
    """Cap confidence at what the evidence supports.

    Every ceiling that applies is listed in ``ceilings_applied`` (in order),
    even when it is not the smallest; reuse decay applies before the cap; a
    NULL confidence stays NULL; classes B/U get a routed action forced.
    """
    cls, v = F.col("failure_class"), F.col("verdict")
    hit = F.coalesce(F.col("registry_description").isNotNull() & (F.col("registry_description") != ""), F.lit(False))
    caps = [
        (cls.isin("B", "U"), F.lit(CLASS_B_CEILING), F.concat(F.lit("class_"), F.lower(cls))),
        (v == "UNVERIFIABLE", F.lit(UNVERIFIED_CEILING), F.lit("unverifiable")),
        (v == "CONTRADICTED", F.lit(CONTRADICTED_CEILING), F.lit("contradicted")),
        ((cls == "A") & ~hit, F.lit(REGISTRY_MISS_CEILING), F.lit("registry_miss")),
        (F.coalesce(F.col(has_gap), F.lit(False)), F.lit(GAP_CEILING), F.lit("evidence_gap")),
    ]
    ceiling = F.least(F.lit(1.0), *[F.when(c, val).otherwise(F.lit(1.0)) for c, val, _ in caps])
    labels = F.array_compact(F.array(*[F.when(c, lbl) for c, _, lbl in caps]))
    conf = F.col(confidence)
    reuse = F.coalesce(F.col(reused), F.lit(False))
    decayed = F.when(reuse, conf * F.lit(REUSE_DECAY)).otherwise(conf)
    labels = F.when(conf.isNotNull() & reuse, F.array_append(labels, F.lit("reuse_decay"))).otherwise(labels)
    forced = F.when(cls.isin("B", "U") & ~F.col(action).isin("NEEDS_MANUAL_REVIEW", "ROUTE_TO_DEV"),
                    F.lit("NEEDS_MANUAL_REVIEW")).otherwise(F.col(action))
    capped = F.when(decayed.isNull(), F.lit(None).cast("double")).otherwise(F.least(decayed, ceiling))
    return cases.withColumns({"final_confidence": capped, "ceilings_applied": labels,
                              "final_action": forced})


def replay_gate(cases: DataFrame, action: str = "final_action", confidence: str = "final_confidence",
                ref_id: str = "ref_id", enabled: bool = True, actions: Sequence[str] = tuple(REPLAY_ACTIONS),
                threshold: float = REPLAY_THRESHOLD) -> DataFrame:
    """should_replay with the first failing reason (or the passing one)."""
    a, c = F.col(action), F.col(confidence)
    acts = "(" + ", ".join("'" + x + "'" for x in actions) + ")"
    from logsift.functions.text import py_fixed

    def fmt2(x):
        return py_fixed(x, 2)
    reason = (F.when(F.lit(not enabled), F.lit("DLT_AUTO_REPLAY_ENABLED is off"))
              .when(~a.isin(*actions) | a.isNull(),
                    F.concat(F.lit("action '"), F.coalesce(a, F.lit("None")), F.lit("' is not in the replay-worthy set "),
                             F.lit(acts)))
              .when(c.isNull(), F.lit("finding carries no confidence score -- a canned treatment produced it, and no "
                                      "model ran to be confident about anything"))
              .when(c < threshold, F.concat(F.lit("confidence "), fmt2(c), F.lit(" is below DLT_REPLAY_CONFIDENCE_THRESHOLD ("),
                                            F.lit(f"{threshold:.2f}"), F.lit(")")))
              .when(F.coalesce(F.col(ref_id), F.lit("")) == "",
                    F.lit("no refId on this case; nothing to identify the packet to OIS with"))
              .otherwise(F.concat(F.lit("action "), a, F.lit(" at confidence "), fmt2(c), F.lit(" clears the "),
                                  F.lit(f"{threshold:.2f}"), F.lit(" threshold"))))
    ok = (F.lit(enabled) & a.isin(*actions) & c.isNotNull() & (c >= threshold)
          & (F.coalesce(F.col(ref_id), F.lit("")) != ""))
    return cases.withColumns({"should_replay": F.coalesce(ok, F.lit(False)), "replay_reason": reason})


def terminal_status(action: Column) -> Column:
    return F.when(action == "NO_ACTION", F.lit("COMPLETED")).otherwise(F.lit("NEEDS_MANUAL_REVIEW"))


# ------------------------------------------------------ model-output contract

SYNTHESIS_SCHEMA = T.StructType([
    T.StructField("rejection_description", T.StringType()), T.StructField("synthesis", T.StringType()),
    T.StructField("action", T.StringType()), T.StructField("resident_action", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("abstained", T.BooleanType())])


def extract_json_block(text: Column) -> Column:
    fenced = F.nullif(F.regexp_extract(text, FENCED_JSON_RE, 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(text, BRACED_JSON_RE, 1), F.lit(""))
    stripped = F.trim(text)
    whole = F.when(stripped.startswith("{") | stripped.startswith("["), stripped)
    return F.coalesce(fenced, braced, whole)


def check_synthesis(df: DataFrame, text: str = "response", enums: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Validate model output against the contract: JSON object, enum fields,
    confidence in [0, 1] or null.  Adds the parsed fields, ``errors`` and
    ``valid``; split on ``valid`` for the good and invalid tables."""
    enums = enums if enums is not None else {"action": ACTIONS, "resident_action": RESIDENT_ACTIONS}
    block = extract_json_block(F.col(text))
    df = df.withColumn("_blk", block)
    is_obj = F.coalesce(F.col("_blk").startswith("{") & F.json_object_keys("_blk").isNotNull(), F.lit(False))
    parsed = F.from_json(F.col("_blk"), SYNTHESIS_SCHEMA)
    df = df.withColumns({"_obj": is_obj, "_p": F.when(is_obj, parsed)})
    errs = [F.when(F.col("_blk").isNull(), F.lit("Response contained no JSON object.")),
            F.when(F.col("_blk").isNotNull() & ~F.col("_obj"), F.lit("Response was not a JSON object."))]
    for field, allowed in enums.items():
        errs.append(F.when(F.col("_obj") & (F.col(f"_p.{field}").isNull() | ~F.col(f"_p.{field}").isin(*allowed)),
                           F.lit(f"field '{field}': must be one of {', '.join(allowed)}")))
    errs.append(F.when(F.col("_obj") & ((F.col("_p.confidence") < 0) | (F.col("_p.confidence") > 1)),
                       F.lit("field 'confidence': must be between 0 and 1")))
    out = df.withColumn("errors", F.array_compact(F.array(*errs)))
    return (out.withColumns({"valid": F.size("errors") == 0,
                             **{f: F.col(f"_p.{f}") for f in SYNTHESIS_SCHEMA.fieldNames()}})
            .drop("_blk", "_obj", "_p"))


APPROVAL_STRIP = "*_`\"' \t\n\r"


def is_reviewer_approved(feedback: Column) -> Column:
    """Whitespace-, then markup-stripped text must START with APPROVED."""
    from logsift.functions.text import strip_ws
    stripped = F.btrim(strip_ws(F.coalesce(feedback, F.lit(""))), F.lit(APPROVAL_STRIP))
    return F.upper(stripped).startswith("APPROVED")


def confidence_policy(df: DataFrame, confidence: str = "confidence", has_gap: str = "has_gap",
                      threshold: float = 0.0, ceiling: float = GAP_CEILING) -> DataFrame:
    """Cap at the gap ceiling when the trace has gaps, then abstain below the
    threshold (0 = off): action MANUAL_REVIEW, resident action PENDING."""
    c = F.col(confidence)
    capped = F.when(F.coalesce(F.col(has_gap), F.lit(False)) & c.isNotNull() & (c > ceiling), F.lit(ceiling)).otherwise(c)
    df = df.withColumn("policy_confidence", capped)
    abst = F.coalesce(F.lit(threshold > 0) & F.col("policy_confidence").isNotNull()
                      & (F.col("policy_confidence") < threshold), F.lit(False))
    return df.withColumns({
        "abstained": abst,
        "policy_action": F.when(abst, F.lit("MANUAL_REVIEW")).otherwise(F.col("action")),
        "policy_resident_action": F.when(abst, F.lit("PENDING")).otherwise(F.col("resident_action")),
    })


def validate_generic_text(text: Column, source_values: Column | None = None) -> Column:
    """Violations for packet-specific identifiers in a text."""
    out = [F.when(text.rlike(UUID_RE), F.lit("Contains a UUID.")),
           F.when(text.rlike(ISO_TS_RE) | text.rlike(DATE_RE), F.lit("Contains a timestamp or date literal.")),
           F.when(text.rlike(LONG_DIGITS_RE), F.lit("Contains a digit run of 10 or more (e.g. SRN, EID)."))]
    arr = F.array_compact(F.array(*out))
    if source_values is not None:
        vals = F.transform(F.filter(source_values, lambda v: (F.length(v) > 3) & text.contains(v)),
                           lambda v: F.concat(F.lit("Contains source value: "), v))
        arr = F.concat(arr, vals)
    return arr


def validate_learning_rule(rule: Column) -> Column:
    """Violations of a proposed rule (empty -> one violation and stop)."""
    from logsift.functions.text import strip_ws
    t = strip_ws(F.coalesce(rule, F.lit("")))
    low = F.lower(t)
    markers = F.array(*[F.lit(m) for m in INJECTION_MARKERS])
    inj = F.transform(F.filter(markers, lambda m: low.contains(m)),
                      lambda m: F.concat(F.lit("Contains instruction-shaped text: '"), m, F.lit("'")))
    base = F.array_compact(F.array(
        F.when(F.length(t) > MAX_RULE_LENGTH, F.concat(F.lit("Rule is "), F.length(t).cast("string"),
                                                       F.lit(f" characters; the limit is {MAX_RULE_LENGTH}.")))))
    fence = F.array_compact(F.array(F.when(t.contains("```"), F.lit("Contains a fenced code block."))))
    return F.when(t == "", F.array(F.lit("Rule is empty."))).otherwise(
        F.concat(base, inj, fence, validate_generic_text(t)))


# --- fixed values (must equal the behaviour being matched) -----------------
REPLAY_ID_TYPE = "REFID"
REPLAY_OPERATOR = "dlt-analysis-auto"
REPLAY_CATEGORY = "DLT_REDRIVE"
REPLAY_PRIORITY = 5
# ---------------------------------------------------------------------------


def replay_nominations(cases: DataFrame, id_col: str = "ref_id") -> DataFrame:
    """Replay-queue rows for cases that cleared the gate."""
    return cases.where(F.col("should_replay")).select(
        "case_id", F.col(id_col).alias("id"), F.lit(REPLAY_ID_TYPE).alias("idType"),
        F.lit(REPLAY_PRIORITY).alias("priority"), F.lit(REPLAY_OPERATOR).alias("operatorName"),
        F.lit(REPLAY_CATEGORY).alias("category"), F.lit(False).alias("fromSedaStart"))
