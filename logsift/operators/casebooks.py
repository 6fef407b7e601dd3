"""Casebook assembly, the bounded evidence document and the payload summary
(nested struct columns; one row per case)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.sources.sinks import DLT_CASEBOOK_SCHEMA_VERSION, CASEBOOK_SCHEMA_VERSION

# --- fixed values (must equal the behaviour being matched) -----------------
MAX_SUMMARY_CANDIDATES = 10
MAX_SUMMARY_KEYS = 40
MAX_EVIDENCE_CHARS = 40000
BANNER_RE = r"(?s)(--- EVIDENCE GAPS \(the trace below is INCOMPLETE\) ---.*?--- END EVIDENCE GAPS ---)"
# ---------------------------------------------------------------------------


def payload_summary(df: DataFrame, payload: str = "payload", type_id: str = "type_id",
                    typed: dict[str, dict] | None = None) -> DataFrame:
    """Bounded payload description: for a typed payload the matcher list with
    candidate counts and the first candidates; otherwise the first 40
    top-level keys (and how many more)."""
    typed = typed or {}
    keys = F.json_object_keys(F.col(payload))
    cols = {
        "payload_keys": F.slice(keys, 1, MAX_SUMMARY_KEYS),
        "payload_keys_elided": F.greatest(F.size(keys) - MAX_SUMMARY_KEYS, F.lit(0)),
        "payload_is_object": keys.isNotNull(),
    }
    out = df.withColumns(cols)
    typed_cols: dict[str, list[Column]] = {}
    for t, spec in typed.items():
        node = F.from_json(F.col(payload), spec["schema_ddl"])
        for part in spec["matchers"].split("."):
            node = node.getField(part)
        found = F.coalesce(node, F.array())
        per = F.transform(found, lambda m: F.struct(m[spec["engine"]].alias("engine"),
                                                    F.size(F.coalesce(m[spec["candidates"]], F.array())).alias("candidates")))
        cands = F.flatten(F.transform(found, lambda m: F.coalesce(m[spec["candidates"]], F.array().cast(spec["candidate_type"]))))
        own = {"matchers": per, "candidate_total": F.size(cands), "first_candidates": F.slice(cands, 1, MAX_SUMMARY_CANDIDATES)}
        if len({s["candidate_type"] for s in typed.values()}) > 1:     # one column for all types
            own["first_candidates"] = F.transform(own["first_candidates"], lambda c: F.to_json(F.struct(c.alias("candidate"))))
        for name, value in own.items():
            typed_cols.setdefault(name, []).append(F.when(F.col(type_id) == t, value))
    return out.withColumns({name: F.coalesce(*values) for name, values in typed_cols.items()})


def logs_text(case_lines: DataFrame, line: str = "line", order: Sequence[str] = ("ts", "line_id"),
              chars: int = MAX_EVIDENCE_CHARS) -> DataFrame:
    """case_id, logs_text: the case's log lines in order, one a row of text,
    as far as the first ``chars`` characters reach.  Every line but the first
    takes a character at least (its line break), so no more than ``chars`` + 1
    lines of a hot case leave the partial top-N."""
    w = Window.partitionBy("case_id").orderBy(*order)
    size = F.length("_line") + 1
    return (case_lines.select("case_id", *order, F.substring(F.coalesce(F.col(line), F.lit("")), 1, chars).alias("_line"))
            .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= chars + 1)
            .withColumn("_at", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size)
            .where(F.col("_at") <= chars)
            .groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("_lines"))
            .select("case_id", F.substring(F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n"), 1, chars)
                    .alias("logs_text")))


def evidence_document(cases: DataFrame, logs: str = "logs_text") -> Column:
    """The bounded evidence text of a case (chain, frames, registry line,
    payload summary, corroboration, logs cut at 40,000 characters)."""
    chain = F.array_join(F.transform(F.coalesce(F.col("chain"), F.array()), lambda l, i: F.concat(
        F.lit("  "), (i + 1).cast("string"), F.lit(". "), l["fqcn"], F.lit(": "), F.substring(l["message"], 1, 300))), "\n")
    frames = F.array_join(F.transform(F.coalesce(F.col("frames"), F.array().cast("array<string>")),
                                      lambda f: F.concat(F.lit("  - "), f)), "\n")
    registry = F.when(F.col("registry_description").isNotNull(), F.concat(
        F.col("registry_description"),
        F.when(F.col("registry_category").isNotNull(), F.concat(F.lit("\nCategory: "), F.col("registry_category"),
                                                                F.lit(" ("), F.coalesce(F.col("registry_category_source"),
                                                                                        F.lit("unknown provenance")),
                                                                F.lit(")"))).otherwise(F.lit("")))
    ).otherwise(F.lit("(No registry entry exists for this code.)"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### Case\n"), F.col("case_id"), F.lit("\n")),
        F.concat(F.lit("### Declared failure\nClass: "), F.col("failure_class"), F.lit(" ("), F.col("class_reason"),
                 F.lit(")\nRoot exception: "), F.coalesce(F.col("root_fqcn"), F.lit("None")),
                 F.lit("\nBusiness code: "), F.coalesce(F.col("business_code"), F.lit("None")),
                 F.lit("\nTrace truncated: "), F.col("truncated").cast("string"), F.lit("\n")),
        F.concat(F.lit("### Registry description\n"), registry, F.lit("\n")),
        F.concat(F.lit("### Exception chain (outermost first; the LAST entry is the root)\n"),
                 F.when(chain == "", F.lit("  (none parsed)")).otherwise(chain), F.lit("\n")),
        F.concat(F.lit("### Application frames at the failure site\n"),
                 F.when(frames == "", F.lit("  (none)")).otherwise(frames), F.lit("\n")),
        F.concat(F.lit("### Corroboration\nVerdict: "), F.coalesce(F.col("verdict"), F.lit("None")), F.lit("\nReason: "),
                 F.coalesce(F.col("corroboration_reason"), F.lit("None")), F.lit("\n")),
        F.concat(F.lit("### Logs\n"), F.substring(F.coalesce(F.col(logs), F.lit("(no logs were fetched)")), 1,
                                                  MAX_EVIDENCE_CHARS)))


def dlt_casebook(cases: DataFrame) -> DataFrame:
    """Terminal DLT casebook per case (nested struct) with its status."""
    book = F.struct(
        F.lit(DLT_CASEBOOK_SCHEMA_VERSION).alias("schema_version"),
        F.struct("case_id", "ref_id", "ref_id_source", "fingerprint", "signature").alias("case"),
        F.struct("failure_class", "class_reason", "root_fqcn", "business_code", "truncated").alias("failure"),
        F.struct("verdict", F.col("corroboration_reason").alias("reason"), "citations", "unexplained",
                 "could_not_look").alias("corroboration"),
        F.struct("decision", "decision_reason", "occurrence").alias("reuse"),
        F.struct(F.col("final_action").alias("action"), F.col("final_confidence").alias("confidence"),
                 "ceilings_applied", "provenance", F.col("canned_narrative").alias("narrative")).alias("finding"),
        F.struct(F.col("should_replay").alias("attempted"), F.col("replay_reason").alias("reason")).alias("replay"),
        F.col("gaps_list").alias("evidence_gaps"))
    return cases.select("case_id", F.col("terminal_status").alias("status"), book.alias("casebook"))


def gap_banner(logs: Column) -> Column:
    """The evidence-gap banner embedded in a rendered trace ('' when none)."""
    return F.regexp_extract(logs, BANNER_RE, 1)


def rejection_casebook(cases: DataFrame) -> DataFrame:
    """Rejection casebook: metadata, status with rejection data and the log
    path / gap banner, resolution; a low-confidence or failed-contract result
    overrides the status."""
    status = (F.when(~F.coalesce(F.col("valid"), F.lit(True)), F.lit("FAILED_SYNTHESIS_PARSE"))
              .when(F.coalesce(F.col("abstained"), F.lit(False)), F.lit("NEEDS_MANUAL_REVIEW"))
              .otherwise(F.coalesce(F.col("status"), F.lit("COMPLETED"))))
    book = F.struct(
        F.lit(CASEBOOK_SCHEMA_VERSION).alias("schema_version"),
        F.struct(F.col("event_id").alias("eid"), "ref_id").alias("packet_metadata"),
        F.struct(status.alias("status"), F.struct(F.col("first_reason_code").alias("rejection_code"),
                                                  gap_banner(F.coalesce(F.col("logs_text"), F.lit(""))).alias("gaps"))
                 .alias("rejection_data")).alias("packet_status"),
        F.struct("action", "resident_action", "confidence", "abstained").alias("resolution"))
    return cases.select("event_id", book.alias("casebook"))
